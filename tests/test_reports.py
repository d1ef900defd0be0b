"""Totals and top lists from one scan, against plain pandas."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.operators import onepass as O
from flowloom.plans import fixtures as Fx
from flowloom.plans import registry

COLUMNS = "a int, b long, w long"


def grouped(spark, rows, most=3):
    return O.grouped_once(spark.createDataFrame(rows, COLUMNS).repartition(3), {"a": F.col("a"), "b": F.col("b")}, {"w": F.col("w")}, {"b": "w"}, most)


def test_grouped_once(spark):
    """Ties go to smaller keys, null keys are counted in totals alone, a null weight comes last."""
    rows = [(i % 5, i % 7, i * 31 % 11) for i in range(90)] + [(None, 1, 5), (9, None, 4), (9, 50, None), (8, 51, None), (8, 52, -3)]
    page = grouped(spark, rows, 20)
    for key, place in (("a", 0), ("b", 1)):
        wanted = {}
        for r in rows:
            n, w = wanted.get(r[place], (0, None))
            wanted[r[place]] = (n + 1, w if r[2] is None else (w or 0) + r[2])
        wanted.pop(None)
        worth = (lambda k: -wanted[k][0]) if key == "a" else (lambda k: (wanted[k][1] is None, -(wanted[k][1] or 0)))
        best = sorted(wanted, key=lambda k: (worth(k), k))
        found = O.largest(page, key).orderBy("place").collect()
        assert [(r.place, r.key, r.flows, r.w) for r in found] == [(i + 1, k, *wanted[k]) for i, k in enumerate(best)]
        assert [r.key for r in O.largest(page, key, 2).orderBy("place").collect()] == best[:2]
        assert page.select(O.total(key, "n"), O.total(key, "flows"), O.total(key, "w")).first()[:] == (len(wanted), len(rows), sum(r[2] or 0 for r in rows))


def test_grouped_once_of_nothing(spark):
    page = grouped(spark, [])
    assert O.largest(page, "a").count() == 0 and page.select(O.total("a", "n")).first()[0] is None


def test_grouped_once_of_null_keys_alone(spark):
    page = grouped(spark, [(None, None, 2), (None, None, 3)])
    assert O.largest(page, "a").count() == 0 and page.select(O.total("a", "n"), O.total("b", "w")).first()[:] == (0, 5)


def test_a_dashboard_reads_the_table_twice(spark, sf_dir, tmp_path):
    """Once for six sections, once for the newest records: told by the files that tasks read."""
    from flowloom.plans import fixtures as Fx
    from flowloom.plans import reports as C
    from flowloom.sources import tables as T

    T.write_flows(Fx.flow_logs(spark, sf_dir), f"{tmp_path}/hot")
    flows = T.read_flows(spark, f"{tmp_path}/hot")
    whole = C.dashboard(flows, 0, 7, Fx.AS_OF)
    plan = C.stacked(whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # the records; the other sections stand on one small row
    assert whole["scalars"].first().rows == flows.filter(F.col("event_date") >= F.date_sub(F.lit(Fx.AS_OF).cast("date"), 7)).count()
    assert whole["today"].first().n == sum(r.flows for r in whole["hourly"].collect())


def many(spark, sf_dir, n):
    """n flows that every search below finds."""
    row = Fx.flow_logs(spark, sf_dir).limit(1).withColumns({"nat_public_ip": F.lit(X.ip("203.0.113.42")), "protocol": F.lit(17), "flow_start": F.timestamp_seconds(F.lit(Fx.AS_OF_S - 86400)), "event_date": F.lit("2024-01-29").cast("date")})
    columns = row.columns
    return row.crossJoin(spark.range(n)).withColumn("bytes", F.col("id")).select(*columns)


@pytest.mark.parametrize("name, n, wanted", [("c5_disclosure", 5_100, 5_100), ("s12_report_csv", 5_100, 5_100), ("u1_search_all", 5_100, 10_200)])
def test_more_matches_than_a_page_searches(spark, sf_dir, monkeypatch, name, n, wanted):
    rows = many(spark, sf_dir, n)
    monkeypatch.setattr(registry, "flow_logs", lambda *_: rows)
    assert registry.QUERIES[name](spark, sf_dir).count() == wanted


def test_more_matches_than_a_page_counts(spark, sf_dir, monkeypatch):
    rows = many(spark, sf_dir, 100_001)
    monkeypatch.setattr(registry, "flow_logs", lambda *_: rows)
    found = registry.QUERIES["c4_search_page"](spark, sf_dir).filter("section = 'total'").collect()
    assert [r.row for r in found] == ['{"capped":false,"n":100001}']


def test_human_bytes_rounds_halves_to_even(spark):
    units = [1 << 10 * i for i in range(1, 7)]
    numbers = [x for u in units for x in (u, u + u // 4, u + 3 * (u // 4), 3 * u + u // 4, 2 * u - 1, 7 * u + u // 4 + 1) if x < 1 << 63] + [0, 1023, 928_000, (1 << 63) - 1, (1 << 60) + (1 << 58) - 3]
    found = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.human_bytes(F.col("n")).alias("text")).collect()

    def plain(n):
        i = max((i for i, u in enumerate(units) if n >= u), default=None)
        return f"{n} B" if i is None else f"{n / units[i]:.1f} {'KMGTPE'[i]}iB"

    assert [r.text for r in found] == [plain(r.n) for r in found]


def test_datagrams_have_the_same_ids_in_any_order(spark, sf_dir):
    """Decoding reads datagrams twice, and shuffled rows needn't come in the same order again."""
    raw = Fx.raw_flows(spark, sf_dir).filter("flow_type = 'ipfix'")
    ids = lambda rows: sorted(r[0] for r in Fx.datagrams_ipfix(rows).select("datagram_id").collect())
    assert ids(raw) == ids(raw.filter("bytes % 2 = 1").unionByName(raw.filter("bytes % 2 = 0")))
    assert len(set(ids(raw))) == raw.count()
