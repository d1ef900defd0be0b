"""Streams against their batch twins, and the state machines."""

import time

import pytest
from pyspark.sql import functions as F

from flowloom import schemas
from flowloom.operators import decode as D
from flowloom.operators import ingest as I
from flowloom.operators import lifecycle as L
from flowloom.operators import liveness as V
from flowloom.operators import rollup as R
from flowloom.plans import fixtures as Fx
from flowloom.plans.registry import liveness_ticks
from flowloom.sources import tables as T
from flowloom.streaming import streams
from tests.conftest import rows_of


def collected(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="1 second").start()
    # All input is one file, so one batch; queries with timed state go on with batches without rows.
    for _ in range(240):
        if any(p.numInputRows for p in q.recentProgress) or not q.isActive:
            break
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None
    return spark.table(name)


def test_ingest_stream(spark, sf_dir, tmp_path):
    raw = Fx.raw_flows(spark, sf_dir).limit(500)
    Fx.datagrams_v5(raw).union(Fx.datagrams_ipfix(raw)).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = T.read_datagrams(spark, f"{tmp_path}/in", stream=True)
    streams.ingest_stream(stream, lambda s: Fx.devices(s, sf_dir), f"{tmp_path}/hot", f"{tmp_path}/check", availableNow=True).awaitTermination()
    found = T.read_flows(spark, f"{tmp_path}/hot")
    batch = I.ingest(D.to_raw_flows(D.decode(spark.read.parquet(f"{tmp_path}/in"))), Fx.devices(spark, sf_dir))
    assert rows_of(found.select(sorted(batch.columns))) == rows_of(batch)
    wanted = I.accounting(D.to_raw_flows(D.decode(spark.read.parquet(f"{tmp_path}/in"))), Fx.devices(spark, sf_dir))
    assert rows_of(streams.read_accounting(spark, f"{tmp_path}/check")) == rows_of(wanted) != []


def test_accounting_of_a_batch_that_stores_nothing(spark, sf_dir, tmp_path):
    """Every exporter is unknown, and the mode rejects those."""
    devices = Fx.devices(spark, sf_dir).withColumn("exporter_ip", -F.col("id").cast("long")).cache()
    Fx.datagrams_v5(Fx.raw_flows(spark, sf_dir).limit(200)).coalesce(1).write.parquet(f"{tmp_path}/in")
    streams.ingest_stream(T.read_datagrams(spark, f"{tmp_path}/in", stream=True), lambda s: devices, f"{tmp_path}/hot", f"{tmp_path}/check", mode="reject", availableNow=True).awaitTermination()
    found = streams.read_accounting(spark, f"{tmp_path}/check")
    assert rows_of(found) == rows_of(I.accounting(D.to_raw_flows(D.decode(spark.read.parquet(f"{tmp_path}/in"))), devices, "reject"))
    assert [r.state for r in found.collect()] == ["rejected"]


def test_ingest_stream_keeps_templates_over_batches(spark, sf_dir, tmp_path):
    """A template in one micro-batch and its data in later ones; a withdrawal and half an hour without use end it."""
    import datetime as dt

    from tests import test_decode as B

    sent = [
        B.v9(B.a_set(0, B.template(256, *B.FIELDS))), B.v9(B.a_set(256, B.record())), B.v9(B.a_set(256, B.record("10.0.0.2"))),  # known, and again
        B.v9(B.a_set(256, B.record("10.0.0.3"))),  # 25 minutes later: use has kept it alive
        B.v9(B.a_set(256, B.record("10.0.0.4"))),  # 31 minutes after that: gone
        B.ipfix(B.a_set(2, B.template(300, (8, 4), (12, 4), (1, 4)))), B.ipfix(B.a_set(2, b"\x01\x2c\x00\x00")), B.ipfix(B.a_set(300, B.ip4("10.0.0.5") + B.ip4("8.8.8.8") + b"\0\0\0\x09")),
    ]
    minutes = [0, 10, 20, 45, 76, 76, 77, 78]
    for i, (payload, at) in enumerate(zip(sent, minutes)):
        when = B.AT + dt.timedelta(minutes=at)
        spark.createDataFrame([(i, when, B.X.ip("203.0.113.1"), 2055, payload)], schemas.DATAGRAMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = T.read_datagrams(spark, f"{tmp_path}/in", stream=True)
        devices = Fx.devices(spark, sf_dir)
        streams.ingest_stream(stream, lambda s: devices, f"{tmp_path}/hot", f"{tmp_path}/check", availableNow=True).awaitTermination()
    found = T.read_flows(spark, f"{tmp_path}/hot")
    assert sorted(r.src_ip & 255 for r in found.collect()) == [1, 2, 3]
    day = str(found.first().event_date)
    assert L.drop_day(spark, f"{tmp_path}/hot", day) and not L.drop_day(spark, f"{tmp_path}/hot", day)


def test_template_state(spark, tmp_path):
    """Expiry by the datagrams' own times, refreshed by use; withdrawal; eviction of what was unused longest."""
    import datetime as dt

    from tests import test_decode as B

    t = lambda i: B.ipfix(B.a_set(2, B.template(i, (8, 4))))
    data = lambda i: B.ipfix(B.a_set(i, bytes(4)))
    sent = [(0, t(256)), (20, data(256)), (45, data(256)), (80, data(256)), (81, t(300)), (82, t(301)), (83, data(300)), (84, t(302)), (85, data(301)), (86, B.ipfix(B.a_set(2, b"\x01\x2c\0\0"))), (87, data(300))]
    rows = [(i, B.AT + dt.timedelta(minutes=m), 1, 4739, p) for i, (m, p) in enumerate(sent)]
    spark.createDataFrame(rows, schemas.DATAGRAMS).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = collected(spark, streams.template_state(T.read_datagrams(spark, f"{tmp_path}/in", stream=True), most=2), "templates", tmp_path)
    assert [(r.event, r.template_id) for r in found.collect()] == [
        ("stored", 256), ("known", 256), ("known", 256), ("unknown", 256), ("stored", 300), ("stored", 301), ("known", 300), ("stored", 302), ("evicted", 301), ("unknown", 301), ("withdrawn", 300), ("unknown", 300),
    ]


def test_ingest_stream_is_the_same_for_any_batches(spark, sf_dir, tmp_path):
    """Templates by half hours, all in one batch and a file a batch."""
    sent = Fx.datagrams_v9(Fx.raw_flows(spark, sf_dir).filter("exporter_ip % 4 = 0 AND flow_type = 'netflow9'").limit(60)).orderBy("recv_ts", "datagram_id").coalesce(1)
    sent.write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/in")
    devices = Fx.devices(spark, sf_dir).cache()
    batch = I.ingest(D.to_raw_flows(D.decode(spark.read.parquet(f"{tmp_path}/in"), streams.TTL_MS // 1000)), devices)
    for name, most in (("one", 1000), ("each", 1)):
        stream = spark.readStream.schema(schemas.DATAGRAMS).option("maxFilesPerTrigger", most).parquet(f"{tmp_path}/in")
        streams.ingest_stream(stream, lambda s: devices, f"{tmp_path}/{name}", f"{tmp_path}/check-{name}", availableNow=True).awaitTermination()
        assert rows_of(T.read_flows(spark, f"{tmp_path}/{name}").select(sorted(batch.columns))) == rows_of(batch)
        assert streams.read_accounting(spark, f"{tmp_path}/check-{name}").filter("reason = 'kept'").agg(F.sum("flows")).first()[0] == batch.count()
    assert len(list((tmp_path / "check-each-templates").iterdir())) == 2


def test_liveness_stream(spark, sf_dir, tmp_path):
    devices = Fx.devices(spark, sf_dir).limit(4).cache()
    ticks = liveness_ticks(spark, sf_dir).filter("tick_s < 1704067200 + 6 * 86400").join(F.broadcast(devices.select("isp_id", "exporter_ip")), ["isp_id", "exporter_ip"], "left_semi")
    ticks.repartition(1).write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    found = collected(spark, streams.liveness_stream(stream, devices, 6 * 3600, 12 * 3600), "liveness", tmp_path)
    assert rows_of(found) == rows_of(V.transitions(spark.read.parquet(f"{tmp_path}/ticks"), devices, 6 * 3600, 12 * 3600))


def test_liveness_fold():
    state, events = None, []
    for tick, seen in [(0, None), (100, 90), (1100, 90), (1500, 90), (2200, 90), (2300, 2290), (2400, 50)]:
        state, event = V.fold(state, tick, seen, 900, 1000)
        events.append(event)
    assert events == [None, None, "silent", None, "reminder", "recovered", None]
    assert state[0] == 2290


def test_liveness_forgets_what_leaves_the_registry(spark, tmp_path):
    """Silent, taken out for a tick, and back: no recovery is told of what was before; one that stays recovers."""
    ticks = "isp_id int, exporter_ip long, tick_s long, seen_s long"
    listed = [[1, 2], [1, 2], [2], [1, 2]]
    for i, (tick, seen) in enumerate([(1000, 990), (2000, 990), (3000, 990), (4000, 3990)]):
        spark.createDataFrame([(1, x, tick, seen) for x in (1, 2)], ticks).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        devices = spark.createDataFrame([(1, x, True) for x in listed[i]], "isp_id int, exporter_ip long, enabled boolean")
        stream = streams.liveness_stream(spark.readStream.schema(ticks).parquet(f"{tmp_path}/ticks"), devices, 900)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.exporter_ip, r.tick_s, r.event) for r in found) == [(1, 2000, "silent"), (2, 2000, "silent"), (2, 4000, "recovered")]


def test_silence_without_ticks(spark, tmp_path):
    """Timers alone raise silence and reminders; a lease that ends, a disabled device and an unlisted one raise nothing."""
    seen, listed = "isp_id int, exporter_ip long, seen_s long", "isp_id int, exporter_ip long, enabled boolean, listed_s long"
    now = int(time.time())
    kept, leaves, off, stranger = 1, 2, 3, 4

    def add(folder, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")

    # The lease of `leaves` ends before its silence is due.
    add("listed", [(1, kept, True, now + 1000), (1, leaves, True, now - 56), (1, off, False, now)], listed)
    add("seen", [(1, x, now) for x in (kept, leaves, off, stranger)], seen)
    out = streams.silence_stream(spark.readStream.schema(seen).parquet(f"{tmp_path}/seen"), spark.readStream.schema(listed).parquet(f"{tmp_path}/listed"), 20, 3, 60)
    q = out.writeStream.format("memory").queryName("silence").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()

    def until(event):
        for _ in range(120):
            assert q.exception() is None
            if event in {r.event for r in spark.table("silence").collect()}:
                return
            time.sleep(0.5)

    until("reminder")
    add("seen", [(1, x, int(time.time())) for x in (kept, leaves, off, stranger)], seen)
    until("recovered")
    q.stop()
    found = spark.table("silence").orderBy("tick_s").collect()
    events = [r.event for r in found]
    assert {r.exporter_ip for r in found} == {kept}
    assert events[:2] == ["silent", "reminder"] and "recovered" in events and set(events[1 : events.index("recovered")]) == {"reminder"}
    assert found[0].tick_s > now + 20 and found[0].last_s == now


def test_dedup_stream(spark, tmp_path, sf_dir):
    flows = Fx.flow_logs(spark, sf_dir).limit(20)
    flows.union(flows).repartition(1).write.parquet(f"{tmp_path}/flows")
    stream = I.dedup_flows(spark.readStream.schema(flows.schema).parquet(f"{tmp_path}/flows"))
    assert rows_of(collected(spark, stream, "dedup", tmp_path)) == rows_of(I.dedup_flows(spark.read.parquet(f"{tmp_path}/flows")))


def test_archive_failures_leave_the_day(spark, sf_dir, tmp_path):
    T.write_flows(Fx.flow_logs(spark, sf_dir).filter("event_date < DATE '2024-01-05'"), f"{tmp_path}/hot")

    def broken(_):
        raise OSError("no books")

    days = spark.createDataFrame([], "day date")
    rows = L.archive_sweep(spark, f"{tmp_path}/hot", days, f"{tmp_path}/cold", 26, "2024-01-30", save=broken).collect()
    assert rows and {r.status for r in rows} == {"left"}
    assert T.read_flows(spark, f"{tmp_path}/hot").filter("event_date < DATE '2024-01-04'").count() > 0


def test_report_and_registry_files(spark, sf_dir, tmp_path):
    T.append_audit(spark, f"{tmp_path}/audit", dict.fromkeys(c.split(" ")[0] for c in schemas.QUERY_AUDIT.split(", ")) | {"id": 1, "isp_id": 2})
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 1
    devices = Fx.devices(spark, sf_dir)
    devices.agg(F.collect_list(F.struct(*devices.columns)).alias("devices")).select(F.lit("v1").alias("version"), F.lit("allow").alias("unknown_mode"), "devices").coalesce(1).write.json(f"{tmp_path}/bundle")
    assert T.read_registry(spark, f"{tmp_path}/bundle").count() == devices.count()


def truncated(spark, base, day):
    """Takes one file of the day out of an archive."""
    y, m, d = day.split("-")
    T.delete(spark, T.found(spark, f"{base}/isp_id=*/year={y}/month={m}/day={d}/part-*")[0])


@pytest.mark.parametrize("fmt", ["parquet", "csvgz"])
def test_an_archive_that_lacks_rows_leaves_the_day(spark, sf_dir, tmp_path, monkeypatch, fmt):
    flows = Fx.flow_logs(spark, sf_dir).filter("event_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'")
    T.write_flows(flows, f"{tmp_path}/hot")
    days, whole = spark.createDataFrame([], "day date"), L.archive_day

    def cut(df, day, base, fmt="parquet"):
        whole(df, day, base, fmt)
        if day == "2024-01-02":
            truncated(spark, base, day)
        return L.written_day(spark, base, day, fmt)

    monkeypatch.setattr(L, "archive_day", cut)
    rows = {str(r.day): r.status for r in L.archive_sweep(spark, f"{tmp_path}/hot", days, f"{tmp_path}/cold", 7, "2024-01-30", fmt).collect()}
    assert rows == {"2024-01-02": "left", "2024-01-03": "archived, dropped"}
    left = T.read_flows(spark, f"{tmp_path}/hot")
    assert rows_of(left) == rows_of(flows.filter("event_date = DATE '2024-01-02'").select(*left.columns))


def test_a_large_tenant_is_archived_in_even_files(spark, tmp_path):
    """95 % of the rows are one tenant's, a third of them of one device and second."""
    day = F.lit("2024-01-02").cast("date")
    isp = F.when(F.col("id") % 20 == 0, 1 + F.col("id") % 7).otherwise(99).cast("int")
    start = F.when(F.col("id") % 3 == 0, F.lit(1704200000)).otherwise(1704153600 + F.col("id") * 7919 % 80000)
    zero = {c: F.lit(0) for c in ("src_port", "dst_port", "nat_public_port", "protocol")} | {c: F.lit(0).cast("long") for c in ("dst_ip", "nat_public_ip", "bytes", "packets", "exporter_ip")}
    rows = spark.range(20_000).select(day.alias("event_date"), isp.alias("isp_id"), (F.col("id") % 5).cast("int").alias("device_id"), F.col("id").alias("src_ip"), F.timestamp_seconds(start).alias("flow_start"), F.timestamp_seconds(start).alias("flow_end"), F.lit("ipfix").alias("flow_type"), F.current_timestamp().alias("created_at"), *[v.alias(c) for c, v in zero.items()])
    summed = {r.isp_id: r.rows for r in L.archive_day(rows, "2024-01-02", f"{tmp_path}/cold", rows_per_file=1000).collect()}
    assert summed == {r.isp_id: r["count"] for r in rows.groupBy("isp_id").count().collect()}
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/cold").filter("isp_id = 99").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2000 and sum(sizes) == summed[99]


def test_rollup_compaction(spark, sf_dir, tmp_path):
    flows = Fx.flow_logs(spark, sf_dir).filter("isp_id = 2").cache()
    parts, path = 9, str(tmp_path)
    batch = lambda i: flows.filter(F.pmod(F.xxhash64(*flows.columns), F.lit(parts)) == i)

    def store(i):
        R.rollup_hourly(batch(i)).write.mode("overwrite").parquet(f"{path}/hourly/batch_id={i}")
        R.rollup_subs(batch(i)).write.mode("overwrite").parquet(f"{path}/subs/batch_id={i}")

    def totals():
        hourly, subs = streams.read_rollup(spark, path)
        return [tuple(r) for df in (hourly.agg(F.sum("flows"), F.sum("bytes"), F.count("*"), F.hll_sketch_estimate(F.hll_union_agg("subs"))), subs.agg(F.sum("bytes"), F.count("*"))) for r in df.collect()]

    begun = None
    for i in range(parts):
        store(i)
        if i in (2, 5, 8):
            begun = streams.read_rollup(spark, path)[0].agg(F.sum("flows").alias("n"))  # planned before, run after
            before = totals()
            streams.compact_rollup(spark, path, i - 1)
            assert totals() == before and begun.first().n == before[0][0]
            store(1)  # a batch that runs again
            streams.compact_rollup(spark, path, i - 1)  # and a compaction
            assert totals() == before
    whole = R.merge_rollup(R.rollup_hourly(flows)).agg(F.sum("flows"), F.sum("bytes"), F.count("*"), F.hll_sketch_estimate(F.hll_union_agg("subs"))).first()
    assert totals()[0] == tuple(whole)
    assert len(T.found(spark, f"{path}/generations/*")) == 2 and len(T.found(spark, f"{path}/hourly/batch_id=*")) <= 5
    T.found(spark, f"{path}/generations/*")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/generations/77/hourly")  # one that broke off
    assert totals()[0] == tuple(whole)


def test_a_search_goes_on_without_a_broken_archive(spark, sf_dir, tmp_path):
    from flowloom.operators import search as S

    flows = Fx.flow_logs(spark, sf_dir).cache()
    f = S.SearchFilter(device_id=3)
    base = f"{tmp_path}/cold"
    L.write_archive(flows, base)
    cold = lambda: T.read_cold(spark, base, 0, None)
    rows, took_part = S.search_all_or_hot(flows, cold, f)
    assert took_part and rows_of(rows) == rows_of(S.search_all(flows, cold(), f))
    hot = rows_of(S.search_all(flows, None, f))
    assert len(hot) > 0
    found, took_part = S.search_all_or_hot(flows, lambda: T.read_cold(spark, f"{tmp_path}/nowhere", 0, None), f)
    assert not took_part and rows_of(found) == hot
    for x in (tmp_path / "cold").glob("isp_id=*/*/*/*/part-*"):
        x.write_bytes(b"PAR1 not at all PAR1")
    found, took_part = S.search_all_or_hot(flows, cold, f)
    assert not took_part and rows_of(found) == hot


def test_a_sweep_exports_days_side_by_side(spark, sf_dir, tmp_path, monkeypatch):
    import threading

    T.write_flows(Fx.flow_logs(spark, sf_dir).filter("event_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'"), f"{tmp_path}/hot")
    met, whole = threading.Barrier(2), L.archive_day

    def met_first(df, day, *more):
        if day < "2024-01-04":
            met.wait(60)  # breaks, and the day is left, where days come one after the other
        return whole(df, day, *more)

    monkeypatch.setattr(L, "archive_day", met_first)
    rows = L.archive_sweep(spark, f"{tmp_path}/hot", spark.createDataFrame([], "day date"), f"{tmp_path}/cold", 7, "2024-01-30").collect()
    assert [(str(r.day), r.status) for r in rows] == [(f"2024-01-0{i}", "archived, dropped") for i in (2, 3, 4)]
    assert T.found(spark, f"{tmp_path}/hot/event_date=*") == []


def test_hot_files_hold_one_day_each_and_small_filters(spark, sf_dir, tmp_path):
    """However few files a day has, no task sorts more than one of them; a filter of 1 MB for each address was most of a file."""
    rows = Fx.flow_logs(spark, sf_dir).persist()
    T.write_flows(rows, f"{tmp_path}/hot", files=2)
    files = T.found(spark, f"{tmp_path}/hot/event_date=*/*/*.parquet")
    days = rows.select("event_date").distinct().count()
    assert days <= len(files) <= 2 * days
    assert T.read_flows(spark, f"{tmp_path}/hot").count() == rows.count()
    assert sum((tmp_path / f.split(str(tmp_path) + "/")[1]).stat().st_size for f in files) < 1_000_000 * len(files)
    rows.unpersist()
