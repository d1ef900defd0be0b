"""Every registered flow-log query against its SQL, or, without one, that it gives rows."""

import pytest

from flowloom.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_approximate_distinct_is_near_the_exact_one(spark, sf_dir):
    from flowloom.operators import aggregates as A
    from flowloom.operators import rollup as R
    from flowloom.plans.fixtures import AS_OF, flow_logs

    rows = flow_logs(spark, sf_dir)
    exact = A.dashboard_scalars(rows, 0, 7, AS_OF).first()
    for near in (A.dashboard_scalars(rows, 0, 7, AS_OF, exact=False).first(), R.scalars(R.rollup_hourly(rows), 0, 7, AS_OF).first()):
        assert abs(near["subscribers"] - exact["subscribers"]) <= 0.05 * exact["subscribers"]
        assert near["devices"] == exact["devices"] or abs(near["devices"] - exact["devices"]) <= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
