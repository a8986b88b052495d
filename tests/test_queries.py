"""Every query with SQL gives its rows on the smallest tables; the others give rows."""

import pytest

from geoloom import catalog

from .oracle import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    same(QUERIES[name], SQL[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_neighbour_joins_are_not_nested_loops(spark, small):
    from geoloom.plans.buildings import join1_neighbours

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join1_neighbours(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
