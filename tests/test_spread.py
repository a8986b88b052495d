"""Rows of small files are dealt over tasks, and no grown table goes through the driver."""

import pytest

from geoloom import catalog

QUERIES = catalog.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fn11_metrics", "fn13_representatives", "fil5_meets_box", "fn18_rings", "fn16_circle"])
def test_rows_are_dealt_before_work(spark, small, name):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["join1_neighbours", "join2_reference", "join12_in_polygon", "join12_polygons"])
def test_joins_over_cells_send_nothing_through_the_driver(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan


def test_targets_of_a_crowded_tile_are_dealt(spark, monkeypatch):
    """One tile of 600 targets: with splits of 50 no task measures all of them, and the estimates are the same."""
    from pyspark.sql import functions as F

    from geoloom.operators import buildings, crowds

    seen = []
    split = crowds.split_keys

    def watched(*args, **kwargs):
        one, other = split(*args, **kwargs)
        seen.append(one.select("_split").distinct().count())
        return one, other

    v = [((F.col("id") * (i + 3)) % 17 / 3.0).alias(f"v{i}") for i in range(1, 7)]
    rows = spark.range(640).select("id", F.lit("t").alias("tile"), F.format_string("s%04d", "id").alias("source_id"), F.lit("house").alias("building_type"), *v, (F.col("id") % 30 + 3.0).alias("height"), F.lit(6.0).alias("prior"))
    run = lambda: {r.id: r.estimate for r in buildings.predicted(rows.where("id >= 40"), rows.where("id < 40")).collect()}
    whole = run()
    monkeypatch.setattr(crowds, "MOST_ROWS", 50)
    monkeypatch.setattr(buildings, "split_keys", watched)
    assert run() == whole and len(whole) == 600
    assert seen[-1] > 6


def test_relations_are_stitched_in_batches(spark):
    from geoloom.sources.readers import assembled_rings

    a, b, c = ({"lon": x, "lat": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)))
    rows = [(1, 2, "outer", [a, c]), (1, 1, "outer", [a, b, c]), (2, 1, "inner", [a, b, c, a]), (3, 1, None, [a, b, c, a]), (3, 2, "inner", [a, b, c, a])]
    out = assembled_rings(spark.createDataFrame(rows, "relation_id long, pos int, role string, path array<struct<lon:double,lat:double>>"))
    plan = _plan(out)
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    assert {r.relation_id: [len(p) for p in r.parts] for r in out.collect()} == {1: [1], 3: [2]}
