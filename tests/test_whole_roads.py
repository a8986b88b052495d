"""Queries work on every row of their tables: held against brute force on small tables of their own."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom import catalog

QUERIES = catalog.queries()


def rows(spark, name, path):
    return [r.asDict() for r in QUERIES[name](spark, str(path)).collect()]


@pytest.fixture(scope="module")
def far_orders(spark, tmp_path_factory):
    """Orders in several blocks of the road lattice, far beyond the first, and a few customers."""
    path = tmp_path_factory.mktemp("orders")
    keys = [*range(40), *range(3990, 4030), *range(8000, 8040), *range(149_960, 150_000)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, 1.0, "A") for k in range(1, 3001)], "c_custkey bigint, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return path, keys


def _way(k):
    """(x, y) of both ends in thousandths of a degree."""
    b, i = divmod(k, 4000)
    s = math.isqrt(b)
    r = b - s * s
    x, y = min(r, s) * 40 + i % 40, min(2 * s - r, s) * 40 + i // 40 % 40
    east = i // 1600 % 2 == 0
    return (x, y), (x + east, y + (not east))


def _edges(keys):
    ident = lambda p: f"{770_000_000 + p[0] * 10_000},{285_000_000 + p[1] * 10_000}"
    out = set()
    for k in keys:
        if k // 7 % 4 == 2 or k % 11 == 0:
            continue
        a, b = map(ident, _way(k))
        if k % 9 == 0 or k % 10 != 0:
            out.add((a, b))
        if k % 9 != 0:
            out.add((b, a))
    return out


def test_roads_are_made_of_all_orders(spark, far_orders):
    path, keys = far_orders
    assert {(r["src"], r["dst"]) for r in rows(spark, "pipe7_graph", path)} == _edges(keys)
    assert {r["input_pos"] for r in rows(spark, "win6_labels", path)} == set(keys)
    assert sum(r["label"] != "" for r in rows(spark, "win6_labels", path)) == len({k % 50 for k in keys})
    assert {r["way_id"] for r in rows(spark, "fn23_phrase", path)} == {k for k in keys if k % 50 == 1}
    assert rows(spark, "agg15_coverage", path)[0]["source_ways"] == len(keys)


def test_points_snap_to_roads_of_all_orders(spark, far_orders):
    path, keys = far_orders
    nodes = {tuple(map(int, n.split(","))) for e in _edges(keys) for n in e}
    want = {}
    for k in range(1, 3001):
        lon, lat = 77.0 + k * 7919 % 20000 / 100000.0, 28.5 + k * 104729 % 15000 / 100000.0
        m = min(6371008.8 * math.hypot(math.radians(x / 1e7 - lon) * math.cos(math.radians((y / 1e7 + lat) / 2)), math.radians(y / 1e7 - lat)) for x, y in nodes)
        if m <= 250:
            want[k] = m
    got = {r["point_id"]: r["metres"] for r in rows(spark, "join10_snap", path)}
    assert got == pytest.approx(want, abs=1e-3)


def test_routes_reach_beyond_the_first_block(spark, tmp_path):
    keys = [k for k in range(4000, 8000)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in (1, 30)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [r["route_id"] for r in rows(spark, "pipe8_routes", tmp_path)] == [30]
