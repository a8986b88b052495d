"""Tiles of extents against plain loops: boxes over the date line, spirals, levels, very large ones."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom.operators import coverage


def tile(lon, lat, z):
    n = 1 << z
    lat = math.radians(max(-85.0511, min(85.0511, lat)))
    return max(0, min(n - 1, math.floor((lon + 180) / 360 * n))), max(0, min(n - 1, math.floor((1 - math.asinh(math.tan(lat)) / math.pi) / 2 * n)))


def box(w, s, e, n, z):
    (x0, y0), (x1, y1) = tile(w, n, z), tile(e, s, z)
    span = e - w + 360 * (w > e)
    cx, cy = tile((w + span / 2 + 180) % 360 - 180, (s + n) / 2, z)
    x1, cx = x1 + (1 << z) * (w > e), cx + (1 << z) * (cx < x0)
    found = [(x, y) for x in range(x0, min(x1, x0 + (1 << z) - 1) + 1) for y in range(y0, y1 + 1)]
    found.sort(key=lambda t: ((t[0] - cx) ** 2 + (t[1] - cy) ** 2, *t))
    return [(x % (1 << z), y) for x, y in found]


def spiral(lon, lat, radius, z):
    cx, cy = tile(lon, lat, z)
    out = [(cx, cy)]
    for r in range(1, radius + 1):
        x, y = cx - r, cy - r
        for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)):
            for _ in range(2 * r):
                out.append((x, y))
                x, y = x + dx, y + dy
    return out


BOXES = [(1, 77.0, 28.5, 77.1, 28.6), (2, 179.9, -1.0, -179.9, 1.0), (3, 10.0, 10.0, 10.0, 10.0), (4, -180.0, -90.0, 180.0, 90.0), (5, 5.0, 2.0, 6.0, 1.0), (6, None, 0.0, 1.0, 1.0), (7, 0.0, 0.0, 30.0, 3.0), (8, 20.0, 80.0, 10.0, 90.0)]


@pytest.mark.parametrize("z", [0, 3, 5, 7])
def test_boxes(spark, z):
    df = spark.createDataFrame(BOXES, "k int, west double, south double, east double, north double")
    got = {}
    for r in coverage.box_tiles(df, "k", z).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
        assert r["rank"] == len(got[r.k])
    assert got == {k: box(w, s, e, n, z) for k, w, s, e, n in BOXES if w is not None and s <= n}


def test_rings_are_spirals(spark):
    rows = [(1, 77.1, 28.5, 0), (2, 77.1, 28.5, 4), (3, 179.999, 0.0, 2), (4, 0.0, 85.05, 2), (5, None, 1.0, 1), (6, 10.0, 10.0, -3)]
    df = spark.createDataFrame(rows, "k int, lon double, lat double, radius int")
    got = {}
    for r in coverage.ring_tiles(df, "k").orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got == {k: [(x % 16384, y) for x, y in spiral(lon, lat, max(r, 0), 14) if 0 <= y < 16384] for k, lon, lat, r in rows if lon is not None}


def test_a_million_tiles_are_no_row(spark):
    """All tiles of level ten: 32 parts a side at most in any row, and in many tasks."""
    world = spark.createDataFrame([(1, -180.0, -90.0, 180.0, 90.0)], "k int, west double, south double, east double, north double")
    tiles = coverage.box_tiles(world, "k", 10)
    r = tiles.agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("d"), F.max("rank").alias("last")).first()
    assert (r.n, r.d, r["last"]) == (1 << 20, 1 << 20, 1 << 20)
