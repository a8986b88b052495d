"""Distances over the overlay against Dijkstra: cells of many sizes, one-way streets, no way, legs in one cell."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import crowds, overlay, roads


def dijkstra(out_of, start):
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, n = heapq.heappop(queue)
        for m, w in out_of.get(n, ()):
            if d + w < best.get(m, math.inf):
                best[m] = d + w
                heapq.heappush(queue, (d + w, m))
    return best


def lattice(n, seed):
    """Streets of a town whose blocks differ: (src, dst, metres), some one way, some missing."""
    dice, name = random.Random(seed), lambda x, y: f"{770000000 + x * 30000},{285000000 + y * 30000}"
    edges = []
    for x in range(n):
        for y in range(n):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < n and y + dy < n and dice.random() < 0.85:
                    a, b, w = name(x, y), name(x + dx, y + dy), 334 * dice.uniform(1, 3)
                    edges += [(a, b, w)] * (dice.random() < 0.9) + [(b, a, w)] * (dice.random() < 0.9)
    return edges, [name(x, y) for x in range(n) for y in range(n)]


@pytest.mark.parametrize("n,most,place", [(16, 5_000, True), (16, 10, False)])
def test_as_dijkstra(spark, monkeypatch, n, most, place):
    monkeypatch.setattr(crowds, "MOST_ROWS", most)
    monkeypatch.setattr(overlay, "SOURCES_AT_ONCE", most)
    edges, names = lattice(n, 3)
    out_of = {}
    for a, b, w in edges:
        out_of.setdefault(a, []).append((b, w))
    dice = random.Random(5)
    pairs = [(dice.choice(names), dice.choice(names)) for _ in range(60)] + [(names[0], names[-1])] * 20 + [(names[5], names[5]), ("1,1", "1,1"), ("1,1", names[3]), (names[3], "1,1")]
    nodes = {x for a, b, _ in edges for x in (a, b)}
    want = {k: dijkstra(out_of, a).get(b) for k, (a, b) in enumerate(pairs) if a in nodes and b in nodes}
    legs = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "leg_id int, start string, goal string")
    net = overlay.overlay(spark.createDataFrame(edges, "src string, dst string, metres double"), roads.grid_cell)
    got = {r.leg_id: r.metres for r in overlay.distances(net, legs, roads.grid_place if place else None).collect()}
    assert got == pytest.approx({k: d for k, d in want.items() if d is not None})
    assert len(got) > 70 and net.hops.count() > 100


def test_one_cell_and_no_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, metres double")
    legs = spark.createDataFrame([(1, "a", "c"), (2, "c", "a"), (3, "b", "b")], "leg_id int, start string, goal string")
    one = overlay.overlay(edges, lambda node: F.lit("x"))
    assert {r.leg_id: r.metres for r in overlay.distances(one, legs).collect()} == {1: 3.0, 3: 0.0}
    own = overlay.overlay(edges, lambda node: node)  # each node a cell of its own
    assert {r.leg_id: r.metres for r in overlay.distances(own, legs).collect()} == {1: 3.0, 3: 0.0}
    assert overlay.distances(overlay.overlay(edges.where("false"), lambda node: node), legs).count() == 0
    assert overlay.distances(one, legs.where("false")).count() == 0
