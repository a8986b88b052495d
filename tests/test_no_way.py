"""Legs that have no way end early, and legs are settled in regions around them where that is certain."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import overlay, roads
from geoloom.scratch import Scratch
from tests.test_overlay import dijkstra, lattice

KIND, LEG = "src string, dst string, metres double", "leg_id int, start string, goal string"


def test_a_pocket_ends_the_search(spark, monkeypatch):
    """The goal is reached from four nodes only; the start reaches sixty."""
    line = [(f"a{i:02}", f"a{i + 1:02}", 1.0) for i in range(60)]
    out = [(f"g{i}", f"g{i + 1}", 1.0) for i in range(5)] + [("g5", "a00", 1.0)]
    edges = spark.createDataFrame(line + [(b, a, m) for a, b, m in line] + out, KIND)
    legs = spark.createDataFrame([(1, "a00", "g4"), (2, "g0", "g4"), (3, "g0", "a06")], LEG)
    names, old = [], Scratch.written
    monkeypatch.setattr(Scratch, "written", lambda self, df, name: (names.append(name), old(self, df, name))[1])
    got = {r.leg_id: r.metres for r in overlay.distances(overlay.overlay(edges, lambda node: node), legs).collect()}
    assert got == {2: 4.0, 3: 12.0}
    assert sum(n.startswith("state-") for n in names) < 20


def test_regions_are_as_dijkstra(spark, monkeypatch):
    monkeypatch.setattr(overlay, "LEGS_AT_ONCE", 7)
    edges, names = lattice(40, 3)
    nodes = {x for a, b, _ in edges for x in (a, b)}
    dead = names[41]
    edges = [e for e in edges if e[1] != dead]  # nothing leads there
    out_of = {}
    for a, b, w in edges:
        out_of.setdefault(a, []).append((b, w))
    dice, near = random.Random(5), lambda n: min(len(names) - 1, n + dice.randrange(0, 6) * 40 + dice.randrange(0, 6))
    pairs = [(names[n], names[near(n)]) for n in (dice.randrange(1600) for _ in range(80))] + [(names[0], names[-1]), (names[3], dead), (names[5], names[5]), ("1,1", "1,1"), ("1,1", names[3])]
    want = [dijkstra(out_of, a).get(b) if a in nodes else None for a, b in pairs]
    legs = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], LEG)
    rows = {r.leg_id: r for r in overlay.nearby(spark.createDataFrame(edges, KIND), legs, roads.grid_place).collect()}
    assert len(rows) == len(pairs)
    for k, w in enumerate(want):
        if rows[k].sure:
            assert rows[k].metres is None if w is None else rows[k].metres == pytest.approx(w)
        elif rows[k].metres is not None:
            assert rows[k].metres >= w - 1e-6
    sure = [k for k, r in rows.items() if r.sure]
    assert len(sure) > 70 and {81, 82, 83} <= set(sure) and 80 not in sure
    assert any(r.metres is None for r in rows.values() if r.sure)


def test_a_known_way_is_kept_or_bettered(spark):
    line = [(f"a{i:02}", f"a{i + 1:02}", 1.0) for i in range(9)]
    net = overlay.overlay(spark.createDataFrame(line, KIND), lambda node: node)
    legs = spark.createDataFrame([(1, "a00", "a04", 7.0), (2, "a00", "a09", None), (3, "a05", "a04", None), (4, "a00", "a02", 2.0)], LEG + ", metres double")
    assert {r.leg_id: r.metres for r in overlay.distances(net, legs).collect()} == {1: 4.0, 2: 9.0, 4: 2.0}
    assert overlay.distances(net, legs.where(F.lit(False))).count() == 0
