"""Reasons for which polygons are rejected, one after the other."""

import random

import pytest

from geoloom.functions.geometry import PARTS
from geoloom.operators import surfaces


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


OUT = box(0, 0, 10, 10)
CASES = {
    "plain": ([[OUT]], None),
    "two holes": ([[OUT, box(1, 1, 2, 2), box(3, 3, 4, 4)]], None),
    "nested holes": ([[OUT, box(1, 1, 8, 8), box(2, 2, 4, 4)]], "nested holes"),
    "nested the other way": ([[OUT, box(2, 2, 4, 4), box(1, 1, 8, 8)]], "nested holes"),
    "nested in one of many": ([[OUT, *(box(k, 1, k + 0.5, 2) for k in range(1, 8)), box(5.1, 1.1, 5.2, 1.2)]], "nested holes"),
    "equal holes": ([[OUT, box(1, 1, 2, 2), box(1, 1, 2, 2)]], "rings meet"),
    "overlapping holes": ([[OUT, box(1, 1, 5, 5), box(4, 4, 8, 8)]], "rings meet"),
    "holes that touch": ([[OUT, box(1, 1, 2, 2), box(2, 2, 3, 3)]], "rings meet"),
    "hole outside": ([[OUT, box(11, 11, 12, 12)]], "hole outside"),
    "hole through the exterior": ([[OUT, box(5, 5, 15, 7)]], "rings meet"),
    "hole round the exterior": ([[OUT, box(-1, -1, 11, 11)]], "hole outside"),
    "parts that touch": ([[OUT], [box(10, 0, 20, 10)]], None),
    "parts one in the other": ([[OUT], [box(1, 1, 2, 2)]], None),
    "hole in the second part": ([[OUT], [box(20, 0, 30, 10), box(1, 1, 2, 2)]], "hole outside"),
    "bow tie": ([[[(0, 0), (2, 2), (2, 0), (0, 3), (0, 0)]]], "edges meet"),
    "bow tie in a hole": ([[OUT, [(1, 1), (2, 2), (2, 1), (1, 2.5), (1, 1)]]], "edges meet"),
    "spike": ([[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]], "edges meet"),
    "open": ([[[(0, 0), (1, 0), (1, 1), (0, 1)]]], "open ring"),
    "three": ([[[(0, 0), (1, 0), (0, 0)]]], "vertices"),
    "flat": ([[[(0, 0), (1, 0), (2, 0), (0, 0)]]], "no area"),
    "range": ([[box(0, 0, 1, 91)]], "coordinates"),
    "over the antimeridian": ([[[(179, 0), (-179, 0), (-179, 2), (179, 2), (179, 0)], [(179.5, 0.5), (-179.5, 0.5), (-179.5, 1), (179.5, 1), (179.5, 0.5)]]], None),
    "hole beyond the antimeridian": ([[[(179, 0), (-179, 0), (-179, 2), (179, 2), (179, 0)], box(-179.8, 0.5, -179.5, 1), box(-178.9, 0.5, -178.5, 1)]], "hole outside"),
    "nested beyond the antimeridian": ([[[(170, 0), (-170, 0), (-170, 9), (170, 9), (170, 0)], box(-179, 1, -172, 8), box(-178, 2, -177, 3)]], "nested holes"),
    "round the globe": ([[[(-170, 0), (-60, 0), (60, 5), (170, 0), (-170, 0)]]], "round the globe"),
    "no part": ([], None),
}


def test_reasons(spark):
    rows = [(k, [[[{"lon": float(x), "lat": float(y)} for x, y in r] for r in p] for p in parts]) for k, (parts, _) in CASES.items()]
    good, bad = surfaces.validated(spark.createDataFrame(rows, f"feature_id string, parts {PARTS}"))
    assert {r.feature_id: r.reason for r in bad.collect()} == {k: w for k, (_, w) in CASES.items() if w}
    assert {r.feature_id for r in good.collect()} == {k for k, (_, w) in CASES.items() if not w} and good.columns == ["feature_id", "parts"]


@pytest.mark.parametrize("nested", [False, True])
def test_many_holes(spark, nested):
    """A lattice of holes, the last of which may lie in another one."""
    dice = random.Random(3)
    holes = [box(x + 0.1, y + 0.1, x + 0.5 + dice.random() / 3, y + 0.6) for x in range(40) for y in range(40)]
    holes += [box(20.2, 20.2, 20.3, 20.3)] * nested
    parts = [[box(-1, -1, 41, 41), *holes]]
    rows = [(1, [[[{"lon": float(x), "lat": float(y)} for x, y in r] for r in p] for p in parts])]
    _, bad = surfaces.validated(spark.createDataFrame(rows, f"feature_id int, parts {PARTS}"))
    assert [r.reason for r in bad.collect()] == ["nested holes"] * nested


def test_small_features_are_seen_in_their_rows(spark, small, monkeypatch):
    """Without a lattice the same reasons; the lattice isn't even built."""
    from geoloom.plans.surfaces import fil10_valid

    monkeypatch.setattr(surfaces, "_ranked", lambda *a: pytest.fail("a lattice for small features"))
    in_rows = sorted(map(tuple, fil10_valid(spark, small).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(surfaces, "ROW_EDGES", 0)
    assert in_rows and in_rows == sorted(map(tuple, fil10_valid(spark, small).collect()))
