"""Canonical places against the plain greedy choice: long chains, crowds, copies, names that go on, rounds."""

import math
import random

import pytest

from geoloom.functions.columns import LOCALITY_WORDS
from geoloom.operators import crowds, graphs, places

METRE = 1 / 111_320
SCHEMA = "place_id string, normalized_name string, lon double, lat double, created_at long"


def says_the_same(a, b):
    short, long = sorted((a, b), key=len)
    return a == b or (len(short.split()) >= 2 and long.startswith(short + " ") and long[len(short) + 1 :].split()[0] in LOCALITY_WORDS)


def plain(rows):
    canonical, want = [], {}
    for ident, name, lon, lat, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        far = lambda c: math.hypot((c[3] - lat) / METRE, (c[2] - lon) / METRE * math.cos(math.radians((c[3] + lat) / 2)))  # noqa: B023, E731
        to = None
        if None not in (name, lon, lat):
            to = next((c for c in canonical if abs(c[3] - lat) < 36 * METRE and says_the_same(c[1], name) and far(c) <= 35), None)
            if to is None:
                canonical.append((ident, name, lon, lat))
        want[ident] = to[0] if to else ident
    return want


def got(spark, rows, **kw):
    found = places.canonical_places(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(found) == len({r.place_id for r in found})
    return {r.place_id: r.canonical_id for r in found}


NAMES = ["green park", "green park society", "green park society colony", "green park gate", "green", "green society", "park house", "park  house", "house", "enclave colony", "a b enclave", "a b enclave housing x", "a b"]


def crowd(n, seed, lat=28.5, metres=250):
    dice = random.Random(seed)
    return [(f"p{k:05d}", dice.choice(NAMES), 77 + dice.random() * metres * METRE / math.cos(math.radians(lat)), lat + dice.random() * metres * METRE, dice.randrange(40)) for k in range(n)]


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    """Each place matches the next one only; the rounds that connect them grow as a logarithm."""
    monkeypatch.setattr(graphs, "ONE_TASK", 0)
    monkeypatch.setattr(places, "connected", lambda edges, scratch: graphs.connected(edges, scratch, 20))
    rows = [(f"c{k:05d}", "green park", 0.0, k * 30 * METRE, k) for k in range(10_000)]
    assert got(spark, rows) == {f"c{k:05d}": f"c{k - k % 2:05d}" for k in range(10_000)}


@pytest.mark.parametrize("lat", [0.0, 28.5, 68.0, -45.0])
def test_crowds(spark, lat):
    rows = crowd(700, 3, lat)
    want = plain(rows)
    assert got(spark, rows) == want and 0.1 < len(set(want.values())) / len(rows) < 0.9


def test_copies_and_rows_without_a_place(spark, monkeypatch):
    monkeypatch.setattr(crowds, "MOST_ROWS", 20)
    rows = crowd(150, 5)
    rows += [(f"q{k:04d}", *rows[k % 3][1:4], k % 50) for k in range(300)] + [("n1", None, 77.0, 28.5, 1), ("n2", "green park", None, 28.5, 1), ("n3", "green park", 77.0, None, 1)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == {}


def test_large_groups_by_rounds(spark, monkeypatch):
    """The exact way for groups beyond one task gives the same rows."""
    rows = crowd(250, 9)
    want = plain(rows)
    monkeypatch.setattr(places, "GROUP_PLACES", 30)
    assert got(spark, rows, max_latitude=40) == want


def test_components_in_one_task_and_in_rounds(spark, tmp_path, monkeypatch):
    from geoloom.scratch import Scratch

    dice = random.Random(2)
    pairs = [(dice.randrange(400), dice.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {}
    for a, b in pairs * 400:
        if a != b:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    for most in (100_000, 0):
        monkeypatch.setattr(graphs, "ONE_TASK", most)
        assert {r.node: r.root for r in graphs.connected(edges, Scratch(spark)).collect()} == root
        assert graphs.connected(edges.where("a = b"), Scratch(spark)).count() == 0


def test_groups_go_by_in_batches(spark, monkeypatch):
    """Many groups a batch, groups over the ends of batches, the same canonical places; no task a group."""
    rows = [(f"p{k:04d}", f"block {k // 4}", 77.0 + (k // 4) * 0.01 + k % 4 * 0.0002, 28.5, k) for k in range(400)]
    p = spark.createDataFrame(rows, "place_id string, normalized_name string, lon double, lat double, created_at long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = []
        run = type(p).mapInPandas
        monkeypatch.setattr(type(p), "mapInPandas", lambda self, *a, **k: made.append(a) or run(self, *a, **k))
        got = {r.place_id: r.canonical_id for r in places.canonical_places(p).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    # 0.0002 degrees of longitude are some 20 m: the third and fourth place of a block are apart from the first.
    assert got == {f"p{k:04d}": f"p{k - k % 2:04d}" for k in range(400)} and len(made) == 1
