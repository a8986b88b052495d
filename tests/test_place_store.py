"""The place store in many small batches: merges, runs that are repeated, what a batch reads, nothing left behind."""

import math
import random
from pathlib import Path

import pytest

from geoloom.scratch import Scratch, stored, temporary
from geoloom.streaming import places as streaming

METRE = 1 / 111_320
SCHEMA = "place_id string, name string, normalized_name string, lon double, lat double, created_at long"


def rows_of(n, seed=3, metres=300):
    dice = random.Random(seed)
    return [(f"p{k:03d}", "n", f"block {k % 4}", 0.05 + (dice.random() - 0.5) * metres * METRE, 0.05 + (dice.random() - 0.5) * metres * METRE, k) for k in range(n)]


def plain(rows):
    canonical, want = [], {}
    for r in rows:
        if r[0] not in want:
            to = next((c for c in canonical if c[2] == r[2] and math.hypot((c[4] - r[4]) / METRE, (c[3] - r[3]) / METRE * math.cos(math.radians((c[4] + r[4]) / 2))) <= 35), None)
            want[r[0]] = to[0] if to else r[0]
            canonical += [] if to else [r]
    return want


def check(store, version, want):
    assert sorted(r.place_id for r in store.places(version).collect()) == sorted(a for a, b in want.items() if a == b)
    assert {r.place_id: r.canonical_id for r in store.aliases(version).collect()} == {a: b for a, b in want.items() if a != b}


def test_batches_at_a_corner_of_four_tiles_merged_and_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "MOST_VERSIONS", 2)
    rows = rows_of(90)
    store = streaming.PlaceStore(spark, str(tmp_path / "s"), 3)
    for k in range(5):
        store.add(spark.createDataFrame(rows[k * 18 : k * 18 + 18] + rows[:3], SCHEMA), k)
        if k in (2, 4):  # also of a batch that has merged the versions before it
            store.add(spark.createDataFrame(rows[k * 18 : k * 18 + 18] + rows[:3], SCHEMA), k)
    check(store, 4, plain(rows))
    folders = [p for p in (tmp_path / "s").rglob("version=*") if p.is_dir()]
    assert any("kind=base" in str(p) for p in folders) and not any(p.match("kind=delta/version=1") for p in folders)
    # A run that ended before it removed what it had merged: the older versions are there again, and don't count.
    base = next(p for p in folders if "kind=base" in str(p) and "places" in str(p))
    old = base.parent.parent / "kind=delta" / "version=0"
    old.mkdir(parents=True)
    for f in base.glob("*.parquet"):
        (old / f.name).write_bytes(f.read_bytes())
    check(store, 4, plain(rows))


def test_a_batch_reads_its_tiles_only(spark, tmp_path):
    far = [(f"f{k:04d}", "n", "far away", 1.0 + k * 0.2, 10.0, k) for k in range(30)]
    store = streaming.PlaceStore(spark, str(tmp_path / "s"))
    store.add(spark.createDataFrame(far, SCHEMA), 0)
    read = []
    plain_read = streaming.Bucketed.read

    def watched(self, version, buckets=None):
        out = plain_read(self, version, buckets)
        read.extend(f for f in out.inputFiles() if "/places/" in f)
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(streaming.Bucketed, "read", watched)
        store.add(spark.createDataFrame([("x", "n", "far away", 1.0001, 10.0, 99), ("y", "n", None, 3.0, 10.0, 99), ("z", "n", "z", None, None, 99)], SCHEMA), 1)
    assert len(set(read)) == 2
    assert {r.place_id: r.canonical_id for r in store.aliases(1).collect()} == {"x": "f0000"} and store.places(1).count() == 32
    store.add(spark.createDataFrame([("x", "n", "x", 5.0, 5.0, 1), ("z", "n", "z", 1.0, 1.0, 1)], SCHEMA), 2)
    assert store.places(2).count() == 32 and store.aliases(2).count() == 1


def test_what_an_owner_has_goes(spark):
    with temporary(spark):
        kept = stored(spark.range(10))
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        inner = Scratch(spark)
        inner.written(spark.range(5), "x")
        assert folder.exists() and Path(inner.path("x").removeprefix("file://")).exists()
    assert not folder.parent.exists() and not Path(inner.base.removeprefix("file://")).exists()
    assert stored(spark.range(3)).count() == 3


def test_a_stream(spark, tmp_path):
    rows = rows_of(60, 7)
    store = streaming.PlaceStore(spark, str(tmp_path / "s"))
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], SCHEMA).write.parquet(str(tmp_path / f"in/{k}"))
        streaming.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*")), store, str(tmp_path / "checkpoint")).awaitTermination()
    check(store, 2, plain(rows))
