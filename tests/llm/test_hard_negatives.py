"""Hard negatives against brute force, on ties, copies, few rows, odd vectors and numbers beyond doubles."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import hard_negatives, queries

from ..oracle import TABLES, same

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, mining=hard_negatives.Mining(), shift=True):
    """rows (id, vector, label), ids unique"""
    kept = []
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((k, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if shift and k % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, v, label in kept:
        if k % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, w, other in kept if j != k)
        for p, j, _ in [s for s in scored if s[2] == label][: mining.positives]:
            fit = [(-s, i) for s, i, other in scored if other != label and mining.low * -p <= 100 * -s <= mining.high * -p]
            out += [(k, j, r, i, -p, s) for r, (s, i) in enumerate(fit[: mining.negatives], 1)]
    return sorted(out)


def folder(spark, rows, tmp_path):
    for t in TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.createDataFrame([(k, v and [None if x is None else float(x) for x in v], c) for k, v, c in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def groups(n, dims=6, seed=3, centres=9):
    """Vectors around some centres, some of them copies, half of the rows one vector."""
    dice = np.random.default_rng(seed)
    middle = dice.normal(size=(centres, dims))
    out = []
    for k in range(n):
        v = middle[0] if k % 2 else middle[dice.integers(centres)] + 0.2 * dice.normal(size=dims)
        out.append((k, [float(np.float32(x)) for x in v], int(dice.integers(4))))
    return out


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (2, 3), (2, 5)])
def test_the_curve_visits_all_cells_by_single_steps(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = np.argsort([int.from_bytes(p.tobytes()) for p in hard_negatives.hilbert(cells, bits)])
    assert len({p.tobytes() for p in hard_negatives.hilbert(cells, bits)}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("small", [False, True])
def test_as_brute_force(spark, tmp_path, monkeypatch, small):
    """Also with blocks of few rows, zone maps that meet by a join, and several pieces."""
    rows = [*groups(900), (1000, None, 1), (1001, [1.0, None, 0, 0, 0, 0], 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf"), 0, 0, 0, 0, 0], 2), (1004, [1.0] * 6, None), (None, [1.0] * 6, 1), (2000, [0.0] * 6, 3), (2100, [], 3), (2200, [3.0], 3), (2300, [1e3] * 6, 9)]
    if small:
        for name, value in {"BLOCK_ROWS": 20, "PART_BLOCKS": 4, "PIECE": 3, "ZONES": 5, "BROADCAST_BYTES": 0, "BLOCKS_A_SALT": 4}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    got = queries.queries()["op12_hard_negatives"](spark, folder(spark, rows, tmp_path))
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_sql(spark, tmp_path):
    same(queries.queries()["op12_hard_negatives"], queries.oracle_sql()["op12_hard_negatives"], spark, folder(spark, groups(600, 8, 4), tmp_path))


def test_other_settings_repeated_keys_and_clashing_names(spark):
    rows = groups(300, 3, 7)
    mining = hard_negatives.Mining(2, 3, 50, 120)
    df = spark.createDataFrame([*rows, *rows[:50], (7, [9.0, 9.0, 9.0], 9)], SCHEMA).withColumns({"key": F.lit("x"), "v": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    got = hard_negatives.mined(hard_negatives.scaled(df), F.col("key") % 10 == 0, mining).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10, mining, shift=False) and got


def test_numbers_beyond_doubles(spark):
    rows = [(k, [float(np.float32(1e12 + k * 1e6)), float(k), -1e12], k % 3) for k in range(40)]
    got = hard_negatives.mined(hard_negatives.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), F.col("key") % 10 == 0).collect()
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    ints = [(k, [math.floor(256 * x) for x in v], c) for k, v, c in rows]
    for r in got:
        a, p, n = ints[r.anchor_id], ints[r.positive_id], ints[r.negative_id]
        assert clip(sum(x * y for x, y in zip(a[1], p[1], strict=True))) == r.positive_score and clip(sum(x * y for x, y in zip(a[1], n[1], strict=True))) == r.negative_score
        assert a[2] == p[2] != n[2]
    assert got


def test_fewer_blocks_are_read_where_vectors_lie_together(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    dice = np.random.default_rng(1)
    middle = 4 * dice.normal(size=(20, 4))
    rows = [(k, (middle[k % 20] + 0.05 * dice.normal(size=4)).tolist(), k % 20 // 4) for k in range(4000)]
    mining = hard_negatives.Mining()
    blocks = hard_negatives.written_blocks(hard_negatives.scaled(spark.createDataFrame(rows, SCHEMA)), F.col("key") % 100 == 0)
    pieces = blocks.scratch.written(hard_negatives.gathered(blocks, mining), "pieces")
    pairs = hard_negatives.chosen(blocks, pieces, mining, False).collect()
    read = sum(bin(int.from_bytes(p.places)).count("1") for p in pairs)
    assert read < 0.3 * 40 * blocks.n
    assert sorted(map(tuple, hard_negatives.mined(hard_negatives.scaled(spark.createDataFrame(rows, SCHEMA)), F.col("key") % 100 == 0).collect())) == plain(rows, shift=False)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    got = queries.queries()["op12_hard_negatives"](spark, folder(spark, rows, tmp_path))
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
