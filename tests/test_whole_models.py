"""Heights are learned from all examples of a tile, not from some at a stride."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import buildings

TYPES = ("house", "office", "hotel")


def _rows(n, spread):
    pick = random.Random(7)
    return [(i, "t" if i % 9 else "u", f"s{i * 37 % n:05d}", TYPES[pick.randrange(3)], *(round(pick.gauss(0, spread), 1) for _ in range(6)), float(pick.randrange(3, 90)), 6.0) for i in range(n)]


def _brute(targets, examples):
    """id: estimate by the k nearest of all examples."""
    out = {}
    for tile in {t[1] for t in targets}:
        own = [x for x in examples if x[1] == tile]
        n = len(own)
        k = max(3, min(15, round(math.sqrt(n))))
        mean = [sum(x[c] for x in own) / n for c in range(4, 10)]
        s = [max(0.001, math.sqrt(sum((x[c] - m) ** 2 for x in own) / n)) for c, m in zip(range(4, 10), mean, strict=True)]
        for t in (t for t in targets if t[1] == tile):
            d = lambda x: math.sqrt((t[3] != x[3]) * buildings.TYPE_PENALTY + sum(w * ((t[c] - x[c]) / s[c - 4]) ** 2 for w, c in zip(buildings.VECTOR_WEIGHTS, range(4, 10), strict=True)))  # noqa: B023, E731
            near = sorted((round(d(x), 9), x[10]) for x in own)[:k]
            w = [1 / max(q, 0.05) ** 2 for q, _ in near]
            share = min(0.85, 0.35 + n / 120)
            out[t[0]] = max(3.0, sum(h * q for (_, h), q in zip(near, w, strict=True)) / sum(w) * share + t[11] * (1 - share))
    return out


def _run(spark, targets, examples):
    kind = "id long, tile string, source_id string, building_type string, v1 double, v2 double, v3 double, v4 double, v5 double, v6 double, height double, prior double"
    df = lambda rows: spark.createDataFrame(rows, kind)
    return {r.id: r.estimate for r in buildings.predicted(df(targets), df(examples)).collect()}


def test_examples_off_the_stride_count(spark):
    rows = _rows(900, 1.0)
    targets, examples = rows[:60], rows[60:]
    assert _run(spark, targets, examples) == pytest.approx(_brute(targets, examples), rel=1e-9)


@pytest.mark.parametrize("spread", [2.0, 0.05])
def test_examples_of_many_blocks_count(spark, monkeypatch, spread):
    """With blocks of 16 examples most of the 15 nearest lie in other blocks than the first; the smaller spread makes
    many distances equal."""
    from geoloom.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 16)
    rows = _rows(700, spread)
    targets, examples = rows[:80], rows[80:]
    assert _run(spark, targets, examples) == pytest.approx(_brute(targets, examples), rel=1e-9)


def test_blocks_far_off_are_not_met(spark):
    """Boxes tell blocks apart: two clusters are two sets of blocks."""
    from geoloom.operators import nearest

    scales = [F.lit(1.0).alias(f"s{i}") for i in range(1, 3)]
    rows = spark.range(4096).select("id", F.lit("t").alias("tile"), F.lit("x").alias("type"), (F.col("id") % 2 * 100 + F.col("id") % 37 / 37).alias("v1"), (F.col("id") % 41 / 41).alias("v2"), *scales, F.lit(4096).cast("long").alias("sample_size"))
    boxes = nearest.blocked(rows, ["id"], (1.0, 1.0)).groupBy("block").agg(F.count("*").alias("n"), (F.max("v1") - F.min("v1")).alias("wide")).collect()
    assert [b.n for b in boxes] == [1024] * 4 and all(b.wide <= 1 for b in boxes)
