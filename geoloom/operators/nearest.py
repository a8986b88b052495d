"""The nearest examples of a group, all of which count, however many there are.

Examples of a group lie in blocks along a curve through their coordinates, so that a block's box is small. A target
meets the nearest block first; the k-th distance there bounds what it still looks for, and it meets the
blocks whose boxes begin within that. No task holds a group's examples or targets, and no example is left out
but for being farther than k others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inputs import spread
from ..scratch import stored
from .crowds import numbered, split_keys

#: Examples of a block (of the last one, up to twice as many), and targets that are measured against them at once.
BLOCK, BATCH = 1024, 256
#: Bits of a coordinate along the curve.
BITS = 10


def blocked(examples: DataFrame, order: list[str], weights: tuple[float, ...]) -> DataFrame:
    """examples (tile, type, v1.., s1.., sample_size) with their block: places along a Z curve through the
    coordinates, types apart, in the widths that distances give them."""
    axes = range(1, len(weights) + 1)
    ends = examples.groupBy("tile").agg(*(f(f"v{i}").alias(f"_{f.__name__}{i}") for f in (F.min, F.max) for i in axes))
    metric = lambda i, x: (x - F.col(f"_min{i}")) * float(np.sqrt(weights[i - 1])) / F.col(f"s{i}")
    step = F.greatest(*(metric(i, F.col(f"_max{i}")) for i in axes)) / (2**BITS - 1)
    met = examples.join(ends, "tile").withColumn("_step", step)
    met = met.withColumns({f"_q{i}": F.when(F.col("_step") > 0, F.floor(metric(i, F.col(f"v{i}")) / F.col("_step"))).otherwise(0).cast("long") for i in axes})
    bits: list[Column] = [F.shiftleft(F.shiftright(f"_q{i}", b).bitwiseAND(1), b * len(weights) + i - 1) for b in range(BITS) for i in axes]
    coded = met.select(*examples.columns, reduce(Column.bitwiseOR, bits).alias("_code"))
    last = F.greatest(F.floor(F.col("sample_size") / BLOCK) - 1, F.lit(0))
    return numbered(coded, "tile", ["type", "_code", *order]).withColumn("block", F.least(F.floor(F.col("_i") / BLOCK), last)).drop("_i", "_code")


def _square(far: Callable, scale: np.ndarray, other: np.ndarray, weights: tuple[float, ...], penalty: float) -> np.ndarray:
    """Squared distances of targets and others: the penalty where `other` holds, and each axis' share, added in order."""
    out = np.where(other, penalty, 0.0)
    for i, w in enumerate(weights):
        d = far(i) / scale[i]
        out = out + w * (d * d)
    return out


def nearest(targets: DataFrame, examples: DataFrame, order: list[str], weights: tuple[float, ...], penalty: float, deal: Callable = split_keys) -> DataFrame:
    """targets (tile, id, type, prior, v1..) with sample_size and near, the k nearest examples of their tile as (d, e_height),
    equal distances by height. examples have tile, type, v1.., height, and their tile's k, sample_size and scales s1..;
    distances are roots of weighted squares, with a penalty where types differ. Examples that lack a coordinate are near nothing. Targets of a tile without examples
    drop out; those of a crowded tile or block are dealt over tasks by `deal`."""
    axes = [f"v{i}" for i in range(1, len(weights) + 1)]
    scales = [f"s{i}" for i in range(1, len(weights) + 1)]
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
    own = ["tile", "id", "type", "prior", *axes]
    declared = ", ".join(f"{c} {kinds[c]}" for c in own)

    def begins(t: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        """Squares that no example of a block is nearer than."""
        sets = [set(x) for x in b.types]
        codes, types = pd.factorize(t.type)
        other = np.array([[x not in s for s in sets] for x in types] or np.ones((1, len(b))), dtype=bool)
        other = np.where((codes < 0)[:, None], True, other[codes])
        at, low, high = t[axes].to_numpy(float), b[[f"low{i}" for i in axes]].to_numpy(float), b[[f"high{i}" for i in axes]].to_numpy(float)
        far = lambda i: np.maximum(np.maximum(low[None, :, i] - at[:, None, i], at[:, None, i] - high[None, :, i]), 0.0)
        return _square(far, b[scales].iloc[0].to_numpy(float), other, weights, penalty)

    def first_block(t: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = t[own].assign(block=pd.Series(dtype="int64"), bound=pd.Series(dtype=float)).iloc[:0]
        if not len(t) or not len(b):
            return none
        numbers, parts = b.block.to_numpy(), []
        for at in range(0, len(t), BATCH):
            some = t.iloc[at : at + BATCH]
            parts.append(some[own].assign(block=numbers[np.argmin(begins(some, b), axis=1)], bound=np.inf))
        return pd.concat(parts)

    def other_blocks(t: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = t[[*own, "block", "bound"]].iloc[:0]
        if not len(t) or not len(b):
            return none
        numbers, parts = b.block.to_numpy(), [none]
        for at in range(0, len(t), BATCH):
            some = t.iloc[at : at + BATCH]
            bound = some.bound.to_numpy(float)[:, None]
            # Boxes and distances are rounded alike but not equally, so a little more than the bound is looked at.
            row, col = np.nonzero((begins(some, b) <= bound * bound * (1 + 1e-9) + 1e-12) & (numbers[None, :] != some.block.to_numpy()[:, None]))
            if len(row):
                parts.append(some.iloc[row][[*own, "bound"]].assign(block=numbers[col])[none.columns])
        return pd.concat(parts)

    def measured(t: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = t[[*own, "block"]].iloc[:0].assign(bound=0.0, k=0, sample_size=0, d=None, e_height=None)
        if not len(t) or not len(x):
            return out
        k, scale, height = int(x.k.iloc[0]), x[scales].iloc[0].to_numpy(float), x.height.to_numpy(float)
        there, parts = x[axes].to_numpy(float), []
        codes, _ = pd.factorize(pd.concat([t.type, x.type]))
        mine, theirs = codes[: len(t)], codes[len(t) :]
        for at in range(0, len(t), BATCH):
            some, kind = t.iloc[at : at + BATCH], mine[at : at + BATCH]
            here, bound = some[axes].to_numpy(float), some.bound.to_numpy(float)
            other = (kind[:, None] != theirs[None, :]) | (kind < 0)[:, None]
            square = _square(lambda i: here[:, None, i] - there[None, :, i], scale, other, weights, penalty)  # noqa: B023
            most = np.minimum(np.partition(square, k - 1, axis=1)[:, k - 1], bound * bound) if len(x) >= k else bound * bound
            row, col = np.nonzero(square <= (most * (1 + 1e-9) + 1e-12)[:, None])
            d, h = np.sqrt(square[row, col]), height[col]
            turn = np.lexsort((h, d, row))
            row, d, h = row[turn], d[turn], h[turn]
            starts = np.searchsorted(row, np.arange(len(some) + 1))
            ends = np.minimum(starts[1:], starts[:-1] + k)
            found = some[[*own, "block"]].assign(k=k, sample_size=int(x.sample_size.iloc[0]))
            found["d"] = [d[a:z] for a, z in zip(starts[:-1], ends, strict=True)]
            found["e_height"] = [h[a:z] for a, z in zip(starts[:-1], ends, strict=True)]
            found["bound"] = [x[-1] if len(x) >= k else np.inf for x in found.d]
            parts.append(found[[len(x) > 0 for x in found.d]])
        return pd.concat(parts)[out.columns]

    met = f"{declared}, block long, bound double"
    some = f"{met}, k int, sample_size long, d array<double>, e_height array<double>"

    def together(one: DataFrame, other: DataFrame, keys: list[str], what: Callable, kind: str) -> DataFrame:
        one, other = deal(one, other, keys, by=F.xxhash64("id"), hint=None)
        keys = [*keys, "_split"]
        return spread(one, *keys).groupBy(*keys).cogroup(spread(other, *keys).groupBy(*keys)).applyInPandas(what, kind)

    zipped = F.arrays_zip("d", "e_height")
    examples = examples.where(reduce(Column.__and__, (F.col(v).isNotNull() & ~F.isnan(v) for v in axes)))
    largest = examples.agg(F.max("sample_size")).first()[0] or 0
    if largest < 2 * BLOCK:
        begun = targets.select(*own, F.lit(0).cast("long").alias("block"), F.lit(float("inf")).alias("bound"))
        found = together(begun, examples.withColumn("block", F.lit(0).cast("long")), ["tile", "block"], measured, some)
        return found.select(*own, "sample_size", zipped.alias("near"))
    examples = stored(blocked(examples, order, weights))
    boxes = examples.groupBy("tile", "block").agg(F.collect_set("type").alias("types"), *(F.first(s).alias(s) for s in scales), *(f(v).alias(f"{n}{v}") for v in axes for n, f in (("low", F.min), ("high", F.max))))
    boxes = stored(boxes)
    begun = stored(together(targets.select(*own), boxes, ["tile"], first_block, met))
    first = stored(together(begun, examples, ["tile", "block"], measured, some))
    further = stored(together(first.select(*own, "block", "bound"), boxes, ["tile"], other_blocks, met))
    more = together(further, examples, ["tile", "block"], measured, some)
    more = more.groupBy("tile", "id").agg(F.flatten(F.collect_list(zipped)).alias("more"))
    both = F.sort_array(F.concat(zipped, F.coalesce("more", F.array().cast("array<struct<d:double,e_height:double>>"))))
    return first.join(more.hint("merge"), ["tile", "id"], "left").select(*own, "sample_size", F.slice(both, F.lit(1), F.col("k")).alias("near"))
