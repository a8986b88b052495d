"""Hard negatives for anchors: zone maps over blocks of candidates in Hilbert order choose what is read.

1. Blocks: vectors (scaled and floored to integers) get their place on a Hilbert curve over all dimensions,
   are dealt by ranges of (place, key), and written as Parquet in that order, a row for each block of
   BLOCK_ROWS vectors and a folder for each part, with the least and the most of each dimension, the labels
   and the least key: the zone map.
2. Anchors are gathered from the blocks in the same order, PIECE to a row. Those near each other share a row,
   and with it most of the blocks that they must read. Their own block gives a first bound for the positives.
3. Choice: a dimension's interval times the anchor's component is an interval; their sum bounds the scores of
   all rows of a block from both sides. A block is read for an anchor's positives if it has the label and may
   reach the bound, for its negatives if it has another label and its interval meets a window of a positive.
   Only folders with a chosen block are read.
4. Scores: each (piece, block) that was chosen is one row of a join, its scores one product of two bounded
   matrices. A task hands on the first few of each anchor and window; a rank over those of all blocks follows.

A search of all rows is thus done in blocks, with anchors in pieces: nothing depends on how many rows have a
label or lie at one place (equal places are dealt by key), and no task or driver holds all anchors, blocks or
zone maps. In many dimensions without structure intervals are wide and most blocks are read: the bounds save
work only where vectors lie together.

Scores are exact integers: products are done in doubles while every sum fits in 53 bits, in whole numbers
beyond, and scores beyond a long count as the largest or smallest one. Jobs set the session's
`spark.sql.execution.arrow.maxRecordsPerBatch` while they run, as rows are blocks, and put it back.

Defined results: rows with a null key, a null label, a null vector or a component that is null or not finite
take no part; rows that repeat a key count once, the one with the smallest label, then vector; missing
components of shorter vectors count as 0; higher scores come first, ties by smaller key; an anchor without
positives, or a positive without negatives in its window, gives no row (a window below a negative score is
empty); an empty table gives none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

BLOCK_ROWS, PART_BLOCKS, PIECE, ZONES = 1024, 64, 512, 1024
#: Rows of blocks (some 200 kB each) that a task holds at once.
BATCH = 32
#: Zone maps of up to so many bytes are broadcast to the anchors; beyond, both meet by a join.
BROADCAST_BYTES = 32 << 20
#: A piece meets its blocks in so many of them at a time.
BLOCKS_A_SALT = 512
_NONE = -(2**63) + 1


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the window of a negative's score in hundredths of its positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (n x dimensions, below 2**bits) on a Hilbert curve, as packed bits: by
    bit planes, each axis is flipped or exchanged with the first, then Gray codes give the order."""
    x = cells.astype(np.uint32).copy()
    n, dims = x.shape
    for plane in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << plane), np.uint32((1 << plane) - 1)
        for i in range(dims):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, np.uint32(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(flip, p, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint32)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> np.uint32(plane)) & 1, np.uint32((1 << plane) - 1), np.uint32(0))
    x ^= turn[:, None]
    planes = [(x >> np.uint32(plane)) & 1 for plane in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """n x dims, shorter lists filled with 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scaled(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(key, label, v): the rows that take part, once for each key, with floor(scale * component)."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    one = rows.select("key", F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).alias("row"))
    return one.groupBy("key").agg(F.min("row").alias("row")).select("key", "row.label", "row.v")


@dataclass(frozen=True)
class Blocks:
    """table: the blocks as written; dims: the vectors' dimensions; kind: the type of their components there;
    exact: whether doubles hold every score; parts: the folders; n: the blocks."""

    table: DataFrame
    scratch: Scratch
    dims: int
    kind: str
    exact: bool
    parts: int
    n: int


_BLOCK = "block long, min_key long, labels array<long>, lo array<long>, hi array<long>, keys binary, own binary, anchors binary, vectors binary, part int"


def written_blocks(rows: DataFrame, anchor: Column) -> Blocks | None:
    """rows (key, label, v) as blocks in the order of the curve; `anchor` marks anchors. None without rows."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = scratch.written(rows.select("*", F.coalesce(anchor, F.lit(False)).alias("anchor")), "rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    if not size.n:
        return None
    dims, lo, hi = max(1, size.dims), min(0, size.lo or 0), max(0, size.hi or 0)
    most = max(-lo, hi)
    kind = next(k for k in ("i2", "i4", "i8") if most <= np.iinfo(k).max)
    bits = min(16, max(2, -(-128 // dims)))
    width = (hi - lo + 1) / (1 << bits)

    def place(v: pd.Series) -> pd.Series:
        x = _matrix(pa.array(v, pa.list_(pa.int64())), dims)
        cells = np.clip((x.astype(float) - lo) / width, 0, (1 << bits) - 1)
        return pd.Series([p.tobytes() for p in hilbert(cells, bits)], dtype=object)

    parts = max(1, -(-size.n // (BLOCK_ROWS * PART_BLOCKS)), min(size.n // BLOCK_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    curve = scratch.written(rows.withColumn("curve", F.pandas_udf(place, "binary")("v")), "curve")
    dealt = curve.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key").select("key", "label", "anchor", "v", F.spark_partition_id().alias("part"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        number = 0

        def block(t: pa.Table) -> pa.RecordBatch:
            part, keys, own = t["part"][0].as_py(), t["key"].to_numpy(), t["label"].to_numpy()
            v = _matrix(t["v"], dims)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": part << 32 | number, "min_key": int(keys.min()), "labels": np.unique(own).tolist(), "lo": v.min(axis=0).tolist(), "hi": v.max(axis=0).tolist(), "keys": keys.astype("<i8").tobytes(),
                        "own": own.astype("<i8").tobytes(), "anchors": np.packbits(np.asarray(t["anchor"])).tobytes(), "vectors": v.astype("<" + kind).tobytes(), "part": part,
                    }
                ],
                schema=schema,
            )

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= BLOCK_ROWS:
                whole = pa.concat_tables(held)
                yield block(whole.slice(0, BLOCK_ROWS).combine_chunks())
                held, number = [whole.slice(BLOCK_ROWS)], number + 1
        if held and sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held).combine_chunks())

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("min_key", pa.int64()), ("labels", longs), ("lo", longs), ("hi", longs), ("keys", pa.binary()), ("own", pa.binary()), ("anchors", pa.binary()), ("vectors", pa.binary()), ("part", pa.int32())])
    blocks = dealt.mapInArrow(packed, _BLOCK)
    blocks.write.partitionBy("part").parquet(scratch.path("blocks"))
    scratch.remove("rows", "curve")
    blocks = spark.read.schema(blocks.schema).parquet(scratch.path("blocks"))
    return Blocks(blocks, scratch, dims, kind, most * most * dims < 1 << 52, parts, blocks.select("block").count())


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of a with those of b, as longs."""
    if exact:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda s: max(_NONE, min(-_NONE, s)), otypes=[np.int64])(whole) if whole.size else np.zeros(whole.shape, np.int64)


def _first(rows: np.ndarray, keys: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries that are among the first n of their row, in order, and their ranks from 0."""
    order = np.lexsort((keys, -scores, rows))
    at = np.arange(len(order))
    new = np.r_[True, rows[order][1:] != rows[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = at - np.maximum.accumulate(np.where(new, at, 0)) if len(order) else at
    return order[rank < n], rank[rank < n]


_PIECE = "piece long, keys binary, own binary, vectors binary, least binary"


def gathered(blocks: Blocks, mining: Mining) -> DataFrame:
    """The anchors, PIECE to a row, in the order of the blocks; least: what the last of the positives in an
    anchor's own block scores, or the least long if there are fewer."""
    kind, exact, dims = "<" + blocks.kind, blocks.exact, blocks.dims
    schema = pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("keys", "own", "vectors", "least"))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def piece(n: int) -> pa.RecordBatch:
            keys, own, v, least = (np.concatenate(c) for c in zip(*held, strict=True))
            held[:] = [(keys[n:], own[n:], v[n:], least[n:])]
            row = {"piece": int(keys[0]), "keys": keys[:n].tobytes(), "own": own[:n].tobytes(), "vectors": v[:n].tobytes(), "least": least[:n].tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for b in batch.to_pylist():
                keys, own, v = np.frombuffer(b["keys"], "<i8"), np.frombuffer(b["own"], "<i8"), np.frombuffer(b["vectors"], kind).reshape(-1, dims)
                mine = np.flatnonzero(np.unpackbits(np.frombuffer(b["anchors"], np.uint8), count=len(keys)))
                if not len(mine):
                    continue
                scores = _products(v[mine], v, exact)
                row, col = np.nonzero((own[mine][:, None] == own[None, :]) & (keys[mine][:, None] != keys[None, :]))
                best, rank = _first(row, keys[col], scores[row, col], mining.positives)
                least = np.full(len(mine), _NONE)
                last = best[rank == mining.positives - 1]
                least[row[last]] = scores[row[last], col[last]]
                held.append((keys[mine], own[mine], v[mine], least))
                while sum(len(h[0]) for h in held) >= PIECE:
                    yield piece(PIECE)
        if held and sum(len(h[0]) for h in held):
            yield piece(PIECE)

    return blocks.table.select("keys", "own", "anchors", "vectors").mapInArrow(pieces, _PIECE)


def _windows(state: dict, n: int, mining: Mining) -> tuple[np.ndarray, np.ndarray]:
    """(n x positives, twice) the least and most score of a negative, of each positive; the most is below the
    least where there is no such positive or its score is below 0."""
    low, high = np.zeros((n, mining.positives), np.int64), np.full((n, mining.positives), -1, np.int64)
    for p in state["found"]:
        score = p["score"]
        low[p["at"], p["rank"] - 1], high[p["at"], p["rank"] - 1] = (-(-mining.low * score // 100), mining.high * score // 100) if score >= 0 else (0, -1)
    return low, high


def _unpacked(row: dict, kind: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["own"], "<i8"), np.frombuffer(row["vectors"], kind).reshape(-1, dims)


def chosen(blocks: Blocks, pieces: DataFrame, mining: Mining, negatives: bool) -> DataFrame:
    """(piece, block, part, places): the blocks that anchors of a piece must read, places as bits."""
    kind, dims, exact = "<" + blocks.kind, blocks.dims, blocks.exact
    longs = pa.list_(pa.int64())
    pack = pa.schema([("blocks", longs), ("parts", longs), ("labels", pa.list_(longs)), ("lo", pa.binary()), ("hi", pa.binary()), ("pack", pa.int64())])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ZONES):
                z = batch.slice(k, ZONES)
                lo, hi = (_matrix(z[c], dims).tobytes() for c in ("lo", "hi"))
                row = {"blocks": z["block"].to_pylist(), "parts": z["part"].to_pylist(), "labels": z["labels"].to_pylist(), "lo": lo, "hi": hi, "pack": z["block"][0].as_py()}
                yield pa.RecordBatch.from_pylist([row], schema=pack)

    zones = blocks.table.select("block", "part", "labels", "lo", "hi").coalesce(max(1, blocks.n // ZONES)).mapInArrow(packs, "blocks array<long>, parts array<long>, labels array<array<long>>, lo binary, hi binary, pack long")
    zones = blocks.scratch.written(zones, "zones-negatives" if negatives else "zones")
    # Every piece looks at every pack of zone maps: stated rows against all, in blocks.
    salts = -(-blocks.n // ZONES)
    if blocks.n * dims * 16 <= BROADCAST_BYTES:
        met = pieces.withColumn("_one", F.lit(1)).join(F.broadcast(zones.withColumn("_one", F.lit(1))), "_one")
    else:
        names = F.broadcast(zones.select(F.collect_list("pack").alias("_packs")).withColumn("_one", F.lit(1)))
        each = pieces.withColumn("_one", F.lit(1)).join(names, "_one").withColumn("pack", F.explode("_packs")).drop("_packs")
        spread = zones.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = each.withColumn("_salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int")).join(spread, ["pack", "_salt"])
    found = ["found"] if negatives else []
    out = pa.schema([("piece", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("places", pa.binary())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, own, v = _unpacked(r, kind, dims)
                lo, hi = (np.frombuffer(r[c], "<i8").reshape(-1, dims).astype(float) for c in ("lo", "hi"))
                up, down = np.maximum(v, 0).astype(float), np.minimum(v, 0).astype(float)
                most = up @ hi.T + down @ lo.T if exact else np.full((len(keys), len(lo)), np.inf)
                if negatives:
                    least = up @ lo.T + down @ hi.T if exact else -most
                    low, high = _windows(r, len(keys), mining)
                    other = np.stack([own != ls[0] if len(ls) == 1 else np.ones(len(own), bool) for ls in r["labels"]], axis=1)
                    met = np.zeros(most.shape, bool)
                    for w in range(mining.positives):
                        met |= (most >= low[:, w, None]) & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
                    met &= other
                else:
                    met = np.stack([np.isin(own, ls) for ls in r["labels"]], axis=1) & (most >= np.frombuffer(r["least"], "<i8")[:, None])
                any_of = np.flatnonzero(met.any(axis=0))
                rows = [{"piece": r["piece"], "block": r["blocks"][j], "part": r["parts"][j], "places": np.packbits(met[:, j]).tobytes()} for j in any_of]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return met.select("piece", "keys", "own", "vectors", "least", *found, "blocks", "parts", "labels", "lo", "hi").mapInArrow(choose, "piece long, block long, part int, places binary")


_HIT = "piece long, at int, anchor long, rank int, key long, score long"


def opened(blocks: Blocks, pieces: DataFrame, pairs: DataFrame, mining: Mining, negatives: bool) -> DataFrame:
    """(piece, at, anchor, rank, key, score): the first rows of each anchor, or of each of its positives'
    windows, by rank of the positive; of all blocks. `pairs` is as `chosen` gives it, written."""
    kind, dims, exact = "<" + blocks.kind, blocks.dims, blocks.exact
    k = mining.negatives if negatives else mining.positives
    needed = [r.part for r in pairs.select("part").distinct().collect()]  # folders: one for PART_BLOCKS blocks
    rows = blocks.table if len(needed) == blocks.parts else blocks.table.where(F.col("part").isin(needed))
    salts = -(-blocks.n // BLOCKS_A_SALT)
    own = ["found"] if negatives else []
    salted = pieces.select("piece", F.col("keys").alias("a_keys"), F.col("own").alias("a_own"), F.col("vectors").alias("a_vectors"), "least", *own).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = pairs.drop("part").withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(salted, ["piece", "_salt"])
    met = met.join(rows.select("block", "keys", "own", "vectors"), "block")
    schema = pa.schema([("piece", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("rank", pa.int32()), ("key", pa.int64()), ("score", pa.int64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # of the last pieces: what a row must score to be among the first
        for batch in batches:
            for r in batch.to_pylist():
                keys, labels, v = _unpacked(r, kind, dims)
                a_keys, a_own, a = _unpacked({c: r[f"a_{c}"] for c in ("keys", "own", "vectors")}, kind, dims)
                if r["piece"] not in known:
                    if len(known) >= 256:
                        known.pop(next(iter(known)))
                    known[r["piece"]] = np.full((len(a_keys), mining.positives), _NONE) if negatives else np.frombuffer(r["least"], "<i8").reshape(-1, 1).copy()
                least = known[r["piece"]]
                some = np.flatnonzero(np.unpackbits(np.frombuffer(r["places"], np.uint8), count=len(a_keys)))
                own_score = _products(a[some], v, exact)
                same = a_own[some][:, None] == labels[None, :]
                low, high = _windows(r, len(a_keys), mining) if negatives else (None, None)
                for w in range(least.shape[1]):
                    fit = own_score >= least[some, w][:, None]
                    if negatives:
                        fit &= ~same & (own_score >= low[some, w][:, None]) & (own_score <= high[some, w][:, None])
                    else:
                        fit &= same & (a_keys[some][:, None] != keys[None, :])
                    row, col = np.nonzero(fit)
                    value = own_score[row, col]
                    best, rank = _first(row, keys[col], value, k)
                    last = best[rank == k - 1]
                    least[some[row[last]], w] = np.maximum(least[some[row[last]], w], value[last])
                    at = some[row[best]]
                    columns = [np.full(len(best), r["piece"]), at.astype(np.int32), a_keys[at], np.full(len(best), w + 1, np.int32), keys[col[best]], value[best]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    hits = met.mapInArrow(scores, _HIT)
    order = Window.partitionBy("anchor", "rank").orderBy(F.col("score").desc(), "key")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mined(rows: DataFrame, anchor: Column, mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (key, label, v), as
    `scaled` gives them; `anchor` is a condition on them."""
    blocks = written_blocks(rows, anchor)
    if blocks is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    scratch = blocks.scratch
    with _few_rows(rows.sparkSession):
        pieces = scratch.written(gathered(blocks, mining), "pieces")
        pairs = scratch.written(chosen(blocks, pieces, mining, False), "pairs")
        positives = opened(blocks, pieces, pairs, mining, False).select("piece", "at", "anchor", F.col("place").alias("rank"), "key", "score")
        positives = scratch.written(positives, "positives")
        found = positives.groupBy("piece").agg(F.collect_list(F.struct("at", "rank", "score")).alias("found"))
        pieces = scratch.written(pieces.join(found, "piece"), "windows")
        pairs = scratch.written(chosen(blocks, pieces, mining, True), "pairs-negatives")
        negatives = scratch.written(opened(blocks, pieces, pairs, mining, True), "negatives")
    positives = positives.select("anchor", "rank", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, ["anchor", "rank"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = scaled(table(spark, sf_dir, "embeddings"), 256, "vec_id", "embedding", moved)
    return mined(rows, F.col("key") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
