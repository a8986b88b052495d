"""Benchmark decontamination: short test items found inside long documents.

MinHash containment search over size partitions. Items are partitioned by their number of shingles
(a factor of two each); for the items of 2**p and more, every document is cut into consecutive blocks of
2**(p-1) shingles, about half an item, and each block has a MinHash value under each of PERMS hash
functions. An item that lies in a document covers at least one block wholly, whose minimum the item's
own minimum often is, however long the document; a document is a candidate for an item if one of its
blocks and the item share a minimum. Candidates are verified by exact containment: the share of the
item's distinct shingles that the whole document has.

Words are runs of letters and digits (and all bytes beyond ASCII), A-Z lower-cased; shingles have five
words. An item with fewer words is one shingle of all of them, in a partition of the items of that length,
and is looked up among all runs of so many words of a document. Text is read where it is and never
shuffled. A benchmark of more than ITEM_BYTES of text is dealt into pieces of about that size, and the
documents are searched for one piece after the other: each pass sends one piece, and writes only what it
found, by a hash of the text, so that what tasks hold doesn't grow with the benchmark.

Defined results: null and empty texts, and items without words, match nothing; repeated rows are
matched each; an item at the threshold matches; a text's matches are in the order of their item_id;
very long texts are cut into blocks whole; an empty benchmark or table gives no match; all other columns
pass through, whatever their names (`with_matches` adds its column under its name or the first free one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, free, once, own_columns, small_batches, table, text_or_empty
from .wordhash import Words, mix, shingles, slices, words

SHINGLE, THRESHOLD, PERMS = 5, 0.8, 24
ITEM_BYTES, PIECE_ITEMS = 4 << 20, 50_000
#: Up to so many texts with matches are broadcast where the benchmark has several pieces.
BROADCAST_TEXTS = 100_000
_MATCHES = "array<struct<item_id:bigint,containment:double,item_shingles:int>>"
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words(column: pa.Array):
    for _, data, offsets in slices(column):
        yield words(data, offsets, inside=_INSIDE[data])


def _hash(values: np.ndarray, perm: int) -> np.ndarray:
    return (values ^ _SEEDS[perm]) * (_SEEDS[perm + 128] | np.uint64(1))


class Index:
    """Items by size partition: for each hash function the items' minima, sorted."""

    def __init__(self, ids: list[int], texts: list[str]):
        parts = list(_words(pa.array(texts, pa.string())))
        lengths = [int(n) for w in parts for n in np.diff(w.first)]
        self.sets = [s for values, first in (shingles(w, SHINGLE) for w in parts) for s in (np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))]
        self.ids = ids
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if 0 < lengths[k] < SHINGLE:
                by_length.setdefault(lengths[k], []).append(k)
            elif len(s):
                by_class.setdefault(int(len(s)).bit_length() - 1, []).append(k)
        for p, members in by_class.items():
            self.classes[p] = []
            for perm in range(PERMS):
                minima = np.array([_hash(self.sets[k], perm).min() for k in members], np.uint64)
                order = np.argsort(minima)
                self.classes[p].append((minima[order], np.array(members)[order]))
        #: Items of fewer words than a shingle, by length: their hashes, sorted.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, members in by_length.items():
            own = np.array([self.sets[k][0] for k in members], np.uint64)
            order = np.argsort(own)
            self.short[n] = (own[order], np.array(members)[order])
        #: The low bits of all minima of a partition: most blocks are passed over by one lookup.
        self.bits = {p: [np.zeros(1 << 16, bool) for _ in range(PERMS)] for p in self.classes}
        for p, tables in self.classes.items():
            for perm, (minima, _) in enumerate(tables):
                self.bits[p][perm][(minima >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, values: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a block's minimum."""
        found: set[tuple[int, int]] = set()
        if not len(values):
            return found
        counts = np.diff(first)
        layouts = {}
        for p in self.classes:
            u = max(1, 1 << (p - 1) if p else 1)
            blocks = -(-counts // u)
            begin = np.concatenate(([0], np.cumsum(blocks)))
            owner = np.repeat(np.arange(len(counts)), blocks)
            layouts[p] = (first[:-1][owner] + (np.arange(begin[-1]) - begin[owner]) * u, owner)
        for perm in range(PERMS):
            h = _hash(values, perm)
            for p, (at, owner) in layouts.items():
                minima, members = self.classes[p][perm]
                low = np.minimum.reduceat(h, at)
                hits = np.flatnonzero(self.bits[p][perm][(low >> np.uint64(48)).astype(np.int64)])
                if len(hits):
                    a, b = np.searchsorted(minima, low[hits], "left"), np.searchsorted(minima, low[hits], "right")
                    for k in np.flatnonzero(b > a):
                        found.update((int(owner[hits[k]]), int(m)) for m in members[a[k] : b[k]])
        return found

    def short_matches(self, w: Words) -> set[tuple[int, int]]:
        """(text, item) pairs of the items of fewer words than a shingle that stand in a text."""
        found: set[tuple[int, int]] = set()
        for n, (own, members) in self.short.items():
            values, first = shingles(w, n)
            hits = np.flatnonzero(np.isin(values, own))
            texts = np.searchsorted(first, hits, "right") - 1
            a, b = np.searchsorted(own, values[hits], "left"), np.searchsorted(own, values[hits], "right")
            for k in range(len(hits)):
                found.update((int(texts[k]), int(m)) for m in members[a[k] : b[k]])
        return found


def matches(column: pa.Array, index: Index, threshold: float = THRESHOLD) -> list[list[dict]]:
    """For each text, the items that it contains."""
    out: list[list[dict]] = []
    for w in _words(column):
        values, first = shingles(w, SHINGLE)
        rows: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        own: dict[int, np.ndarray] = {}
        short = index.short_matches(w)
        for text, item in sorted(index.candidates(values, first) | short, key=lambda f: (f[0], index.ids[f[1]])):
            s = index.sets[item]
            if (text, item) in short:
                shared = len(s)
            else:
                if text not in own:
                    own[text] = np.unique(values[first[text] : first[text + 1]])
                shared = int(np.isin(s, own[text], assume_unique=True).sum())
            if shared >= threshold * len(s) - 1e-9:
                rows[text].append({"item_id": index.ids[item], "containment": shared / len(s), "item_shingles": len(s)})
        out.extend(rows)
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs with _matches, the items (item_id, containment, item_shingles) that each text contains."""
    name = free(docs, "_matches")
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    pieces = max(1, -(-size["b"] // item_bytes), -(-size["n"] // PIECE_ITEMS))
    if pieces == 1:
        return docs.withColumn(name, _finder(_sent(items), threshold)(text_or_empty()))
    scratch, found = Scratch(docs.sparkSession), None
    text = docs.select(text_or_empty().alias("text"))
    for k in range(pieces):
        sent = _sent(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == k))
        hits = text.withColumn("m", _finder(sent, threshold)(F.col("text"))).where(F.size("m") > 0)
        one = scratch.written(hits.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "m").dropDuplicates(["h1", "h2"]), f"piece-{k}")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    # Each text is one row for a piece, however many copies it has.
    each = scratch.written(found.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m")), "found").select(F.struct("h1", "h2", "m").alias(to := free(docs, "_to")))
    on = [F.xxhash64(text_or_empty()) == F.col(f"{to}.h1"), F.xxhash64(F.lit(1), text_or_empty()) == F.col(f"{to}.h2")]
    few = each.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    joined = docs.join(F.broadcast(each) if few else each, on, "left")
    return joined.withColumn(name, F.coalesce(F.col(f"{to}.m"), F.array().cast(_MATCHES))).drop(to)


def _sent(items: DataFrame):
    """A piece of the benchmark, which is about ITEM_BYTES at most, for the tasks."""
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


_indexes: dict = {}


def _finder(items, threshold: float):
    def find(text: pa.Array) -> pa.Array:
        key = getattr(items, "_path", None) or id(items)
        if key not in _indexes:  # a plan has one piece, so a worker makes its index once
            _indexes.clear()
            _indexes[key] = Index(*items.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64()), ("item_shingles", pa.int32())]))
        return pa.array(matches(text, _indexes[key], threshold), kind)

    find.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return once(F.arrow_udf(find, _MATCHES))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    return with_matches(docs, benchmark, threshold).where(F.size(free(docs, "_matches")) == 0).select(*own_columns(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it contains."""
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("_matches").alias("m"))
    return found.select("doc_id", "m.item_id", F.round("m.containment", 6).alias("containment"), "m.item_shingles")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(small_batches(docs), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, coalesce(text, '') AS text FROM documents
           UNION ALL SELECT 'i', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT kind, rid, id, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM t),
z AS (SELECT DISTINCT least(5, len(ws)) AS z FROM w WHERE kind = 'i' AND len(ws) > 0),
s AS (SELECT DISTINCT kind, rid, id, z, array_to_string(ws[i : i + z - 1], ' ') AS s
      FROM (SELECT kind, rid, id, ws, z, unnest(range(1, len(ws) - z + 2)) AS i FROM w JOIN z ON len(ws) >= z AND (kind = 'd' OR z = least(5, len(ws))))),
n AS (SELECT rid, count(*) AS n FROM s WHERE kind = 'i' GROUP BY rid)
SELECT d.id AS doc_id, i.id AS item_id, round(count(*) / any_value(n.n)::DOUBLE, 6) AS containment, any_value(n.n)::INTEGER AS item_shingles
FROM s i JOIN s d ON i.s = d.s AND i.z = d.z AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.rid = i.rid
GROUP BY d.rid, d.id, i.rid, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""
