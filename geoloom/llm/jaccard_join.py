"""Exact n-gram Jaccard join with a token-group matrix.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. The join is
exact; it returns every document's class, its number of links and its component.

1. Documents with equal sets form a class (a row each from here on), found by 96 bits of hashes of the set.
2. Similar classes are partitioned into groups: a class has BANDS keys of two MinHash values each, and
   joins the group of the key that most classes have. Groups are cut by set size (sizes of neighbouring
   cuts only can reach the threshold) and, where they are large, into blocks of bounded size.
3. The token-group matrix says which group holds which token: each group's union of the tokens that can
   decide. Those are the rarest of every class: if two sets link, they share at least SHARED of the tokens
   that are among the rarest of both, counted to SHARED more than may be missing from a partner. So the
   number of a query's rarest tokens that a group's union holds bounds its overlap with every member, and a
   group with fewer than SHARED of them is never opened. Rareness comes from a count sketch of all
   documents, which grows with them; it only orders the tokens, so that its errors cost time but no links.
4. In an opened block the overlap of a query with the union of the block's tokens bounds its overlap with
   every member; queries below the bound are dropped, the rest is counted exactly, in blocks of a
   matrix product. Every pair of classes meets in one block at most. A block returns the links as a
   spanning forest and counts, so that n copies give n rows.
5. Components of the forest give the answer.

Text is read three times (for sets, for prefixes, for blocks) instead of storing the sets; only texts of
classes that meet others are shuffled. Blocks are bounded in tokens and members, and those with very many
queries are dealt to several tasks; groups with very many classes are few, and their sizes are sent to the
rows rather than rows to them. Tables in between are removed when the answer is written.

Defined results: null and empty texts, and texts without words, have 0 shingles, no links, and are their
own component; documents without a doc_id are linked like others, and their component is the smallest
doc_id among its members, or null if none has one; repeated rows are copies of each other; a pair at the
threshold is linked; very long texts are taken whole; an empty table gives an empty one; other columns
pass through `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, free, hand_back, own_columns, small_batches, table, text_or_empty, written
from .wordhash import distinct, mix, shingles, slices, words

BANDS, SHARED, BLOCK_TOKENS, BLOCK_MEMBERS, BLOCK_QUERIES = 6, 3, 400_000, 1024, 2048
#: Counters of the sketch: one for SKETCH_BYTES of text, within these powers of two.
SKETCH_BYTES, LEAST_BITS, MOST_BITS = 256, 21, 24
#: Up to so many rows, the keys of texts to fetch, or of rows to drop, are broadcast; beyond, texts are
#: joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Groups of more classes than this, and than one in HOT_SHARE of all, are hot: HOT_SHARE of them at most.
HOT_MEMBERS, HOT_SHARE = 1000, 100_000
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SKETCH_PART = 1 << 14


@dataclass(frozen=True)
class Similarity:
    """Shingles of `size` words; a link where 100 * intersection >= percent * union."""

    size: int = 5
    percent: int = 80

    def needed(self, n):
        """Tokens that a set of n shares with any partner, at least."""
        return -(-n * self.percent // 100)

    def least(self, shared: int) -> int:
        """The smallest set whose partners, like itself, share so many tokens with it."""
        return next(n for n in range(1, 100 * shared) if self.needed(n) >= shared)

    def linked(self, shared, n, m):
        return 100 * shared >= self.percent * (n + m - shared)

    def cut(self, n: Column) -> Column:
        """Sizes whose ratio can reach the threshold are in the same cut or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / (log(100 / self.percent) * (1 + 1e-9))).cast("int")


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles, first index of each text's) of runs of texts."""
    for begin, data, offsets in slices(column):
        values, first = shingles(words(data, offsets), size)
        yield (begin, *distinct(values, first))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes (64 and 32 bits) of each set; 0 of empty ones."""
    n = np.diff(first)
    h1, h2, some = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(values):
        at = first[:-1][some]
        h1[some] = mix(np.add.reduceat(mix(values), at) + n[some].astype(np.uint64))
        h2[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at) ^ h1[some])
    return h1, (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch_bits(docs: DataFrame) -> int:
    """The sketch's size, as a power of two, for documents (text) of this size in all."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(LEAST_BITS, min(MOST_BITS, (size // SKETCH_BYTES).bit_length()))


def summaries(docs: DataFrame, sim: Similarity, bits: int = LEAST_BITS) -> DataFrame:
    """One row (n, h1, h2, bands) for each document, besides its _row and _th; and for each task the parts
    of its count sketch, as rows with a part number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting = np.zeros(1 << bits, np.int32), []

        def tally() -> None:
            if waiting:
                tokens, times = np.unique(np.concatenate(waiting), return_counts=True)
                sketch[tokens] += times.astype(np.int32)
                waiting.clear()

        names = ["_id", "_row", "_th", "n", "h1", "h2", "bands", "part", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for batch in batches:
            for begin, values, first in _sets(batch.column(3), sim.size):
                n, count = np.diff(first), len(first) - 1
                h1, h2 = _hashes(values, first)
                bands = np.zeros((count, BANDS), np.uint64)
                some = np.flatnonzero(n)
                if len(values):
                    at = first[:-1][some]
                    low = [np.minimum.reduceat(mix(values * s), at) for s in _SEEDS]
                    for k in range(BANDS):
                        bands[some, k] = mix(low[2 * k] + mix(low[2 * k + 1]) + np.uint64(k))
                    waiting.append((values >> np.uint64(64 - bits)).astype(np.int32))
                    if sum(map(len, waiting)) > 1 << LEAST_BITS - 2:
                        tally()
                columns = [c.slice(begin, count) for c in batch.columns[:3]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * BANDS, pa.int32()), pa.array(_signed(bands).ravel()))
                columns += [pa.array(n.astype(np.int32)), pa.array(_signed(h1)), pa.array(h2), lists, pa.nulls(count, pa.int32()), pa.nulls(count, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        tally()
        parts = np.minimum(sketch, 65_535).astype(np.uint16).reshape(-1, _SKETCH_PART)
        used = np.flatnonzero(parts.any(axis=1))
        columns = [pa.nulls(len(used), t) for t in kinds]
        columns[7], columns[8] = pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names)
        hand_back()

    return docs.mapInArrow(run, "_id long, _row long, _th long, n int, h1 long, h2 int, bands array<long>, part int, counts binary")


def rareness(rows: DataFrame, bits: int = LEAST_BITS) -> np.ndarray:
    """The sum of all tasks' sketches on a scale of six steps for a doubling: a byte for each counter. Parts are
    added up as they stream by, first those of a sixteenth of the rows, so that neither a task's memory nor its
    work depends on the number of sketches."""

    def add(batches: Iterator[pa.RecordBatch], kind: type, last: bool) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
                sums[part] = sums.get(part, 0) + own
        form = (lambda s: np.minimum(6 * np.log2(1 + s), 255).astype(np.uint8)) if last else lambda s: np.minimum(s, 2**31 - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([form(s).tobytes() for s in sums.values()], pa.binary())], ["part", "counts"])

    n = (1 << bits) // _SKETCH_PART
    total = np.zeros((n, _SKETCH_PART), np.uint8)
    dealt = rows.where("part IS NOT NULL").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    tasks = max(8, min(n, dealt.count() // n))  # as many as there are sketches
    some = dealt.repartition(tasks, "part", "salt").select("part", "counts").mapInArrow(lambda b: add(b, np.uint16, False), "part int, counts binary")
    for row in some.repartition(min(tasks, 64), "part").mapInArrow(lambda b: add(b, np.int32, True), "part int, counts binary").toLocalIterator():
        total[row["part"]] = np.frombuffer(bytes(row["counts"]), np.uint8)
    return total.ravel()


def prefixes(docs: DataFrame, shared: Broadcast, sim: Similarity, bits: int = LEAST_BITS) -> DataFrame:
    """(h1, h2, token) of each document's rarest tokens, by the sketch that is shared."""
    many = sim.least(SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for _, values, first in _sets(batch.column(0), sim.size):
                if not len(values):
                    continue
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, rare[(values >> np.uint64(64 - bits)).astype(np.int64)], owner))
                rank = np.arange(len(values)) - first[:-1][owner]
                chosen = rank < (n - sim.needed(n) + np.where(n >= many, SHARED, 1))[owner]
                h1, h2 = _hashes(values, first)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h1[owner[chosen]])), pa.array(h2[owner[chosen]]), pa.array(_signed(values[order][chosen]))], ["h1", "h2", "token"])
        hand_back()

    return docs.select(text_or_empty()).mapInArrow(run, "h1 long, h2 int, token long")


def several(tokens: DataFrame) -> DataFrame:
    """(h1, h2, token), once each, of the tokens that more than one set has. Rows come sorted by token, so that
    a task holds one row back and no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)], False
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, t = (np.concatenate((a, c.to_numpy())) for a, c in zip(held, batch.columns, strict=True))
            new = np.append(True, (t[1:] != t[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            h1, h2, t = h1[new], h2[new], t[new]
            same = t[1:] == t[:-1]
            many = np.append(same, False) | np.append(False, same)
            many[0] |= shared
            keep = many[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in (h1, h2, t)], ["h1", "h2", "token"])
            held, shared = [h1[-1:], h2[-1:], t[-1:]], bool(many[-1])
        if shared:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["h1", "h2", "token"])

    return tokens.repartition("token").sortWithinPartitions("token", "h1", "h2").mapInArrow(run, "h1 long, h2 int, token long")


def _looked_up(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with facts by key. Rows of hot keys, of which there is a bounded number, meet them by
    broadcast, so that no task gets all rows of one."""
    usual = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(facts, key)
    return usual.unionByName(rows.join(F.broadcast(hot), key))


class _Members:
    """Token sets of some classes: node, size, copies, and the tokens one after the other."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}
        self.copies: list[int] = []
        self.sets: list[np.ndarray] = []

    def add(self, node: int, copies: int, tokens: np.ndarray) -> None:
        if node not in self.seen:  # copies of a row may come along
            self.seen[node] = len(self.sets)
            self.copies.append(copies)
            self.sets.append(tokens)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] shared tokens, through slices of the incidence matrices of the tokens in union."""

    def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.searchsorted(union, tokens)
        at[at == len(union)] = 0
        hit = union[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    out = np.zeros((len(a), len(b)), np.float32)
    if not len(union):
        return out
    (ca, ra), (cb, rb) = incidence(a), incidence(b)
    width = max(64, min(len(union), 2_000_000 // max(len(a), len(b), 1)))
    for begin in range(0, len(union), width):
        i = slice(*np.searchsorted(ca, (begin, begin + width)))
        j = slice(*np.searchsorted(cb, (begin, begin + width)))
        if i.stop == i.start or j.stop == j.start:
            continue
        used = min(width, len(union) - begin)
        x, y = np.zeros((len(a), used), np.float32), np.zeros((len(b), used), np.float32)
        x[ra[i], ca[i] - begin] = 1
        y[rb[j], cb[j] - begin] = 1
        out += x @ y.T
    return out


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric matrix of links reaches."""
    root = np.arange(len(links))
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


class _Block:
    """A group's block: its members, then the queries to it."""

    def __init__(self, sim: Similarity):
        self.sim, self.members, self.queries = sim, _Members(), _Members()
        self.union: np.ndarray | None = None

    def _bound(self, sets: list[np.ndarray], among: np.ndarray) -> list[int]:
        """Which sets share enough with the tokens in among."""
        if not len(among):
            return []
        kept = []
        for k, s in enumerate(sets):
            at = np.searchsorted(among, s)
            at[at == len(among)] = 0
            if (among[at] == s).sum() >= self.sim.needed(len(s)):
                kept.append(k)
        return kept

    def inner(self) -> Iterator[tuple[int, int | None, int]]:
        """Links among the members."""
        nodes, sets = list(self.members.seen), self.members.sets
        rows = list(range(len(sets)))
        while len(rows) > 1:  # only tokens of two members count; members left without enough of them go
            tokens, times = np.unique(np.concatenate([sets[k] for k in rows]), return_counts=True)
            among = tokens[times > 1]
            kept = [rows[k] for k in self._bound([sets[k] for k in rows], among)]
            if len(kept) == len(rows):
                break
            rows = kept
        if len(rows) < 2:
            return
        own = [sets[k] for k in rows]
        n = np.array([len(s) for s in own])
        links = self.sim.linked(_overlaps(own, own, among), n[:, None], n[None, :])
        np.fill_diagonal(links, False)
        root, copies = _local_roots(links), np.array([self.members.copies[k] for k in rows])
        degree = links @ copies
        for k in np.flatnonzero(degree):
            yield nodes[rows[k]], None, int(degree[k])
            if root[k] != k:
                yield nodes[rows[k]], nodes[rows[root[k]]], 0
        self.root = {rows[k]: rows[root[k]] for k in range(len(rows))}

    def outer(self) -> Iterator[tuple[int, int | None, int]]:
        """Links between the queries so far and the members; then the queries are let go."""
        if self.union is None:
            self.union = np.unique(np.concatenate(self.members.sets)) if self.members.sets else np.zeros(0, np.uint64)
        queries, self.queries = self.queries, _Members()
        nodes, kept = list(queries.seen), self._bound(queries.sets, self.union)
        if not kept or not self.members.sets:
            return
        own = [queries.sets[k] for k in kept]
        members = self.members
        n, m = np.array([len(s) for s in own]), np.array([len(s) for s in members.sets])
        links = self.sim.linked(_overlaps(own, members.sets, self.union), n[:, None], m[None, :])
        member_nodes, root = list(members.seen), getattr(self, "root", {})
        for k, count in enumerate(links @ np.array(members.copies)):
            if count:
                yield nodes[kept[k]], None, int(count)
                for r in {root.get(j, j) for j in np.flatnonzero(links[k]).tolist()}:
                    yield nodes[kept[k]], member_nodes[r], 0
        for j, count in enumerate(np.array([queries.copies[k] for k in kept]) @ links):
            if count:
                yield member_nodes[j], None, int(count)


def _verify(rows: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b, links) of rows (gid, cut, sub, chunk, role, node, copies, text) that come block by block,
    members (role 0) before queries (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, found, held = None, None, [], 0

        def ended() -> Iterator[tuple[int, int | None, int]]:
            if block is not None:
                if block.union is None and key[3] == 0:
                    yield from block.inner()
                yield from block.outer()

        for batch in batches:
            head = [c.to_pylist() for c in batch.columns[:7]]
            for begin, values, first in _sets(batch.column(7), sim.size):
                for k in range(len(first) - 1):
                    *now, role, node, copies = (c[begin + k] for c in head)
                    if tuple(now) != key:
                        found += ended()
                        key, block, held = tuple(now), _Block(sim), 0
                    tokens = values[first[k] : first[k + 1]].copy()
                    if role == 0:
                        block.members.add(node, copies, tokens)
                        continue
                    if block.union is None:
                        # A chunk other than the first one knows the members' components only by itself.
                        inner = list(block.inner())
                        found += inner if key[3] == 0 else []
                        block.union = np.unique(np.concatenate(block.members.sets)) if block.members.sets else np.zeros(0, np.uint64)
                    block.queries.add(node, copies, tokens)
                    held += len(tokens)
                    if held > BLOCK_TOKENS:
                        found += block.outer()
                        held = 0
            if len(found) > 1000:
                yield _edges(found)
                found = []
        found += ended()
        yield _edges(found)
        hand_back()

    return rows.mapInArrow(run, "a long, b long, links long")


def _edges(found: list) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "links"])


def linked(docs: DataFrame, sim: Similarity, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(_id, _row, _th, n, node, component, links) of each document; _row and _th tell rows apart that
    have no key."""
    spark, text = docs.sparkSession, text_or_empty(column)
    scratch = Scratch(spark)
    ident = F.col(f"`{key}`").cast("long")
    known = docs.select(ident.alias("_id"), F.coalesce(ident, F.xxhash64(text)).alias("_row"), F.xxhash64(text).alias("_th"), text.alias("text"))
    bits = sketch_bits(known)
    found = scratch.written(summaries(known, sim, bits), "summaries")
    rare = rareness(found, bits)
    light = found.where("part IS NULL")
    sets = light.where("n > 0")
    rep = F.min(F.struct("_row", "_th")).alias("rep")
    classes = sets.groupBy("h1", "h2").agg(rep, F.max("n").alias("n"), F.count("*").alias("copies"), F.min("_id").alias("least"), F.first("bands").alias("bands"))
    # Numbers are given as the table is written, and stay.
    classes = scratch.written(classes.withColumns({"cut": sim.cut(F.col("n")), "node": F.monotonically_increasing_id()}), "classes")

    # groups: the most common of a class's keys
    keys = classes.select("node", F.explode("bands").alias("band"))
    common = keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    chosen = keys.join(common, "band").groupBy("node").agg(F.max(F.struct("size", "band")).alias("best")).select("node", F.col("best.band").alias("gid"))
    grouped = scratch.written(classes.join(chosen, "node", "left").select("node", "h1", "h2", "rep", "n", "copies", "cut", F.coalesce("gid", "node").alias("gid")), "grouped")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int")
    size = scratch.written(grouped.groupBy("gid", "cut").agg(blocks.alias("subs"), F.count("*").alias("members")), "sizes")
    many = max(HOT_MEMBERS, light.count() // HOT_SHARE)
    hot = scratch.written(size.where(F.col("members") > many), "hot")
    members = scratch.written(_looked_up(grouped, size, hot, ["gid", "cut"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")), "members")

    # the matrix: which group holds which token of the prefixes; queries count those that they share with it
    shared = spark.sparkContext.broadcast(rare)
    tokens = several(prefixes(known.select("text"), shared, sim, bits))
    tokens = scratch.written(tokens.join(members.select("h1", "h2", "node", "gid", "cut", "n"), ["h1", "h2"]).drop("h1", "h2"), "prefixes")
    shared.unpersist()  # workers would keep it; a task that is run again fetches it anew
    matrix = tokens.select("token", F.col("gid").alias("to_gid"), F.col("cut").alias("to_cut")).distinct()
    meets = tokens.join(matrix, "token").where("gid < to_gid AND abs(cut - to_cut) <= 1")
    bound = F.when(F.col("n") >= sim.least(sim.least(SHARED)), SHARED).otherwise(1)
    crossing = meets.groupBy("node", F.col("to_gid").alias("gid"), F.col("to_cut").alias("cut"), bound.alias("bound")).agg(F.count("*").alias("held")).where("held >= bound").select("node", "gid", "cut")
    crossing = crossing.join(size, ["gid", "cut"]).select("node", "gid", "cut", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    # other blocks of a class's own group: of the cut below, and earlier ones of its own cut
    near = members.select("node", "gid", F.col("cut").alias("own_cut"), F.col("sub").alias("own_sub"), F.explode(F.array(F.col("cut") - 1, F.col("cut"))).alias("cut"))
    near = _looked_up(near, size, hot, ["gid", "cut"]).select("node", "gid", "cut", "own_cut", "own_sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).where("cut < own_cut OR sub < own_sub").select("node", "gid", "cut", "sub")
    queries = scratch.written(crossing.unionByName(near), "queries")

    # the rows that meet in blocks
    chunks = scratch.written(queries.groupBy("gid", "cut", "sub").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("chunks")), "chunks")
    held = members.join(chunks, ["gid", "cut", "sub"], "left").where("members > 1 OR chunks IS NOT NULL")
    held = held.select("gid", "cut", "sub", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), F.lit(0).alias("role"), "node", "copies", "rep")
    asked = queries.join(chunks, ["gid", "cut", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
    asked = asked.join(members.select("node", "copies", "rep"), "node").select("gid", "cut", "sub", "chunk", F.lit(1).alias("role"), "node", "copies", "rep")
    places = held.unionByName(asked).select("*", F.col("rep._row").alias("_row"), F.col("rep._th").alias("_th")).drop("rep")
    places = scratch.written(places, "places")
    few = places.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    sent = lambda df: F.broadcast(df) if few else df
    rows = known.select("_id", "_row", "_th", "text")
    if light.where("_id IS NULL").limit(1).count():  # copies without a key go once to all their places
        nameless = rows.where("_id IS NULL").join(sent(places.select("_row", "_th").distinct()), ["_row", "_th"], "left_semi")
        rows = rows.where("_id IS NOT NULL").unionByName(nameless.dropDuplicates(["_row", "_th"]))
    rows = rows.drop("_id").join(sent(places), ["_row", "_th"])
    block = ["gid", "cut", "sub", "chunk"]
    rows = rows.select(*block, "role", "node", "copies", "text").repartition(*block).sortWithinPartitions(*block, "role")
    pairs = scratch.written(_verify(rows, sim), "links")

    roots = components(pairs.where("b IS NOT NULL").select("a", "b"))
    degrees = pairs.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    rooted = classes.select("node", "h1", "h2", "copies", "least").join(roots, "node", "left").join(degrees, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    answer = rooted.join(lowest, "root").select("h1", "h2", F.col("root").alias("node"), "component", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    answer = scratch.written(answer, "answer")
    scratch.remove("classes", "grouped", "sizes", "hot", "members", "prefixes", "queries", "chunks", "places", "links")
    with_sets = _looked_up(sets, answer, answer.where(F.col("copies") > many), ["h1", "h2"]).select("_id", "_row", "_th", "n", "node", "component", "links")
    empty = light.where("n = 0").select("_id", "_row", "_th", "n", F.lit(None).cast("long").alias("node"), F.col("_id").alias("component"), F.lit(0).cast("long").alias("links"))
    return with_sets.unionByName(empty)


def one_of_each(docs: DataFrame, sim: Similarity, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The document of smallest key of each component, with its own columns; of rows without a key, and of
    repeated rows, one stays as well. Documents without words all stay."""
    text = text_or_empty(column)
    answer = written(linked(docs, sim, key, column).where("n > 0").select("_id", "_row", "_th", "node"), "answer")
    first = answer.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull(), "_row", "_th")).alias("first"))
    each = answer.groupBy("node", "_row", "_th").agg(F.count("*").alias("times")).join(first, "node")
    stays = (F.col("_row") == F.col("first._row")) & (F.col("_th") == F.col("first._th"))
    # Rows to drop, and rows to keep once, rather than those that stay: they are fewer.
    apart = written(each.where(~stays | (F.col("times") > 1)).select("_row", "_th", stays.alias("stays")), "apart")
    few = apart.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    one = apart.select(F.struct("*").alias(to := free(docs, "_to")))
    on = [F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(text)) == F.col(f"{to}._row"), F.xxhash64(text) == F.col(f"{to}._th")]
    met = docs.join(F.broadcast(one) if few else one, on, "left")
    kept = met.where(F.col(to).isNull()).select(*own_columns(docs))
    if not apart.where("stays").limit(1).count():
        return kept
    again = met.where(F.col(f"{to}.stays")).dropDuplicates([to]).select(*own_columns(docs))
    return kept.unionByName(again)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = linked(small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text"), Similarity(3, 90))
    return answer.select(F.col("_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(small_batches(docs), Similarity())


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id)::BIGINT AS component_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""
