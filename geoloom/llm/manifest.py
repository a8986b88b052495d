"""A Merkle manifest of a dataset: a hash tree over each group's rows, one over the groups, and proofs.

1. Leaves: each row's hash over the named fields, each as its length in bytes, a colon and its value (`-` if
   null). A tree for each group has its leaves by key; the subroots, by group, are the leaves of the top tree.
2. Places: rows are dealt by ranges of (group, key) and written in that order, so that a place is the place in
   its part plus the rows of the group in the parts before; no task orders a group.
3. Levels: sixteen consecutive nodes become one. A level is written before the next one is built; each node
   keeps its parent, its place among the parent's children, and its own children's hashes.
4. Proofs: a recursive query over the written nodes ascends from the leaves. The leaves of a run have the same
   ancestors, so one row of the recursion carries all (up to sixteen) of them, each with its own folded hash:
   at each step the parent's other children are appended to the siblings, and each folded hash takes its
   place among them. Carrying the siblings with each single leaf would write them sixteen times.

Upper nodes are met by many rows, so a node has a copy for each COPY_RUNS runs below it, and runs are dealt
over the copies: no key of the join holds much more than that. Tampering is a second text under the same key: its leaf is folded instead of the original one, between the original
siblings.

Digests are hexadecimal text wherever they are hashed, 32 bytes where they are stored. The recursion's limit
of rows is lifted while the result is written (the session's setting is put back).

Defined results: null values hash as `-`, empty ones as `0:`; null keys and null groups come first, a null
group apart from an empty one; rows that repeat have equal leaves side by side, each with its own place and
proof; equal keys with other values lie by their leaves; very long texts are hashed whole, and only digests
are dealt out; a group of one row has its leaf as subroot, a single group its subroot as root, and a proof
may be of no siblings (the hash of nothing); an empty table has no tree and no rows. Other columns, whatever
their names, are not part of the manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows in a part of the written leaves.
PART_ROWS = 100_000
#: Runs that meet one copy of a node.
COPY_RUNS = 256
#: Up to so many (group, part) pairs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PARTS = 50_000


def _value(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, fields: Sequence[str] = FIELDS, instead: dict[str, Column] | None = None) -> Column:
    """The leaf's digest (32 bytes); `instead` has other values for some fields."""
    values = [(instead or {}).get(f, F.col(f"`{f}`")) for f in fields]
    return F.unhex(F.sha2(F.concat(*map(_value, values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """The digests as text, one after the other."""
    return F.array_join(F.transform(digests, _hex), "")


def _digest(digests: Column) -> Column:
    return F.unhex(F.sha2(_joined(digests), 256))


def _placed(rows: DataFrame, scratch: Scratch, tree: str, order: list[str], name: str) -> DataFrame:
    """rows (written ones) with _at, a row's place in its tree by the given order, and _n, the tree's rows.
    The last part of the order only tells equal rows apart, so that they needn't lie in one part."""
    sizes, spark = rows.count(), rows.sparkSession
    parts = max(1, -(-sizes // PART_ROWS), min(sizes // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [tree, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_within")), name)
    ends = dealt.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.min("_within").alias("_first"), F.count("*").alias("_own"))
    whole = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_own").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = scratch.written(ends.select("_tree", "_of", (before - F.col("_first")).alias("_shift"), F.sum("_own").over(whole).alias("_n")), f"{name}-ends")
    if ends.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS:
        ends = F.broadcast(ends)
    met = dealt.join(ends, dealt[tree].eqNullSafe(ends["_tree"]) & (dealt["_part"] == ends["_of"]))
    return met.withColumn("_at", F.col("_within") + F.col("_shift")).drop("_tie", "_part", "_within", "_tree", "_of", "_shift")


def _levels(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """nodes (tree, at, digest, n: nodes of the tree on this level, below: runs below, runs: those of the tree),
    and each level above them while a tree has several nodes, written."""
    levels = [nodes]
    while not levels[-1].where("n > 1").isEmpty():
        up = levels[-1].where("n > 1").groupBy("tree", F.expr(f"at div {RUN}").alias("at"))
        up = up.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("all"), F.first("n").alias("of"), F.sum("below").alias("below"), F.first("runs").alias("runs"))
        up = up.select("tree", "at", F.transform("all", lambda x: x["digest"]).alias("kids"), F.expr(f"(of + {RUN - 1}) div {RUN}").alias("n"), "below", "runs")
        levels.append(scratch.written(up.withColumn("digest", _digest(F.col("kids"))), f"{name}{len(levels)}"))
    return levels


def _copies(below: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(below / COPY_RUNS)).cast("long")


def _name(level: int, at: Column, tree: Column) -> Column:
    """A node's name: its level, its place there, and its tree's group (`-` if that is null)."""
    return F.concat_ws("|", F.lit(level), at, F.coalesce(F.concat(F.lit("="), tree), F.lit("-")))


def _link(nodes: DataFrame, level: int, tops: DataFrame) -> DataFrame:
    """nodes of a level with the name of their parent, their place there and the parent's copies; that of a
    subroot is its node in the top tree."""
    up = F.expr(f"at div {RUN}")
    span = F.lit(RUN).cast("long") ** level
    within = nodes.where("n > 1").withColumns(
        {"parent": _name(level + 1, up, F.col("tree")), "place": F.expr(f"cast(at % {RUN} AS int)"), "copies": _copies(F.least(span, F.col("runs") - up * span)), "subroot": F.lit(None).cast("binary")}
    )
    ends = nodes.where("n = 1").join(tops.select(F.col("of").alias("_of"), "parent", "place", "copies"), F.col("tree").eqNullSafe(F.col("_of"))).drop("_of")
    return within.unionByName(ends.withColumn("subroot", F.col("digest")).select(*within.columns))


def _above(levels: list[DataFrame]) -> list[DataFrame]:
    """The levels of the top tree, from the subroots on, linked: each meets the next by its place."""
    out = []
    for k, nodes in enumerate(levels):
        if k + 1 < len(levels):
            up = levels[k + 1].select(F.col("at").alias("_up"), _copies(F.col("below")).alias("copies"))
            linked = nodes.join(up, F.expr(f"at div {RUN}") == F.col("_up")).withColumn("parent", F.concat_ws("|", F.lit("top"), F.lit(k + 1), "_up")).drop("_up")
        else:
            linked = nodes.withColumn("copies", F.lit(1).cast("long")).withColumn("parent", F.lit(None).cast("string"))
        out.append(linked.withColumn("place", F.expr(f"cast(at % {RUN} AS int)")))
    return out


@dataclass(frozen=True)
class Manifest:
    """runs: a row for each run of leaves; nodes: a row for each node above them and each of its copies, with
    its children's digests, its parent's name and its place there."""

    scratch: Scratch
    runs: DataFrame
    nodes: DataFrame


def built(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, other: dict[str, Column] | None = None) -> Manifest:
    """The trees over docs. `other` has values that stand for some fields in the hashes that proofs fold."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{key}`").alias("key"), leaf_of(docs, fields).alias("digest"), leaf_of(docs, fields, other).alias("folded"))
    leaves = _placed(scratch.written(own, "digests"), scratch, "tree", ["key", "digest", "folded"], "leaves")
    runs = leaves.groupBy("tree", F.expr(f"_at div {RUN}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("_at", "digest", "folded", "key"))).alias("leaves"), F.first("_n").alias("of"))
    kids = F.transform("leaves", lambda x: x["digest"])
    runs = runs.withColumn("digest", F.when(F.col("of") == 1, kids[0]).otherwise(_digest(kids))).withColumn("n", F.expr(f"(of + {RUN - 1}) div {RUN}")).withColumn("runs", F.col("n"))
    runs = scratch.written(runs, "runs")
    scratch.remove("digests", "leaves", "leaves-ends")
    levels = _levels(runs.select("tree", "at", "digest", "n", F.lit(1).cast("long").alias("below"), "runs"), scratch, "level")
    subroots = reduce(DataFrame.unionByName, (level.where("n = 1").select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest", "below") for level in levels))
    ranked = _placed(scratch.written(subroots, "subroots"), scratch, "all", ["of"], "ranked")
    tops = scratch.written(ranked.select(F.col("all").alias("tree"), "of", F.col("_at").alias("at"), "digest", F.col("_n").alias("n"), "below", F.lit(0).cast("long").alias("runs")), "tops")
    above = _above(_levels(tops, scratch, "top"))
    columns = ["node", "kids", "digest", "own", "parent", "place", "copies", "subroot"]
    parts = [_link(nodes, k, above[0]).withColumns({"node": _name(k, F.col("at"), F.col("tree")), "own": _copies(F.col("below"))}) for k, nodes in list(enumerate(levels, 1))[1:]]
    parts += [nodes.withColumns({"node": F.concat_ws("|", F.lit("top"), F.lit(k), "at"), "own": _copies(F.col("below")), "subroot": F.lit(None).cast("binary")}) for k, nodes in list(enumerate(above))[1:]]
    runs = scratch.written(_link(runs, 1, above[0]).withColumn("name", _name(1, F.col("at"), F.col("tree"))), "linked")
    scratch.remove("runs")
    empty = runs.sparkSession.createDataFrame([], f"node string, kids array<binary>, {', '.join(f'{c} {runs.schema[c].dataType.simpleString()}' for c in ('digest',))}, own long, parent string, place int, copies long, subroot binary")
    nodes = reduce(DataFrame.unionByName, (p.select(*columns) for p in parts), empty)
    nodes = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))).drop("own")
    return Manifest(scratch, runs, scratch.written(nodes, "nodes"))


#: c.folded: of each leaf of the run, the node's digest as it follows from the hash that is folded.
_CLIMB = """
WITH RECURSIVE climb (name, lane, parent, place, copies, subroot, digest, folded, siblings) AS (
  SELECT name, xxhash64(name), parent, place, copies, subroot, digest, folded, CAST(array() AS ARRAY<BINARY>) FROM {runs}
  UNION ALL
  SELECT c.name, c.lane, n.parent, n.place, n.copies, coalesce(c.subroot, n.subroot), n.digest,
         transform(c.folded, f -> unhex(sha2(array_join(transform(n.kids, (k, i) -> lower(hex(CASE WHEN i = c.place THEN f ELSE k END))), ''), 256))),
         concat(c.siblings, filter(n.kids, (k, i) -> i <> c.place))
  FROM climb c JOIN {nodes} n ON n.node = c.parent AND n.copy = pmod(c.lane, c.copies)
)
SELECT name, subroot, digest AS root, folded, siblings FROM climb WHERE parent IS NULL
"""


def _climbed(manifest: Manifest) -> DataFrame:
    """(name, subroot, root, folded, siblings) of each run, written."""
    spark = manifest.runs.sparkSession
    kids = F.col("leaves")
    own = F.transform(kids, lambda x, i: F.when(F.col("of") == 1, x["folded"]).otherwise(_digest(F.transform(kids, lambda y, j: F.when(i == j, x["folded"]).otherwise(y["digest"])))))
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, "-1")
    try:
        runs = manifest.runs.select("name", "parent", "place", "copies", "subroot", "digest", own.alias("folded"))
        return manifest.scratch.written(spark.sql(_CLIMB, runs=runs, nodes=manifest.nodes), "climbed")
    finally:
        spark.conf.set(limit, before)


def proved(manifest: Manifest) -> DataFrame:
    """(key, tree, leaf, subroot, root, proof, folded_root): a row for each leaf, proof being the siblings from
    below, folded_root the root that follows from the other values and the proof; digests as 32 bytes."""
    met = manifest.runs.select("name", "tree", "leaves").join(_climbed(manifest), "name")
    each = met.select("*", F.posexplode("leaves").alias("_i", "_leaf"))
    beside = F.transform(F.filter("leaves", lambda x, i: i != F.col("_i")), lambda x: x["digest"])
    return each.select(F.col("_leaf.key").alias("key"), "tree", F.col("_leaf.digest").alias("leaf"), "subroot", "root", F.concat(beside, "siblings").alias("proof"), F.get("folded", F.col("_i")).alias("folded_root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    leaves = proved(built(table(spark, sf_dir, "documents"), other={"text": tampered}))
    digests = [_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return leaves.select(
        F.col("key").alias("doc_id"), *digests, F.sha2(_joined(F.col("proof")), 256).alias("proof_sha256"), _hex(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified")
    )


_value_sql = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_LEAF = "sha256(" + " || ".join(map(_value_sql, FIELDS)) + ")"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BAD = "sha256(" + " || ".join(_value_sql(c) if c != "text" else f"coalesce(strlen({_LOW})::VARCHAR || ':' || {_LOW}, '-')" for c in FIELDS) + ")"
SQL = f"""
WITH RECURSIVE leaf AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_BAD} ELSE {_LEAF} END AS given FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, given, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low AS (
  SELECT source, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // {RUN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM low WHERE n > 1 GROUP BY source, level, n, pos // {RUN}
),
sub AS (SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // {RUN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM top WHERE n > 1 GROUP BY level, n, pos // {RUN}
),
node AS (
  SELECT coalesce('=' || source, '-') AS tree, level, pos, h, n FROM low WHERE n > 1
  UNION ALL SELECT 'top', level, pos, h, n FROM top WHERE n > 1
),
run AS (SELECT tree, level, pos // {RUN} AS up, list(h ORDER BY pos) AS hs FROM node GROUP BY ALL),
climb AS (
  SELECT p.rid, CASE WHEN p.n = 1 THEN 'top' ELSE coalesce('=' || p.source, '-') END AS tree, 0 AS level, CASE WHEN p.n = 1 THEN s.pos ELSE p.pos END AS pos, s.height AS height, s.pos AS rank, given AS h, '' AS proof
  FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT rid, CASE WHEN c.tree <> 'top' AND c.level + 1 = height THEN 'top' ELSE c.tree END, CASE WHEN c.tree <> 'top' AND c.level + 1 = height THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.tree <> 'top' AND c.level + 1 = height THEN rank ELSE c.pos // {RUN} END, height, rank,
         sha256(array_to_string(hs[1:(c.pos % {RUN})::BIGINT], '') || c.h || array_to_string(hs[(c.pos % {RUN})::BIGINT + 2:], '')),
         proof || array_to_string(hs[1:(c.pos % {RUN})::BIGINT], '') || array_to_string(hs[(c.pos % {RUN})::BIGINT + 2:], '')
  FROM climb c JOIN run r ON r.tree = c.tree AND r.level = c.level AND r.up = c.pos // {RUN}
),
done AS (SELECT c.* FROM climb c WHERE c.tree = 'top' AND c.level = (SELECT max(level) FROM top))
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN done c USING (rid) CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""
