"""Groups that hold many rows: dealt over several tasks before a join, numbered in order by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a key that one task joins. Up to BROADCAST_KEYS keys with more are sent to all tasks.
MOST_ROWS, BROADCAST_KEYS = 5_000, 100_000


def split_keys(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None, by: Column | None = None, hint: str | None = "merge") -> tuple[DataFrame, DataFrame]:
    """left and right with _split, to be joined on [*keys, "_split"]: a key with more than `most` rows on the
    left has them dealt out over splits by a hash of `by` (of all columns, if there is none), and its rows on
    the right stand in each split. The right asks for a merge join, unless told otherwise: sizes are guessed from small files, and a
    guess that is too low sends all of a table through the driver. Counts are added up before they are shuffled; keys with few rows have one
    split, and there are no more crowded keys than rows on the left / most."""
    most = most or MOST_ROWS
    asking = lambda df: df.hint(hint) if hint else df
    crowded = left.groupBy(*keys).count().where(F.col("count") > most).select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("count") / most).cast("int").alias("_splits"))
    found = crowded.limit(BROADCAST_KEYS + 1).count()
    if not found:
        none = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # 0, but no constant, which joins would do without
        return left.withColumn("_split", none), asking(right.withColumn("_split", none))
    if found <= BROADCAST_KEYS:
        crowded = F.broadcast(crowded)
    met = [F.col(k) == F.col(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    own = by if by is not None else F.xxhash64(*(c for c in left.columns))
    one = left.join(crowded, met, "left").withColumn("_split", F.pmod(own, splits).cast("int")).drop(*names, "_splits")
    other = right.join(crowded, met, "left").withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1))).drop(*names, "_splits")
    return one, asking(other)


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "_i") -> DataFrame:
    """rows with their place from 0 in the order of their group. Rows are dealt by ranges of (group, order) and
    written; a place is that in its part plus the group's rows in the parts before, so that no task holds a
    group. Order columns tell rows apart, or else equal rows may lie either way."""
    scratch = Scratch(rows.sparkSession)
    part, within = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_within")
    dealt = scratch.written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", part, within), "dealt")
    ends = dealt.groupBy(F.col(group).alias("_of"), F.col("_part").alias("_at")).agg(F.min("_within").alias("_first"), F.count("*").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    ends = scratch.written(ends.select("_of", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "ends")
    if ends.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        ends = F.broadcast(ends)
    met = dealt.join(ends, dealt[group].eqNullSafe(ends["_of"]) & (dealt["_part"] == ends["_at"]))
    return met.select(*(F.col(c) for c in rows.columns), (F.col("_within") + F.col("_shift")).alias(name))
