"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, from two hashes of its name.
Shards take turns: each claims the first slot of its permutation that nobody has, until no slot is free.
Loads then differ by one slot, and when shards come or go few slots change hands. A row goes to the
shard of the slot that its key hashes to: one hash and one lookup.

The table has TABLE_SIZE rows unless a larger one is asked for, MOST_SLOTS at most, so it is broadcast;
rows aren't shuffled. A key is taken as text, and its slot comes from its MD5 digest, which any engine has.

Defined results: a null key is no key: the row is placed by its fallback columns, so that many null keys
don't meet in one shard; without fallback columns, or where all of them are null, by the empty text. Equal
keys go to the same shard, repeated rows among them. Keys may be of any length. An empty table gives an
empty one. Other columns pass through, whatever their names; slot and shard take the first free name
(slot_1, ...) where df has such a column.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, table

TABLE_SIZE, MOST_SLOTS = 65_537, 1 << 20
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot, the index of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime of at least the number of shards and at most {MOST_SLOTS}")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    # Turns go round by name, so that the order in which the shards are listed doesn't matter.
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    slots = np.full(size, -1, np.int64)
    left = size
    while left:
        for k in turns:
            while slots[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            slots[at[k]] = k
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the digest, modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, fallback: tuple[str, ...] = ()) -> DataFrame:
    """df with slot and shard (the shard's name)."""
    slot, shard, at = free(df, "slot"), free(df, "shard"), free(df, "_at")
    names = df.sparkSession.createDataFrame([(s, shards[k]) for s, k in enumerate(lookup(shards, size).tolist())], "at int, shard string").toDF(at, shard)
    placed = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat_ws("\x1f", *(F.col(f"`{c}`").cast("string") for c in fallback)))
    return df.withColumn(slot, slot_of(placed, size)).join(F.broadcast(names), F.col(slot) == F.col(at)).drop(at)


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], size: int = TABLE_SIZE, files: int = 1, fallback: tuple[str, ...] = ()) -> None:
    """One folder for each shard, with `files` Parquet files each; rows of a shard are dealt to its
    files by their slot, so that a shard is never one task's work unless files is 1."""
    sharded, slot, shard = assign(df, key, shards, size, fallback), free(df, "slot"), free(df, "shard")
    part = F.pmod(F.hash(slot, F.lit("file")), F.lit(files))
    sharded.repartition(len(shards) * files, shard, part).write.partitionBy(shard).parquet(path)


def _names() -> list[str]:
    return [f"shard-{k:03d}" for k in range(SHARDS)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return assign(docs, "doc_id", _names(), fallback=("lang", "source", "n_chars")).select("doc_id", "slot", "shard")


def _sql() -> str:
    """The table goes along as text, two digits a slot; tests hold it against a plain filling."""
    digits = "".join(f"{k:02d}" for k in lookup(_names()))
    return f"""
WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, concat_ws(chr(31), lang, source, n_chars)) AS k FROM documents),
s AS (SELECT doc_id, (('0x' || substr(md5(k), 1, 15))::BIGINT % {TABLE_SIZE})::INT AS slot FROM k)
SELECT doc_id, slot, 'shard-0' || substr('{digits}', 2 * slot + 1, 2) AS shard FROM s
"""


SQL = _sql()
