"""What the operators of this subpackage share: tables, the shared folder, names, batches of rows."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written to a folder of their own in the shared folder and read again."""
    return Scratch(df.sparkSession).written(df, name)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def free(df: DataFrame, name: str) -> str:
    """The name, or the first of name_1, name_2, ... that no column of df has, in either case."""
    taken, k, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def own_columns(df: DataFrame) -> list[F.Column]:
    """All columns, whatever signs their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def small_batches(df: DataFrame) -> DataFrame:
    """df, for queries and pipeline stages, which own their session: it hands rows to Python BATCH_ROWS at a
    time from then on where nothing smaller is set, as texts are long, and a batch is held by the JVM and by
    Python at once. Operators leave the session as it is."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def once(udf):
    """The function, marked so that the planner evaluates it once and reads its column: a filter on what it
    gives would otherwise be pushed below it with a second copy of it, and with workers of its own."""
    return udf.asNondeterministic()


def hand_back() -> None:
    """Gives memory that a task has freed back to the system: workers go on to other tasks, and would keep
    the most that any of them took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
