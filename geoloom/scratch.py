"""Tables that a run writes for itself, below the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine serves local
    sessions (tests); on a cluster, where executors wouldn't share it, that is an error. Within `temporary` it
    lies in the folder that goes at its end."""
    base = _owner.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="geoloom-"))
        base = _own[0]
    return f"{base.rstrip('/')}/geoloom-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Owns all tables that operators write in its body: they are removed at its end, by when what is to stay
    must have been written elsewhere. Without an owner they stay for the results that read them."""
    base = shared_folder(spark)
    token = _owner.set(base)
    try:
        yield
    finally:
        _owner.reset(token)
        _delete(spark, base)


class Scratch:
    """A folder for the tables of one run: each is written and read again, so that later jobs don't compute
    it anew and a lost executor doesn't take it along, and can be removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_folder(spark)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def remove(self, *names: str) -> None:
        """Removes tables that no result still to be computed reads."""
        for name in names:
            _delete(self.spark, self.path(name))


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to a folder of their own and read again, which ends their lineage."""
    return Scratch(df.sparkSession).written(df, "rows")
