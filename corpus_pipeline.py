"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Quality rules drop documents that fail; of near duplicates one stays; documents that contain a benchmark
item go; secrets are replaced by a mark; the rest is encoded, and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe, containment, jaccard_join, quality_rules, secrets
from geoloom.llm.shared import Scratch

STAGES = [
    ("quality rules", quality_rules.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", containment.stage),
    ("secret scans", secrets.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: SQL has no byte-pair encoding; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), folder := name.replace(" ", "-"))
        if before:
            scratch.remove(before)
        before = folder
    return docs
