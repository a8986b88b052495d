"""The pipeline on rows with nulls, blanks, repeats and clashing names, and on an empty table."""

import pytest
from pyspark.sql import functions as F

PROSE = "the river ran over the stones and under the old bridge where we met on a quiet day in late spring with "
LONG = [PROSE + " ".join(f"w{k:02d}x{j:02d}" for j in range(80)) for k in range(12)]


@pytest.fixture
def folder(spark, tmp_path):
    from ..oracle import TABLES

    for t in TABLES:
        if t not in ("documents", "benchmark"):
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return tmp_path


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _spans string, ids string, node long, `a b` string"


def test_awkward_rows(spark, folder):
    import corpus_pipeline

    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t), f"s{k}", f"i{k}", k, "x") for k, t in enumerate(LONG)]
    rows += [(3, *rows[3][1:])] * 2 + [(50, LONG[5], None, None, None, None, None, None, None), (None, LONG[6], "en", "s", 1, None, None, None, None)]
    rows += [(60, None, "en", "s", 0, None, None, None, None), (61, "", None, None, None, None, None, None, None), (62, "short text", "en", "s", 10, None, None, None, None)]
    rows.append((70, LONG[7].replace("w07x", "z09y") + " one two three four five six seven", "en", "s", 1, None, None, None, None))
    rows.append((71, LONG[8].replace("w08x", "q08y") + " password = hunter2222", "en", "s", 1, "keep", "keep", 7, "keep"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    kept = [r.doc_id for r in got]
    assert sorted(k for k in kept if k is not None) == [*range(12), 71], kept
    by = {r.doc_id: r for r in got}
    assert "[SECRET]" in by[71].text and "hunter" not in by[71].text and (by[71]["a b"], by[71].node) == ("keep", 7)
    assert all(r["_spans"] in (f"s{r.doc_id}", "keep", None) for r in got)


def test_empty_table(spark, folder):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).withColumn("n_chars", F.col("n_chars")).write.parquet(str(folder / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 0
