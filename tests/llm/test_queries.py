"""The registered queries against their SQL, and the pipeline against brute force."""



import pytest

from geoloom.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_for_each_document(spark, small, name):
    assert queries.queries()[name](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_pipeline(spark, small):
    """Every stage on its own input: rules from SQL, links and containment by brute force, redaction by
    regular expressions, ids by the tokenizers library."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from geoloom.llm import bpe, jaccard_join, quality_rules

    from .test_operators import brute_join, grams, spans_of

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.op10_quality_rules(spark, small).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    sim = jaccard_join.Similarity()
    first = {c for _, _, c, _ in brute_join(rows, sim.size, sim.percent)}
    items = [grams(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {}
    tool = Tokenizer.from_file(bpe.default_file())
    for k, t in rows:
        if k not in first or any(i and len(i & grams(t)) >= 0.8 * len(i) for i in items):
            continue
        out, at = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans_of(t)):
            if a >= at:
                out, at = out + t[at:a] + "[SECRET]", b
            at = max(at, b)
        clean = out + t[at:]
        want[k] = (clean, tool.encode(clean, add_special_tokens=False).ids)
    got = {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and want

