"""Every language is learnt."""

from geoloom.llm.language_id import training_counts


def test_languages_beyond_four_hundred(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 450}") for k in range(900)], "doc_id long, text string, lang string")
    assert {c[0] for c in training_counts(docs)} == {f"l{k}" for k in range(450)}
