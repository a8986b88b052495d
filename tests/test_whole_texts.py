"""The source queries read whole texts of all documents: held against brute force on small tables."""

import math
import re

import pytest

from geoloom import catalog
from geoloom.sources.web import BOILERPLATE

QUERIES = catalog.queries()
TEXTS = [
    "Population of a town. Please wait for it. It was 17 in all.",
    "",
    None,
    "पूरी जनसंख्या",
    "one two three\nfour five. " * 400 + "the population is 23",
    "é17 is a word, 17 is not",
    "Enable JavaScript. Please wait",
]
DOCS = [(k, TEXTS[k % len(TEXTS)], f"site{k % 3}") for k in range(700)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def _url(k, source, urls=300):
    return f"https://{source}.{'census.gov' if k % 20 == 0 else 'org'}/{k % urls}{'.csv' if k % 7 == 0 else ''}"


def _snippet(k, text, more):
    raw = (text or "") + ("\nPlease wait\nChecking your browser now" if k % 10 == 0 else "") + more
    return " ".join(p for p in re.split(r"(?<=[.!?])\s+|\n+", raw) if not re.search(BOILERPLATE, p, re.I))


def test_useful_sources_of_whole_texts(spark, tables):
    want = {}
    for k, text, _ in DOCS:
        s = _snippet(k, text, "\nPlease wait." if k % 6 == 0 else "\nSome words. Please wait now. More words")
        if k % 3 or re.search(r"[^\W_]", s):
            want[k] = s
    got = {r["pos"]: r["snippet"] for r in QUERIES["fil13_useful"](spark, tables).collect()}
    assert got == want and 0 < len(want) < len(DOCS)


def test_sources_are_ranked_by_whole_texts(spark, tables):
    words, real = {}, ("population", "thnd", "17", "23")
    for k, text, source in DOCS:
        title = "Item " + " ".join((text or "").split(" ")[:2])
        words[k] = set(re.findall(r"[^\W_]+", f"{title} {_snippet(k, text, f'\nthnd {k % 40}')} {_url(k, source)}".lower()))
    n = len(words)
    weight = {w: 1 + math.log((n + 1) / (1 + sum(w in x for x in words.values()))) for w in real}
    best = {}
    for k, _, source in DOCS:
        score = sum(weight[w] for w in real if w in words[k]) + 0.1 * sum(w in words[k] for w in ("csv", "data")) + (1.5 if k % 20 == 0 else 0) + (0.25 if k % 7 == 0 else 0)
        u = _url(k, source)
        best[u] = max(best.get(u, (-1, 0)), (score, -k))
    want = sorted(((-p, s) for s, p in best.values()), key=lambda x: (-round(x[1], 9), x[0]))[:8]
    got = [(r["pos"], r["score"]) for r in QUERIES["win5_sources"](spark, tables).collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_results_list_all_documents(spark, tables):
    want = {}
    for which, urls in enumerate((300, 450)):
        for k, _, source in DOCS:
            want.setdefault(_url(k, source, urls), (which, k))
    got = {r["url"]: (r["list"], r["pos"]) for r in QUERIES["set3_results"](spark, tables).collect()}
    assert got == want and {w[0] for w in want.values()} == {0, 1}
