"""Items of one to four words are found inside longer documents."""

import re

from geoloom.llm import containment


def test_short_items_inside_documents(spark):
    items = [(1, "Paris"), (2, "the Red   fox"), (3, "forty-two is it"), (4, "Red fox"), (5, ""), (6, "the red fox"), (7, "one two three four five")]
    docs = [(1, "Far away in paris the red fox ran on and on"), (2, "forty two is it"), (3, "the red. Fox"), (4, "red"), (5, ""), (6, None), (7, "Say: forty two is it not? In PARIS! Red-fox; one two three four five six"), (8, "parisian fox red the")]
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    has = lambda d, i: any(d[k : k + len(i)] == i for k in range(len(d) - len(i) + 1))
    want = {(d, i) for d, t in docs for i, u in items if split(u) and has(split(t), split(u))}
    found = containment.with_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r.doc_id, m.item_id, m.containment, m.item_shingles) for r in found.collect() for m in r["_matches"]]
    assert sorted(rows) == sorted((d, i, 1.0, 1) for d, i in want)
    assert {(1, 1), (1, 2), (7, 3)} <= want
