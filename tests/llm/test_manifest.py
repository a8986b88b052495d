"""The manifest against a plain hash tree, on groups of all sizes, and its SQL on awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from geoloom.llm import manifest, queries

from ..oracle import TABLES, same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level):
    """(root, siblings and places of each node) of a list of digests"""
    paths = [[] for _ in level]
    owners = [[k] for k in range(len(level))]
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for k, own in enumerate(owners):
            for o in own:
                paths[o].append((runs[k // 16], k % 16))
        owners = [sum(owners[k : k + 16], []) for k in range(0, len(owners), 16)]
        level = [h(*r) for r in runs]
    return level[0], paths


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text): the contract, step by step"""
    null_first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
        groups.setdefault(r[1], []).append((null_first(r[0]), leaf(r), leaf((*r[:4], low)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, one, given, doc_id), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            proof, at = "", given
            for run, place in [*path, *top]:
                proof += "".join(run[:place] + run[place + 1 :])
                at = h(*run[:place], at, *run[place + 1 :])
            out.append((doc_id, one, trees[s][0], root, h(proof), at, at == root))
    return out


def documents(spark, rows, tmp_path):
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


SIZES = {None: 3, "": 1, "-": 2, "=": 17, "a": 16, "b": 15, "é": 257, "z": 700, "Z": 1}


def some(sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, "en" if k % 3 else None, k if k % 4 else None, None if k % 7 == 0 else "" if k % 11 == 0 else f"Text É {k} ABC"))
            k += 1
    return rows


def test_as_the_plain_tree_and_its_sql(spark, tmp_path):
    rows = [*some(SIZES), (None, "a", None, None, "X"), (None, "a", None, None, "X"), (5, "z", "en", 1, "Z" * 200_000), *[(40, "b", "en", 2, "Same")] * 40]
    folder = documents(spark, rows, tmp_path)
    got = queries.queries()["op13_manifest"](spark, folder)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(tuple(r) for r in got.collect()) == text(plain(rows))
    tampered = got.where("not verified").count()
    assert 0 < tampered < got.count() / 3
    same(queries.queries()["op13_manifest"], queries.oracle_sql()["op13_manifest"], spark, folder)


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1}, {"a": 16}, {"a": 17}, {str(k): 1 for k in range(40)}, {f"s{k}": 1 + k % 3 * 15 for k in range(300)}], ids=lambda s: f"{len(s)}-{sum(s.values())}")
def test_trees_of_all_shapes(spark, tmp_path, sizes):
    rows = some(sizes)
    got = queries.queries()["op13_manifest"](spark, documents(spark, rows, tmp_path))
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(tuple(r) for r in got.collect()) == text(plain(rows) if rows else [])


def test_nodes_are_linked_and_copied(spark, monkeypatch):
    """With a copy for each two runs, the rows stay; every node but the root names a parent that exists."""
    docs = spark.createDataFrame(some(SIZES), "doc_id long, source string, lang string, n_chars int, text string").withColumns({"tree": F.lit(1), "node": F.lit("x"), "key": F.lit(2), "digest": F.lit(3)})
    before = {r.key: (r.root, r.folded_root, r.proof) for r in manifest.proved(manifest.built(docs)).collect()}
    monkeypatch.setattr(manifest, "COPY_RUNS", 2)
    monkeypatch.setattr(manifest, "BROADCAST_PARTS", 0)
    monkeypatch.setattr(manifest, "PART_ROWS", 100)
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    tree = manifest.built(docs)
    assert {r.key: (r.root, r.folded_root, r.proof) for r in manifest.proved(tree).collect()} == before
    nodes = tree.nodes.collect()
    names = {n.node for n in nodes}
    assert max(n.copy for n in nodes) > 10 and sum(n.parent is None for n in nodes) == len({n.node for n in nodes if n.parent is None}) * len([n for n in nodes if n.parent is None])
    assert all(n.parent is None or n.parent in names for n in nodes) and all(r.parent in names for r in tree.runs.collect())
    assert all(root == folded for root, folded, _ in before.values()) and spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
