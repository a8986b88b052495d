"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces, counted without building them. The vocabulary is a trie with
two roots, one for pieces that begin a word and one for pieces that continue it. Every node has a
failure link to the node where matching goes on after the pieces that its path begins with are popped,
and the number of those pieces, both precomputed; so each byte of a word is read once, with an amortised
constant number of steps, and a word's token count is the sum of the popped counts.

Words are maximal runs of bytes other than ASCII white space, in UTF-8. A word that can't be tiled by
pieces counts as one unknown token, as usual for word pieces. The vocabulary is that of a public
byte-level tokenizer file, whose path is a parameter: entries with the leading space marker begin words,
the others continue them.

Each task keeps the counts of up to CACHE words it has seen; that bounds memory and changes no result.
Defined results: null and empty texts have 0 words and 0 tokens; repeated rows are counted each; a word may
be of any length, and very long texts are counted whole; an empty table gives an empty one; other columns
are not read, so that their names don't matter.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_or_empty

CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, and the bytes they stand for."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that continue one) of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    begin, go_on = [], []
    for token in vocab:
        if all(c in alphabet for c in token):
            piece = bytes(alphabet[c] for c in token)
            if piece[:1] == b" " and len(piece) > 1:
                begin.append(piece[1:])
            elif piece.strip():
                go_on.append(piece)
    return begin, go_on


class LongestMatch:
    """The automaton. Nodes are numbers; edges are looked up by node * 256 + byte."""

    START, GO_ON = 0, 1

    def __init__(self, begin: list[bytes], go_on: list[bytes]):
        edges: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((self.START, begin), (self.GO_ON, go_on)):
            for piece in pieces:
                at = root
                for byte in piece:
                    key = at * 256 + byte
                    if key not in edges:
                        edges[key] = len(ends)
                        ends.append(False)
                    at = edges[key]
                ends[at] = True
        self.edges = edges
        n = len(ends)
        self.fail, self.popped = [-1] * n, [0] * n
        parent = {child: divmod(key, 256) for key, child in edges.items()}
        depth = [0] * n
        for child in range(2, n):
            depth[child] = depth[parent[child][0]] + 1
        for node in sorted(range(2, n), key=depth.__getitem__):
            if ends[node]:  # its whole path is the longest piece: pop it, and go on from the second root
                self.fail[node], self.popped[node] = self.GO_ON, 1
                continue
            up, byte = parent[node]
            at, count = self.fail[up], self.popped[up]
            while at >= 0 and at * 256 + byte not in edges:
                at, count = self.fail[at], count + self.popped[at]
            if at >= 0:
                self.fail[node], self.popped[node] = edges[at * 256 + byte], count

    def count(self, word: bytes) -> int:
        """The number of greedy pieces; 0 if the pieces don't tile the word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at, n = self.START, 0
        for byte in word:
            while (to := edges.get(at * 256 + byte, -1)) < 0:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != self.GO_ON:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*byte_pieces(path))


class _Counts(dict):
    """Word -> (its tokens, or 0 for an unknown one), found when first asked for."""

    def __init__(self, machine: LongestMatch):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.machine.count(word)
        self[word] = n
        return n


@lru_cache(maxsize=2)
def _cache(path: str) -> _Counts:
    return _Counts(automaton(path))


def count_texts(texts: pd.Series, path: str) -> pd.DataFrame:
    counts = _cache(path).__getitem__
    words, tokens, unknown = [], [], []
    for text in texts:
        each = list(map(counts, text.encode().split()))
        bad = each.count(0)
        words.append(len(each))
        tokens.append(sum(each) + bad)
        unknown.append(bad)
    return pd.DataFrame({"n_words": words, "n_tokens": tokens, "n_unknown": unknown}, dtype="int64")


def token_counts(column: str, path: str) -> Column:
    """A struct (n_words, n_tokens, n_unknown) of each text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return count_texts(texts, path)

    return F.pandas_udf(run, "n_words long, n_tokens long, n_unknown long")(text_or_empty(column))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", token_counts("text", default_vocabulary()).alias("c"))
    return docs.select("doc_id", "c.n_words", "c.n_tokens", "c.n_unknown")
