"""BPE encoding and decoding with forced boundaries.

Merges only ever make tokens of the vocabulary. So two neighbouring byte symbols that are next to each
other inside no token never end up in one token: between them is a certain cut. Every pre-token is
split at its certain cuts, the fragments are encoded independently, and the ids concatenated.

The tokenizer file gives vocabulary, merges, normalisation and pre-token pattern; its path is a
parameter. Supported are files with NFC, white-space folding and lower case, a split pattern, byte-level
symbols and an end-of-word suffix, without post-processor or decoder. Added tokens found in the raw text
become their ids. Decoding joins the tokens' strings with spaces, as the tokenizers library does for a
file without decoder.

Each task keeps the ids of up to CACHE pre-tokens; that bounds memory and changes no result.
Defined results: null and empty texts have no ids, and decode to the empty text; of merges with equal rank
the leftmost comes first; repeated rows are encoded each; very long texts are encoded whole, a long fragment
in n log n steps; an empty table gives an empty one; other columns pass through, whatever their names (ids
and decoded take the first free name, ids_1, ..., where docs has such a column).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import free, hand_back, small_batches, table
from .token_counts import byte_alphabet
from .wordhash import slices

CACHE, BATCH_BYTES, LONG = 150_000, 1 << 19, 200
#: White space as the tokenizer's pattern engine has it (Unicode's White_Space property).
_WHITE = "\t-\r \x85\xa0  -     　"


class _Seen(dict):
    """Pre-token -> its ids, found when first asked for."""

    def __init__(self, tool: ForcedBoundaryBPE):
        super().__init__()
        self.tool = tool

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.tool.ids(word)
        return found


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("post_processor") or spec.get("decoder") or model.get("continuing_subword_prefix"):
            raise ValueError("files with a post-processor, a decoder or continuing prefixes are not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        if any(t.get(k) for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that are normalised, stripped or single words are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*self.vocab.values(), *self.added.values()]) + 1, object)
        for token, k in [*self.vocab.items(), *self.added.items()]:
            self.tokens[k] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: k for k, p in reversed(list(enumerate(pairs)))}
        # Neighbours inside any token; the suffix belongs to the last symbol.
        self.inside: set[tuple[str, str]] = set()
        for token in self.vocab:
            s = self.symbols(token)
            self.inside.update(zip(s, s[1:], strict=False))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", _WHITE))
        #: The same pattern where all characters are ASCII, for the quicker engine.
        self.ascii_pattern = re.compile(split["pattern"]["Regex"].replace("[^\\s\\p{L}\\p{N}]", r"[^\t-\r 0-9A-Za-z]").replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]"))
        self.raw = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.raw_starts = {t[0] for t in self.added}
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.bytes = [stand_in[b] for b in range(256)]
        self.cache = _Seen(self)

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            s = list(token[: -len(self.suffix)])
            s[-1] += self.suffix
            return s
        return list(token)

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """Parts between certain cuts."""
        out, at = [], 0
        for k in range(1, len(symbols)):
            if (symbols[k - 1], symbols[k]) not in self.inside:
                out.append(symbols[at:k])
                at = k
        out.append(symbols[at:])
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """The ids of a fragment: the merge of lowest rank first, and of those the leftmost."""
        if len(symbols) > LONG:
            return self.merge_long(symbols)
        ranks, none = self.ranks.get, len(self.ranks)
        each = [ranks(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while each and (low := min(each)) < none:
            k = each.index(low)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del each[k]
            if k:
                each[k - 1] = ranks((symbols[k - 1], symbols[k]), none)
            if k < len(each):
                each[k] = ranks((symbols[k], symbols[k + 1]), none)
        return [self.vocab[s] for s in symbols]

    def merge_long(self, symbols: list[str]) -> list[int]:
        """The same in n log n steps: a heap of pairs by rank and place, over a linked list."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], k, *p) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        now: list[str | None] = list(symbols)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            to = after[k]
            if now[k] != a or to < 0 or now[to] != b:
                continue
            now[k], now[to] = a + b, None
            after[k] = after[to]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (pair := (now[x], now[y])) in ranks:
                    heapq.heappush(heap, (ranks[pair], x, *pair))
        return [self.vocab[s] for s in now if s is not None]

    def ids(self, word: str) -> bytes:
        """The ids of a pre-token, four bytes each."""
        bytes_of = self.bytes
        symbols = [bytes_of[b] for b in word.encode()]
        symbols[-1] += self.suffix
        if self.inside.issuperset(zip(symbols, symbols[1:], strict=False)):  # no certain cut
            return array("i", self.merge(symbols)).tobytes()
        return array("i", [i for part in self.fragments(symbols) for i in self.merge(part)]).tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        """White space is in no pre-token, so that folding it first would change none."""
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        # Lower case goes letter by letter: no final form of sigma.
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> bytes:
        parts = self.raw.split(text) if any(c in text for c in self.raw_starts) else [text]
        out: list[bytes] = []
        for part in parts:
            if part in self.added:
                out.append(np.int32(self.added[part]).tobytes())
            elif part:
                out += map(self.cache.__getitem__, self.pre_tokens(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def with_ids(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text (array<int>) and, if a name is given for them, the texts decoded from
    those ids. Results leave a task in batches of about BATCH_BYTES of text, however large it gets them."""
    at = docs.columns.index(column)
    ids, decoded = free(docs, ids), free(docs, decoded) if decoded else None
    schema = StructType(docs.schema.fields + [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for begin, _, offsets in slices(batch.column(at), BATCH_BYTES):
                part = batch.slice(begin, len(offsets) - 1)
                found = [tool.encode(t) if t else b"" for t in part.column(at).to_pylist()]
                flat = np.frombuffer(b"".join(found), np.int32)
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([tool.decode(np.frombuffer(x, np.int32)) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        hand_back()

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)


def with_decoded(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids; null ids decode to the empty text."""

    def run(column: pd.Series) -> pd.Series:
        decode = codec(path).decode
        return pd.Series([decode(np.asarray(x, np.int64)) if x is not None else "" for x in column], dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return docs.withColumn(free(docs, decoded), F.pandas_udf(run, "string")(F.col(f"`{ids}`")))


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs' ids and decoded texts, as digests."""
    both = with_ids(docs.select("doc_id", "text"), path, decoded="decoded").select("doc_id", "ids", "decoded")
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text"), default_file())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' columns, their ids and the decoded texts."""
    return with_ids(small_batches(docs), default_file(), decoded="decoded")
