"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes, with the counts of the bytes that follow
them in a training sample. The code length of a byte under a language is exact: the longest known
context codes it, or codes an escape (as likely as the number of different bytes seen there, method C)
and leaves it to the next shorter one, bytes already ruled out being excluded; below the empty context
all remaining bytes are equally likely. Statistics are frozen, so a byte's code length depends only on
itself and the ORDER bytes before it: each such window is worked out once and looked up afterwards. The
language with the shortest code for the whole text wins; the score is its posterior probability under
equal priors.

Training reads a bounded sample: about TRAIN_DOCS documents per language, chosen by a hash of doc_id
among the rows that may be learnt from. Texts are lower-cased, and everything ASCII that isn't a letter
counts as a space.

Defined results: null texts, and texts without a letter, are `und` with score 0; of languages with equal
code lengths the first by name wins; rows with a null lang are scored but not learnt from; rows with a null
doc_id are never held out; repeated rows are scored each; very long texts are coded whole; with nothing to
learn from every text is `und`; an empty table gives an empty one; other columns pass through, whatever
their names (`identified` adds its column under its name or the first free one, name_1, ...).
"""

from __future__ import annotations

from collections import defaultdict
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, once, small_batches, table

ORDER, TRAIN_DOCS, CACHE, SLOTS = 3, 600, 1_000_000, 1 << 21
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_PAD = b" " * ORDER


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(4)) == 2


def folded(text: str | None) -> bytes:
    """The bytes that are scored, after ORDER spaces; empty if the text has no letter."""
    if not text:
        return b""
    parts = text.lower().encode().translate(_FOLD).split()
    if not parts or not (text.isascii() or any(c.isalpha() for c in text)):
        return b""
    return _PAD + b" ".join(parts)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ORDER + 1 bytes as numbers, and the first index of each text (and one more)."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    sizes = np.fromiter((max(0, len(t) - ORDER) for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = len(data) - ORDER
    if n <= 0:
        return np.zeros(0, np.uint32), first
    all_of = sum(data[k : n + k] << np.uint32(8 * (ORDER - k)) for k in range(ORDER + 1))
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    at = np.repeat(starts - first[:-1], sizes) + np.arange(first[-1])
    return all_of[at], first


class Model:
    """Context trees of all languages. counts: (language, window, times)."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.languages = sorted({c[0] for c in counts})
        self.trees = [[defaultdict(lambda: defaultdict(int)) for _ in range(ORDER + 1)] for _ in self.languages]
        place = {lang: k for k, lang in enumerate(self.languages)}
        for lang, window, times in counts:
            for k in range(ORDER + 1):
                self.trees[place[lang]][k][(window >> 8) & ((1 << 8 * k) - 1)][window & 255] += times
        self.trees = [[{c: dict(s) for c, s in by.items()} for by in tree] for tree in self.trees]
        self.known = np.unique(np.array([c[1] for c in counts], np.uint32))
        self.costs = np.array([self.code_lengths(int(w)) for w in self.known], np.float64).reshape(len(self.known), len(self.languages))

    def code_lengths(self, window: int) -> list[float]:
        """Bits for the last byte of the window, under each language."""
        symbol, before, out = window & 255, window >> 8, []
        for tree in self.trees:
            bits, ruled_out = 0.0, set()
            for k in range(ORDER, -1, -1):
                seen = tree[k].get(before & ((1 << 8 * k) - 1))
                if not seen:
                    continue
                live = {s: n for s, n in seen.items() if s not in ruled_out} if ruled_out else seen
                if not live:
                    continue
                total = sum(live.values()) + len(live)
                if symbol in live:
                    bits += log2(total / live[symbol])
                    break
                bits += log2(total / len(live))
                ruled_out |= live.keys()
            else:
                bits += log2(256 - len(ruled_out))
            out.append(bits)
        return out


class Scorer:
    """Looks up code lengths, and works out those of new windows."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.keys, self.costs = self.model.known, self.model.costs
        self.place = dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[self.slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - SLOTS.bit_length() + 1)

    def find(self, w: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(w)]
        missed = np.flatnonzero(self.keys[at] != w)
        if len(missed):
            distinct, back = np.unique(w[missed], return_inverse=True)
            new = [k for k in distinct.tolist() if k not in self.place]
            if new:
                self.place.update(zip(new, range(len(self.keys), len(self.keys) + len(new)), strict=True))
                self.keys = np.concatenate((self.keys, np.array(new, np.uint32)))
                self.costs = np.concatenate((self.costs, np.array([self.model.code_lengths(k) for k in new], np.float64)))
            found = np.fromiter((self.place[k] for k in distinct.tolist()), np.int32, len(distinct))
            self.slots[self.slot(distinct)] = found
            at = at.copy()
            at[missed] = found[back]
        return at

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        if len(self.keys) > CACHE:
            self.reset()
        w, first = windows(texts)
        out = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            at = self.find(w)  # may add windows
            out[some] = np.add.reduceat(self.costs[at], first[:-1][some], axis=0, dtype=np.float64)
        return out


def predict(texts: pd.Series, scorer: Scorer) -> pd.DataFrame:
    if not scorer.model.languages:
        return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
    names, langs, scores, run, size = scorer.model.languages, [], [], [], 0

    def flush() -> None:
        bits = scorer.bits(run)
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for k, t in enumerate(run):
            langs.append(names[best[k]] if t else "und")
            scores.append(float(1 / odds[k]) if t else 0.0)
        run.clear()

    for text in texts:
        run.append(folded(text))
        size += len(run[-1])
        if size > 1 << 20:
            flush()
            size = 0
    if run:
        flush()
    return pd.DataFrame({"lang_pred": langs, "score": scores})


def training_counts(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, int, int]]:
    """(lang, window, times) of the sample; its size is bounded by train_docs for each language."""
    sizes = {r[0]: r[1] for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(train_docs / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    sample = docs.where("text IS NOT NULL").where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            rows: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[lang].append(folded(text))
            for lang, texts in rows.items():
                keys, times = np.unique(windows(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "window", "n"])

    rows = sample.mapInArrow(count, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n")).toPandas()
    return [(str(a), int(b), int(c)) for a, b, c in rows.itertuples(index=False)]


_scorers: dict = {}


def identified(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """docs with _language, a struct (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        key = getattr(shared, "_path", None) or id(shared)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        return predict(texts, _scorers[key])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(free(docs, "_language"), once(F.pandas_udf(run, "lang_pred string, score double"))(F.col(f"`{column}`")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    model = Model(training_counts(docs.where(~held_out())))
    scored = identified(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "_language.lang_pred", "_language.score")
