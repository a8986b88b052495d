"""Document quality from a linear-chain conditional random field over lines.

The field labels every line good or bad. A line's features are its own and, less strongly scaled, those of
the lines before and after it: shares of symbols, capitals, digits, exclamation marks, bars and stops,
repeated words, whether the line occurred before, its length and that of its words. Nothing tells a line
how long its document is. Forward-backward gives every line's marginal probability of being good, and a
document's score is their mean, weighted by line length.

Marks are of documents, labels of lines, and so lines' labels are latent: a document's mark is taken as the
label of one of its lines, drawn by length. The probability of the mark good is then the score itself, and
its likelihood is maximised over the marked documents: the expected features given the mark (from the same
chain with a flag that says whether the drawn line has been passed) less those without it are the gradient.
So a good document may have bad lines and the other way round. A prior keeps the bonds between neighbours
and the neighbours' features small, as documents of one kind throughout would otherwise make each line the
same as the one before.

Training reads a bounded sample: about TRAIN_DOCS marked documents, chosen by a hash of doc_id, whatever
their length. Scoring reads every line of every document.

Defined results: null and empty texts are one empty line, and get its score; rows with a null doc_id are
never held out and carry no mark; of marks that differ for one doc_id the larger counts; repeated rows are
scored each; very long texts are scored whole; with no marked rows of both kinds every score is 0.5; an
empty table gives an empty one; other columns pass through, whatever their names (`scored` adds its column
under its name or the first free one, name_1, ...).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .quality_rules import _repeats
from .shared import free, once, small_batches, table, text_or_empty
from .wordhash import SPACE, Ranges, slices, words

TRAIN_DOCS, ROUNDS, RATE, CUTOFF = 3000, 70, 0.3, 0.7
#: The prior's weight on features and on bonds, and how a neighbour's features are scaled.
DECAY, BOND_DECAY, NEAR = 2e-4, 0.1, 0.2
_CLASSES = {"symbol": b"#*$%&<>@_=~^", "capital": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "shout": b"!", "bar": b"|", "stop": b".,;:?"}
_OWN = 11


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, text) of every line of a run of texts; a text has a line at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    text = np.concatenate((np.arange(len(offsets) - 1), owner))
    order = np.argsort(text, kind="stable")
    starts, text = starts[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    ends = np.where(last, offsets[text + 1], np.append(starts[1:], 0) - 1)
    size = ends - starts

    def per_line(marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        return sums[ends] - sums[starts]

    in_word = per_line(~SPACE[data])
    shares = []
    for members in _CLASSES.values():
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        shares.append(3 * per_line(is_in[data]) / np.maximum(in_word, 1))
    w = words(data, offsets)
    line_of = np.searchsorted(starts, w.starts, "right") - 1
    # Empty lines share their start with the next one; a word belongs to the last line that begins there.
    n_words = np.bincount(line_of, minlength=len(starts))
    again = np.zeros(len(w.hashes), bool)
    if len(again):
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (line_of[1:] == line_of[:-1])
    in_row = np.bincount(line_of, again, minlength=len(starts)) / np.maximum(n_words, 1)
    earlier = np.bincount(line_of, _repeats(line_of, w.hashes)[0], minlength=len(starts)) / np.maximum(n_words, 1)
    seen = _repeats(text, Ranges(data).of(starts, ends))[0] & (in_word > 0)
    own = np.column_stack([*shares, in_row, earlier * (n_words > 2), seen, np.log1p(n_words) / 3, np.minimum(in_word / np.maximum(n_words, 1), 30) / 10])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    head = np.append(True, text[1:] != text[:-1])
    before[head] = 0
    after[last] = 0
    return np.column_stack([own, NEAR * before, NEAR * after, head, last, np.ones(len(own))]), size, text


def marginals(good: np.ndarray, bonds: np.ndarray, lengths: np.ndarray, pull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains. good: [chain, line] log odds of the good label from the
    features; bonds: [from, to] scores. Returns P(good) of each line, the expected number of times that each
    bond is used, summed over the chains, and each chain's probability of its mark.

    pull: [chain, line, label] weights with which a line of that label gives the document's mark; P and bonds
    are then those given the mark. Without it they are the field's own, and the probability is 1."""
    n, t = good.shape
    real = (np.arange(t)[:, None] < np.asarray(lengths)[None, :])[:, :, None]
    up = 1 / (1 + np.exp(-np.clip(good.T, -50, 50)))
    seen, bond = np.stack([1 - up, up], axis=2), np.exp(bonds - bonds.max())
    pull = np.zeros((t, n, 2)) if pull is None else pull.transpose(1, 0, 2)
    before, after = np.zeros((t, n, 2)), np.zeros((t, n, 2))  # the drawn line is yet to come; has come
    scale = np.ones((t, n, 1))
    for k in range(t):
        x = seen[k] * (before[k - 1] @ bond if k else 1)
        scale[k] = np.where(real[k], x.sum(axis=1, keepdims=True), 1)
        x = x / scale[k]
        y = (after[k - 1] @ bond * seen[k] / scale[k] if k else 0) + pull[k] * x
        before[k], after[k] = (np.where(real[k], x, before[k - 1]), np.where(real[k], y, after[k - 1])) if k else (x, y)
    mark = after[-1].sum(axis=1)
    given = bool(pull.any())
    done, open_ = np.ones((t, n, 2)), np.zeros((t, n, 2))  # what follows, with the line drawn, or yet to be
    used = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        step = seen[k + 1] / scale[k + 1]
        x, y = step * done[k + 1], step * (open_[k + 1] + pull[k + 1] * done[k + 1])
        done[k], open_[k] = np.where(real[k + 1], x @ bond.T, done[k + 1]), np.where(real[k + 1], y @ bond.T, open_[k + 1])
        on = real[k + 1] / mark[:, None] if given else real[k + 1]
        used += (before[k] * on).T @ y + (after[k] * on).T @ x if given else (before[k] * on).T @ x
    used *= bond
    p = ((before * open_ + after * done) / np.maximum(mark[:, None], 1e-300) if given else before * done)[:, :, 1].T
    return np.where(real[:, :, 0].T, p, 0), used, mark if given else np.ones(n)


def _levels(lengths: np.ndarray) -> list[np.ndarray]:
    """Indices of chains of like length together, so that padding at most doubles the work."""
    scale = np.ceil(np.log2(lengths)).astype(int)
    return [np.flatnonzero(scale == level) for level in np.unique(scale)]


class Field:
    """Weights of the features and of the bonds between neighbouring labels."""

    def __init__(self, weights: np.ndarray, bonds: np.ndarray):
        self.weights, self.bonds = weights, bonds

    @classmethod
    def fitted(cls, chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> Field:
        """Adam on the mean log-likelihood of the marks, less the prior."""
        lengths, d = np.array([len(c) for c in chains]), chains[0].shape[1]
        groups = []
        for rows in _levels(lengths):
            t = int(lengths[rows].max())
            x, w = np.zeros((len(rows), t, d), np.float32), np.zeros((len(rows), t))
            for k, r in enumerate(rows):
                x[k, : lengths[r]], w[k, : lengths[r]] = chains[r], sizes[r] / sizes[r].sum()
            pull = np.zeros((len(rows), t, 2))
            pull[np.arange(len(rows)), :, labels[rows]] = w
            groups.append((x, x.reshape(-1, d), pull, lengths[rows]))
        theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
        prior = np.append(np.full(d, DECAY), np.full(4, BOND_DECAY))
        for step in range(1, ROUNDS + 1):
            bonds, grad = theta[d:].reshape(2, 2), -prior * theta
            for x, flat, pull, own in groups:
                good = (flat @ theta[:d].astype(np.float32)).reshape(x.shape[:2]).astype(float)
                p, used, _ = marginals(good, bonds, own)
                q, wanted, _ = marginals(good, bonds, own, pull)
                grad[:d] += ((q - p).astype(np.float32).reshape(-1) @ flat) / len(chains)
                grad[d:] += ((wanted - used) / len(chains)).reshape(-1)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:d], theta[d:].reshape(2, 2))

    def lines(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's marginals: how likely every line is good."""
        return [p for part, *_ in self._runs(column) for p in part]

    def scores(self, column: pa.Array) -> np.ndarray:
        """The length-weighted mean marginal of each text."""
        out = [np.array([(p * w).sum() / w.sum() for p, w in zip(part, sizes, strict=True)]) for part, sizes in self._runs(column)]
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)

    def _runs(self, column: pa.Array):
        for _, data, offsets in slices(column):
            x, size, text = line_features(data, offsets)
            good = x @ self.weights
            first = np.searchsorted(text, np.arange(len(offsets)))
            lengths = np.diff(first)
            p = np.zeros(len(text))
            for rows in _levels(lengths):
                t = int(lengths[rows].max())
                at = first[:-1][rows][:, None] + np.minimum(np.arange(t)[None, :], lengths[rows][:, None] - 1)
                real = np.arange(t)[None, :] < lengths[rows][:, None]
                p[at[real]] = marginals(good[at], self.bonds, lengths[rows])[0][real]
            yield np.split(p, first[1:-1]), np.split(size + 1.0, first[1:-1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field | None:
    """Learns from a bounded sample of docs (doc_id, text) marked in labels (doc_id, quality)."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r[0]: r[1] for r in marks.where(~held_out()).groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    chosen = marks.where(~held_out()).where(draw < train_docs / sum(sizes.values()))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def features(batches):
        for batch in batches:
            chains, sizes, marks_out, at = [], [], [], batch.column(1).to_pylist()
            for begin, data, offsets in slices(batch.column(0)):
                x, size, text = line_features(data, offsets)
                first = np.searchsorted(text, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    chains.append(x[first[k] : first[k + 1]].astype(np.float32).tobytes())
                    sizes.append((size[first[k] : first[k + 1]] + 1).astype(np.int64).tobytes())
                    marks_out.append(at[begin + k])
            yield pa.RecordBatch.from_arrays([pa.array(chains, pa.binary()), pa.array(sizes, pa.binary()), pa.array(marks_out, pa.int32())], ["x", "size", "quality"])

    got = rows.mapInArrow(features, "x binary, size binary, quality int").collect()
    if len({r[2] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (r[2], bytes(r[0])))  # the sum of gradients doesn't depend on how tasks end
    width = 3 * _OWN + 3
    return Field.fitted([np.frombuffer(bytes(r[0]), np.float32).reshape(-1, width) for r in got], [np.frombuffer(bytes(r[1]), np.int64).astype(float) for r in got], np.array([r[2] for r in got]))


def scored(docs: DataFrame, field: Field | None, column: str = "text") -> DataFrame:
    """docs with _quality, 0 to 1."""
    if field is None:
        return docs.withColumn(free(docs, "_quality"), F.lit(0.5))

    def run(text: pa.Array) -> pa.Array:
        return pa.array(field.scores(text))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return docs.withColumn(free(docs, "_quality"), once(F.arrow_udf(run, "double"))(text_or_empty(column)))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, field).select("doc_id", held_out().alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= CUTOFF).cast("int").alias("predicted"))
