"""Words, lines and shingles of whole batches of texts, as numpy arrays of 64-bit hashes.

A batch is the UTF-8 bytes of all its texts, one after the other, with the offsets at which each
begins. Hashes come from prefix sums of byte values times powers of an odd base (modulo 2**64), so
that the hash of any byte range takes a subtraction and a multiplication, without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Ranges:
    """Hashes of byte ranges of one array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows of about most_bytes; nulls are empty.
    A text is never cut: one longer than that is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of a run of texts: their byte ranges, hashes, the text each is in, and for each text the
    index of its first word (with one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross the offsets."""
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begin = offsets[:-1][np.diff(offsets) > 0]
        opens[begin] = inside[begin]
        end = offsets[1:][np.diff(offsets) > 0] - 1
        closes[end] = inside[end]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, inside: np.ndarray | None = None) -> Words:
    """Words: maximal runs of bytes other than ASCII white space, or of those marked in inside."""
    if lower:
        data = LOWER[data]
    starts, ends = _spans(~SPACE[data] if inside is None else inside, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, Ranges(data).of(starts, ends), text, first)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, in order, and for each text the index of its
    first one (with one more at the end). A text with fewer words has one of all its words, one
    without words has none."""
    n = len(w.hashes)
    counts = np.diff(w.first)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(made)))
    at = np.repeat(w.first[:-1] - first[:-1], made) + np.arange(first[-1])
    length = np.repeat(np.minimum(counts, size), made)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        step = np.uint64(pow(_BASE, k + 1, 2**64))
        has = length > k
        out += np.where(has, w.hashes[np.minimum(at + k, n - 1)] * step, np.uint64(0))
    return mix(out + length.astype(np.uint64)), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and the new indices of the first ones."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else values[:0], np.concatenate(([0], np.cumsum(lengths)))
