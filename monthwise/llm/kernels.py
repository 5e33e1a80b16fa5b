"""Vectorised text helpers for Arrow batches.

Every function takes one Arrow column of texts and works on its UTF-8 bytes with
numpy, so that a task handles a few megabytes of text at a time whatever the row
count is. A word is a run of bytes outside space and \\t\\n\\v\\f\\r.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 512 << 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers; those of a usual slice are kept, those of a longer text are not."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    steps = np.full(max(n, SLICE_BYTES + 1), _U(_BASE if which == "up" else _BASE_INV))
    steps[0] = 1
    steps = np.multiply.accumulate(steps, out=steps)
    if n <= SLICE_BYTES + 1:
        _powers[which] = steps
    return steps[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """The bytes of a slice of texts; ``offsets[i]:offsets[i + 1]`` is text i, ``first`` its row in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of one number per byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Words:
    """Words of a slice in reading order: hash, text, and byte range."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a text column into slices of about ``limit`` bytes. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def runs(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of ``inside`` bytes; no run crosses a text."""
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(texts.offsets, start, side="right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes (A-Z as a-z with ``fold``)."""
    table = _BYTE[_FOLD] if fold else _BYTE
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(data) + 1)[start] + (end - start).astype(np.uint64))


def run_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[first:last], equal for equal runs."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return mix((sums[last] - sums[first]) * _power("down", len(values) + 1)[first] + (last - first).astype(np.uint64))


def words(texts: Texts, fold: bool = True) -> Words:
    start, end, text = runs(texts, ~_SPACE[texts.data])
    return Words(span_hash(texts.data, start, end, fold), text, start, end)


def lines(texts: Texts) -> Words:
    """The \\n-separated lines that hold a word."""
    start, end, text = runs(texts, texts.data != 10)
    w = np.concatenate([[0], np.cumsum(~_SPACE[texts.data])])
    some = w[end] > w[start]
    start, end, text = start[some], end[some], text[some]
    return Words(span_hash(texts.data, start, end), text, start, end)


_COEFFICIENTS = [_U(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def coefficient(i: int) -> np.uint64:
    return _COEFFICIENTS[i] if i < 5 else _U((_BASE * (2 * i + 1)) % (1 << 64) | 1)


def shingles(hashes: np.ndarray, text: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every window of ``size`` words inside a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = hashes[:n] * coefficient(0)
    for i in range(1, size):
        total += hashes[i : i + n] * coefficient(i)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(total[at]), text[at], at


def shingle_sets(texts: Texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles, with the whole sequence as one where a text has fewer words."""
    w = words(texts)
    sh, at, _ = shingles(w.hash, w.text, size)
    count = np.bincount(w.text, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(w.text, few)
        total = np.zeros(len(few), np.uint64)
        for i in range(size - 1):
            more = count[few] > i
            total[more] += w.hash[first[more] + i] * coefficient(i)
        sh = np.concatenate([sh, mix(total + count[few].astype(np.uint64))])
        at = np.concatenate([at, few])
    return sh, at
