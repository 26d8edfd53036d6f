"""Words of whole texts as numpy arrays.

A word is a run of characters other than space and the control characters
tab to carriage return. In UTF-8 those are single bytes, so words are found on
the bytes. Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 17  # bytes whose hashes are computed at once
BATCH_BYTES = 1 << 20  # text bytes handled at once in a task

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)
_GRAM = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK)
        _powers[:] = [np.cumprod(np.full(size, b, _U)) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    """Words of a batch of texts: hash, text index and byte span of each, and the bytes and text offsets."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Find and hash the words of a batch of texts; ``lower`` folds the letters A-Z."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), _U)
    i = 0
    while i < len(start):  # whole words, about CHUNK bytes at a time
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        power, inverse = _power_table(high - low)
        total = np.zeros(high - low + 1, _U)
        np.cumsum(_BYTE[data[low:high]] * power, out=total[1:])
        hashes[i:j] = (total[end[i:j] - low] - total[start[i:j] - low]) * inverse[start[i:j] - low]
        i = j
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(mix(hashes), doc, start, end, data, offsets)


def grams(hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hash of the n words from each position; ``kind`` chooses one of two independent hashes."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, _U)
    for k in range(n):
        out = out * _GRAM[kind] + hashes[k : k + size]
    return mix(out + _U(n))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most BATCH_BYTES of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + BATCH_BYTES, "right")))
            yield batch.slice(i, j - i)
            i = j
