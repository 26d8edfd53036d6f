"""Bitmaps of hashes, of a fixed size whatever the input, that tell a task which rows may matter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 4096  # bits of a bitmap that are one row on the way to the driver


class Bitmap(NamedTuple):
    """Bit h >> (64 - bits) is set for every hash h that was put in. No hash that was put in is missed."""

    bits: int
    data: np.ndarray

    @classmethod
    def none(cls, bits: int) -> Bitmap:
        return cls(bits, np.zeros(1 << (bits - 3), np.uint8))

    @property
    def empty(self) -> bool:
        return not self.data.any()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _words(batches):
    for batch in batches:
        bit = batch["bit"].to_numpy()
        row, start = np.unique(bit // WORD, return_index=True)
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(row, pa.int64()),
                "word": pa.array(
                    [_pack(b % WORD) for b in np.split(bit, start[1:])] if len(bit) else [], pa.binary()
                ),
            }
        )


def _pack(bits: np.ndarray) -> bytes:
    cells = np.zeros(WORD, np.uint8)
    cells[bits] = 1
    return np.packbits(cells, bitorder="little").tobytes()


def collect_bitmap(hashes: DataFrame, bits: int) -> Bitmap:
    """Bitmap of the 64-bit hashes in the column ``a``.

    It has 2^bits bits; they are packed in the tasks, WORD bits a row, so the
    driver gets about 2^(bits - 3) bytes.
    """
    bit = F.shiftrightunsigned("a", 64 - bits).alias("bit")
    distinct = hashes.select(bit).distinct()
    packed = distinct.repartition((F.col("bit") / WORD).cast("bigint")).sortWithinPartitions("bit").mapInArrow(_words, "row bigint, word binary")
    data = np.zeros(1 << (bits - 3), np.uint8)
    view = data.reshape(-1, WORD // 8)
    for r in packed.collect():  # a row of the bitmap may come in several pieces
        view[r["row"]] |= np.frombuffer(r["word"], np.uint8)
    return Bitmap(bits, data)


def only(batches: Iterator[pa.RecordBatch], column: str, inside: Bitmap | None = None, outside: Bitmap | None = None) -> Iterator[pa.RecordBatch]:
    """Rows whose hash column is in one bitmap and not in another. A null hash is in no bitmap.

    Used within a task's own function, so that a task needs one Python worker.
    """
    for batch in batches:
        hashes = batch[column].fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        valid = batch[column].is_valid().to_numpy(zero_copy_only=False)
        keep = np.ones(batch.num_rows, bool)
        if inside is not None:
            keep &= inside.has(hashes) & valid
        if outside is not None:
            keep &= ~(outside.has(hashes) & valid)
        yield batch if keep.all() else batch.filter(pa.array(keep))
