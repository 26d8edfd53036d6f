"""Elias-Fano code of an ascending sequence, with a select structure."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SAMPLE = 256  # ones between two stored positions


class EliasFano(NamedTuple):
    """n ascending values up to ``top``: packed low bits, unary high bits, and positions of every SAMPLE-th one.

    Value i has ``low_bits`` low bits in ``low`` and its remaining bits as the
    number of zeros before the i-th one of ``high``. That is under
    2 + log2(top / n) bits a value, besides the samples (64 / SAMPLE bits).
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (int(top) // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (int(top) >> bits) + 8) // 8 + 1, np.uint8)
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(3)).astype(np.int64), np.uint8(1) << (ones & np.uint64(7)).astype(np.uint8))
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), high, ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i, from one sample and a scan of the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at >> 3, at & 7
        step = SAMPLE // 8
        seen = -int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[:skip].sum())
        while True:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            count = int(bits.sum())
            if seen + count > left:
                one = (byte << 3) + int(np.flatnonzero(bits)[left - seen])
                break
            seen += count
            byte += step
        if not self.low_bits:
            return one - i
        first = i * self.low_bits
        chunk = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7 >> 3)], bitorder="little")
        own = chunk[first & 7 : (first & 7) + self.low_bits]
        return (one - i << self.low_bits) | int(sum(int(b) << k for k, b in enumerate(own)))

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = ones - np.arange(self.n, dtype=np.uint64)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return (high << np.uint64(self.low_bits)) | low
