"""The wavelet matrix: a sequence of small integers as bit planes with rank and select.

Plane b holds bit b of every value, the highest plane first; each plane below it holds the values
in the order that a stable partition by the planes above leaves (zeros first). A plane is packed
64-bit words, and a directory counts the ones before every 512 bits. Access, rank and select
touch one block a plane and take arrays of arguments.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bits that one entry of the rank directory stands for, and their 64-bit words.
BLOCK, WORDS = 512, 8
#: So many answers of ``select`` are unpacked at a time.
CHUNK = 4096
#: So many values are partitioned at a time.
PIECE = 1 << 15


def _sides(bit: np.ndarray) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """Where a stable partition by ``bit`` (zeros first) takes values from and to: a piece of the
    sequence, positions in it, and the run that they make. Pieces are small enough for the cache."""
    zero, one = 0, len(bit) - int(np.count_nonzero(bit))
    for i in range(0, len(bit), PIECE):
        piece = slice(i, i + PIECE)
        at = np.flatnonzero(~bit[piece])
        yield piece, at, slice(zero, zero + len(at))
        zero += len(at)
        at = np.flatnonzero(bit[piece])
        yield piece, at, slice(one, one + len(at))
        one += len(at)


@dataclass(frozen=True)
class WaveletMatrix:
    """``planes[j]``, ``ranks[j]`` and ``zeros[j]`` belong to bit ``bits - 1 - j``."""

    n: int
    planes: list[np.ndarray]  # uint64, padded to whole blocks and one block more
    ranks: list[np.ndarray]  # uint32, ones before each block
    zeros: list[int]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        words = (len(values) // BLOCK + 1) * WORDS
        for b in range(bits - 1, -1, -1):
            bit = (values & values.dtype.type(1 << b)).astype(bool)
            plane = np.zeros(words * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[:len(packed)] = packed
            planes.append(plane.view("<u8"))
            ones = np.bitwise_count(planes[-1]).reshape(-1, WORDS).sum(axis=1, dtype=np.int64)
            ranks.append((np.cumsum(ones) - ones).astype(np.uint32))
            zeros.append(int(len(values) - ones.sum()))
            below = np.empty_like(values)
            for piece, at, run in _sides(bit):
                below[run] = values[piece][at]
            values = below
        return cls(len(values), planes, ranks, zeros)

    @property
    def bits(self) -> int:
        return len(self.planes)

    def _rank1(self, j: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``j`` before each position (0 to n)."""
        block, inside = at // BLOCK, at % BLOCK
        word = inside // 64
        rank = self.ranks[j][block].astype(np.int64)
        for k in range(WORDS):  # whole words before the position's own, then its low bits
            part = self.planes[j][block * WORDS + k]
            low = (np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1)
            rank += np.where(k < word, np.bitwise_count(part), np.where(k == word, np.bitwise_count(part & low), 0))
        return rank

    def _bit(self, j: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[j][at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) != 0

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at positions ``at``."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for j in range(self.bits):
            bit, ones = self._bit(j, at), self._rank1(j, at)
            at = np.where(bit, self.zeros[j] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _bits_of(self, value: int) -> list[tuple[int, int]]:
        return [(j, value >> (self.bits - 1 - j) & 1) for j in range(self.bits)]

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``value`` before each position in ``at`` (0 to n)."""
        hi = np.asarray(at, np.int64)
        if value >> self.bits:
            return np.zeros_like(hi)
        lo = np.zeros(1, np.int64)
        for j, side in self._bits_of(value):
            lo, hi = ((self.zeros[j] + self._rank1(j, x)) if side else x - self._rank1(j, x) for x in (lo, hi))
        return hi - lo

    def _select(self, j: int, side: int, k: np.ndarray) -> np.ndarray:
        """Position in plane ``j`` of the ``k``-th (from 0) bit equal to ``side``."""
        before = self.ranks[j].astype(np.int64)
        if not side:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = np.searchsorted(before, k, side="right") - 1
        words = self.planes[j].reshape(-1, WORDS)[block]
        bit = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little") == side
        inside = np.argmax(np.cumsum(bit, axis=1, dtype=np.int32) > (k - before[block])[:, None], axis=1)
        return block * BLOCK + inside

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the ``k``-th (from 0) occurrences of ``value``, which must exist."""
        start = np.zeros(1, np.int64)
        for j, side in self._bits_of(value):
            ones = self._rank1(j, start)
            start = self.zeros[j] + ones if side else start - ones
        out = []
        for i in range(0, len(k), CHUNK):
            at = start[0] + np.asarray(k[i:i + CHUNK], np.int64)
            for j, side in reversed(self._bits_of(value)):
                at = self._select(j, side, at - self.zeros[j] if side else at)
            out.append(at)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def values(self, dtype: type = np.uint32) -> np.ndarray:
        """The whole sequence: the planes from the lowest up, each undoing its partition."""
        out = np.zeros(self.n, dtype)
        for j in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[j].view(np.uint8), count=self.n, bitorder="little").view(bool)
            out[self.zeros[j]:] |= dtype(1 << (self.bits - 1 - j))
            above = np.empty_like(out)
            for piece, at, run in _sides(bit):
                above[piece][at] = out[run]
            out = above
        return out
