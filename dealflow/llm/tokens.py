"""Vectorised word hashing of Arrow text batches (used inside Spark tasks).

A batch's texts lie end to end in one byte buffer. Words are found with a byte table, hashed
by a polynomial over random byte codes modulo 2^64, and n-grams by a polynomial over word
hashes, all with prefix sums: the cost is a few array passes whatever the text looks like.
Two families of constants give independent 64-bit hashes, together 128 bits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Texts are handled in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


class Family:
    """Constants of one hash family."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.gram = (int(x) * 2 + 1 for x in rng.integers(2**60, 2**62, 2))
        self._powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base^i and its inverse, i < n, modulo 2^64."""
        have = self._powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            have = self._powers[base] = (_powers(base, size), _powers(pow(base, -1, 2**64), size))
        return have[0][:n], have[1][:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step % 2**64
    return out


FIRST, SECOND = Family(20240101), Family(20240202)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts: byte bounds, and ``first[d]:first[d + 1]`` those of text d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES):
        self.buf, self.offsets = buf, offsets
        inside = ~gaps[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        prev = np.empty_like(inside)
        prev[:1], prev[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~prev | edge[:-1]))
        nxt = np.empty_like(inside)
        nxt[-1:], nxt[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, family: Family) -> np.ndarray:
        up, down = family.powers(family.base, len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(family.codes[self.buf] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


class Grams:
    """Hashes of any run of words, from prefix sums over word hashes."""

    def __init__(self, word_hashes: np.ndarray, family: Family):
        up, self.down = family.powers(family.gram, len(word_hashes) + 1)
        self.sums = np.zeros(len(word_hashes) + 1, np.uint64)
        np.cumsum(word_hashes * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        size = np.asarray(n).astype(np.uint64)
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + size)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about ``limit`` bytes of ``column``: (rows, bytes, offsets of the texts)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
            at = to


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(x.view(np.int64))
