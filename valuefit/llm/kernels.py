"""Numpy kernels over batches of texts: word boundaries and word hashes from raw UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME = 0x100000001B3
INVERSE = pow(PRIME, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing, as bytes of UTF-8
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: [^\x20\x09-\x0D]
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[:1] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, 2**64))
        done += more
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse, n or more."""
    if not _cache or next(iter(_cache)) < n:
        size = 1 << max(18, (n - 1).bit_length())
        _cache.clear()
        _cache[size] = _powers(PRIME, size), _powers(INVERSE, size)
    return next(iter(_cache.values()))


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and an executor's memory is one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``most`` bytes; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    del texts, offsets, data
    release()


#: bytes whose words are hashed at a time, so that a very long text needs no more memory for it than a short one
BLOCK = (1 << 18) - 1


class Words:
    """The words of a chunk of texts: ``start`` and ``end`` (bytes), ``doc`` (row), ``hash``, ``first`` (of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data = data = LOWER[data]
        self.n_docs = len(offsets) - 1
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.doc, self.hash = np.zeros(0, np.int64), np.zeros(0, U)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            return
        inside = table[data]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = slices(data, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within one row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, self.mixed(at, n)

    def mixed(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words from each of ``at`` on; mixed after every word, so that words in another order, or
        repeated in other places, give another hash."""
        total = np.full(len(at), n * 0x632BE59BD9B4E019 & (2**64 - 1), U)
        for i in range(n):
            total = mix(total + self.hash[at + i])
        return total

    def text(self, first: int, n: int) -> str:
        """n words, joined by single spaces."""
        return " ".join(
            self.data[a:b].tobytes().decode("utf-8", "replace")
            for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist())
        )


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each slice of the bytes; slices come in order and do not overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        base, size = int(start[i]), int(end[j - 1] - start[i])
        up, down = powers(size + 1)
        sums = np.zeros(size + 1, U)
        np.cumsum((data[base : base + size].astype(U) + U(1)) * up[:size], out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
        i = j
    return out
