"""Words, lines and window hashes of many texts at once, in numpy over Arrow buffers.

A word is a run of `[^\\x20\\x09-\\x0D]`. Hashes are polynomial (Rabin-Karp) sums modulo 2**64, taken from prefix
sums, so one pass over the bytes hashes every word and one pass over the words hashes every window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers: (bytes, words) of the first and of the second, independent hash.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=U64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U64))
        if n > 1 << 23:  # a very long text: not kept
            return made[0], made[1]
        _powers[base] = have = (made[0], made[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.multiply(values, powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return np.cumsum(out, dtype=U64, out=out)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each [start, end) from prefix(); equal spans have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def release() -> None:
    """Gives freed memory back to the system, where the C library can: task processes are used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, forget: Callable[[], None]) -> None:
    """Says that an operator keeps something in this process from task to task, and how to forget it."""
    _kept[owner] = forget


def _alone(owner: str) -> None:
    """Forgets what other operators keep: a process that now works for one of them need not hold it."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    if others:
        release()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, most: int = 1 << 31, owner: str = "") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of runs of texts of about `limit` bytes, `most` texts at most."""
    _alone(owner)
    data, offsets = text_column(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, min(first + most, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    _powers.clear()  # made again for the next batch in a moment; a process that waits for work holds none
    release()


class Words:
    """The words of a chunk of texts: byte positions, text of each word, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        first = solid.copy()  # first byte of a word
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        self.solid = solid
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: the words of text d are word_at[d] up to word_at[d + 1]
        self.word_at = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def byte_sums(self, which: int = 0) -> np.ndarray:
        return prefix(np.add(self.data, U64(1), dtype=U64), BASES[which][0])

    def hashes(self, which: int = 0, sums: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hash(self.byte_sums(which) if sums is None else sums, self.start, self.end, BASES[which][0])

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words that lies in one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        base = BASES[which][1]
        return at, span_hash(prefix(hashes, base), at, at + k, base)

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in one of the windows of k words that start at `at`."""
        edge = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        return np.cumsum(edge[:-1]) > 0

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each word by text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.word_at[1:]] - sums[self.word_at[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more in the array."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out
