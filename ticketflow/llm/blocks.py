"""Word segmentation of Arrow text columns with numpy, one block at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D (all ASCII, so
UTF-8 sequences are never cut).  Every operator that counts or hashes words
walks the text column in blocks of whole texts of about ``BLOCK_BYTES`` bytes:
peak memory follows the block (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_holder: tuple[str, Callable | None] | None = None


def worker_of(operator: str, release: Callable | None = None) -> None:
    """Says whose task a Python worker begins, and how to drop what that operator keeps.

    Workers outlive stages.  What another operator kept between its own tasks
    is dropped first and its memory goes back to the system.
    """
    global _holder
    before, _holder = _holder, (operator, release)
    if before and before[0] != operator:
        if before[1]:
            before[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:      # another C library: nothing to ask for
            pass


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown on demand."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, BLOCK_BYTES + 4096)
        table = np.full(size, base, U64)
        table[0] = 1
        table = np.cumprod(table, dtype=U64)
        if size <= 4 * BLOCK_BYTES:  # a single huge text does not stay resident
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (modular arithmetic, wraps around)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class SpanHash:
    """64-bit hashes of arbitrary byte spans of one array (polynomial, then mixed)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _power_table(_BASE, n + 1)[:n], out=self.prefix[1:])
        self.inverse = _power_table(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(h + ((end - start).astype(U64) + U64(salt)) * U64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Whole texts ``lo``..``hi`` of a column; word arrays cover all of them."""

    lo: int
    hi: int
    data: np.ndarray        # bytes of the texts, concatenated
    edges: np.ndarray       # text i is data[edges[i]:edges[i + 1]]
    start: np.ndarray       # first byte of each word
    end: np.ndarray         # byte after each word
    first: np.ndarray       # words of text i are first[i]..first[i + 1] - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.n_words)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return SpanHash(LOWER[self.data] if lower else self.data)(self.start, self.end)


def _view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, between: np.ndarray = WHITE) -> Iterator[Block]:
    """Split a string column into blocks of whole texts with word positions.

    ``between`` marks the bytes that separate words (white space by default).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, off = _view(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        data = raw[off[lo]:off[hi]]
        edges = off[lo:hi + 1] - off[lo]
        white = np.ones(len(data) + 2, bool)
        white[1:-1] = between[data]
        word = ~white
        begins, ends = word[1:-1] & white[:-2], word[1:-1] & white[2:]
        # a text edge also ends a word
        cut = edges[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        inside = cut[word[cut] & word[cut + 1]]
        begins[inside] = True
        ends[inside - 1] = True
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        yield Block(lo, hi, data, edges, start, end, np.searchsorted(start, edges))
        lo = hi


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word window inside one text, and its first word's index."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n - size + 1, U64)
    for k in range(size):
        h += words[k:n - size + 1 + k] * U64(pow(0xA0761D6478BD642F, k + 1, 1 << 64))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n - size + 1] == text[size - 1:])
    return mix(h[at]), at
