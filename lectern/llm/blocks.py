"""Numpy over Arrow string columns: words and their hashes for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
BLOCK_BYTES = 1 << 20

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
#: A-Z hash like a-z.
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_STEP = U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)
_UNSTEP = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INVERSE = np.ones(1, dtype=np.uint64)

#: Class of each byte; a word is a maximal run of one class, class 0 separates.
#: Words are runs of bytes other than space and tab to carriage return.
SPACE_SEPARATED = np.ones(256, dtype=np.uint8)
SPACE_SEPARATED[[32, 9, 10, 11, 12, 13]] = 0
#: Letters, digits and all beyond ASCII; runs of other characters are words of their own.
WORDS_AND_MARKS = np.where(SPACE_SEPARATED, 2, 0).astype(np.uint8)
WORDS_AND_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, at least ``n`` of them."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _STEP, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def inverse_powers(n: int) -> np.ndarray:
    """Inverses modulo 2**64 of :func:`powers`, at least ``n`` of them."""
    global _INVERSE
    if len(_INVERSE) < n:
        steps = np.full(max(n, 4096), _UNSTEP, dtype=np.uint64)
        steps[0] = 1
        _INVERSE = np.multiply.accumulate(steps)
    return _INVERSE


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the public splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of the texts ``first`` .. ``first + len(counts) - 1`` of a batch."""

    first: int
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    hashes: np.ndarray  # one 64-bit hash a word

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_blocks(column: pa.Array, classes: np.ndarray = SPACE_SEPARATED, fold: bool = False) -> Iterator[Words]:
    """Words of every text, block by block; ``fold`` hashes A-Z as a-z."""
    table = _BYTE_FOLDED if fold else _BYTE
    for first, data, offsets in text_blocks(column):
        n_texts = len(offsets) - 1
        kind = classes[data]
        inside = kind != 0
        begin, end = inside.copy(), inside.copy()
        if len(data):
            changes = kind[1:] != kind[:-1]
            begin[1:] &= changes
            end[:-1] &= changes
            edges = offsets[:-1][offsets[:-1] < offsets[1:]]
            begin[edges] = inside[edges]
            end[edges[1:] - 1] = inside[edges[1:] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        counts = np.diff(np.searchsorted(starts, offsets)) if len(starts) else np.zeros(n_texts, np.int64)
        lengths = ends - starts
        if len(starts):
            at = np.concatenate(([0], np.cumsum(lengths)))
            place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
            value = table[data[inside]] * powers(int(lengths.max()))[place]
            hashes = mix(np.add.reduceat(value, at[:-1]) + lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        else:
            hashes = np.zeros(0, np.uint64)
        yield Words(first, starts, ends, counts, hashes)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every ``n`` consecutive word hashes (across texts too: mask those)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    p = powers(n + 1)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += hashes[j : j + size] * p[n - j]
    return mix(total)
