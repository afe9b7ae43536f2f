"""Words, lines and word sequences of Arrow string columns as 64-bit fingerprints, in numpy.

A chunk is the UTF-8 bytes of some whole texts, one after the other, with the offset of each. All
functions work on a chunk at once, so the cost per text is small and memory is bounded by
``CHUNK`` bytes or the longest text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD_BASE = np.uint64(0xD6E8FEB86659FD93 | 1)
WORD_INV = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: Space and the five ASCII controls from tab to carriage return.
BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
#: All ASCII but digits and lower-case letters.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Powers:
    """Powers of an odd number and of its inverse, as far as they were asked for."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BASE, BASE_INV), Powers(WORD_BASE, WORD_INV)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        own = offsets[start : end + 1]
        yield start, data[own[0] : own[-1]], own - own[0]
        start = end


@dataclass
class Spans:
    """Words or lines of a chunk: where each starts and ends, its fingerprint, and for each of the
    n owners (texts, lines) the numbers of its first and one past its last span (n + 1 values)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def index(self) -> np.ndarray:
        """Number of each span within its owner, from 0."""
        return np.arange(len(self.start)) - np.repeat(self.of[:-1], np.diff(self.of))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = BLANK, fold: np.ndarray = LOWER) -> Spans:
    """Maximal runs of bytes outside ``gap`` after ``fold``; no run crosses an offset."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Spans(none, none, none.astype(U64), np.zeros(len(offsets), dtype=np.int64))
    data = fold[data]
    inside = ~gap[data]
    after = np.empty(n, dtype=bool)
    after[0], after[1:] = False, inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    after[inner] = False
    start = np.flatnonzero(inside & ~after)
    before = np.empty(n, dtype=bool)
    before[-1], before[:-1] = False, inside[1:]
    before[inner - 1] = False
    end = np.flatnonzero(inside & ~before) + 1
    return Spans(start, end, span_hash(data, start, end), np.searchsorted(start, offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the bytes from each start to its end, the same wherever they stand."""
    up, down = BYTE_POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts, and for each text the number of its first line.

    Lines are what is left between line feeds, as ``split`` gives them: a text of n line feeds has
    n + 1 lines, the empty text one empty line. A line feed belongs to the line it ends.
    """
    feeds = np.flatnonzero(data == 10) + 1
    bounds = np.concatenate([offsets[:-1], feeds])
    # A text's own start comes before a feed that ends right there, which belongs to the text before.
    kind = np.concatenate([np.ones(len(offsets) - 1, np.int8), np.zeros(len(feeds), np.int8)])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds - 1, "right") - 1])
    order = np.lexsort((bounds, 1 - kind, text))
    starts, text = bounds[order], text[order]
    return np.append(starts, offsets[-1]), np.searchsorted(text, np.arange(len(offsets)))


def sequences(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every k consecutive spans of an owner, and the number of the first span."""
    n = len(spans.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    up, _ = WORD_POWERS.to(k + 1)
    total = np.full(n, U64(k), dtype=U64)
    for j in range(k):
        total += spans.hash[j : j + n] * up[j + 1]
    owner_end = np.repeat(spans.of[1:], np.diff(spans.of))[:n]
    first = np.flatnonzero(np.arange(n) + k <= owner_end)
    return mix(total[first]), first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one text's words; a shorter text is one shingle, none is empty."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    up, _ = WORD_POWERS.to(k + 1)
    total = np.full(n - k + 1, U64(k), dtype=U64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * up[j + 1]
    return np.unique(mix(total))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return np.ascontiguousarray(x).view(np.int64)


def long_lists(values: list[np.ndarray]) -> pa.Array:
    """An Arrow list column of LONGs."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))
