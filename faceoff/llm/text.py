"""Words, lines and hashes of whole texts, computed on the bytes of an Arrow column.

A batch is handled in blocks of documents (a few MB of text; a longer text is a block of its own), so
memory follows the block or the longest text. White space is space and 0x09-0x0D; both are ASCII, so
UTF-8 bytes can be cut there. Hashes have 64 bits: every byte and position has its own pseudo-random
factor, sums are taken modulo 2^64 and mixed at the end. Two different items of a set of n meet with a
chance of about n*n / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(n: int, salt: int = 0) -> np.ndarray:
    """The first n odd pseudo-random factors of a salt."""
    k = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(k + np.uint64(salt)) | np.uint64(1)


CODES = factors(256, 77)
CODES_LOWER = CODES[LOWER]
SMALL = factors(256, 5)


@dataclass
class Block:
    """Documents lo..hi of a batch: their bytes, and where each begins in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return self.hi - self.lo


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column into blocks of consecutive documents."""
    raw, bounds = text_buffer(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of bytes for which inside holds; no run crosses a document's edge."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    np.logical_not(inside, out=first[1:])
    first[offsets] = True
    last = first[1:].copy()
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(inside & first[:-1]), np.flatnonzero(inside & last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and not empty."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK_BYTES, "right")) - 1)
        a, length = starts[lo:hi], ends[lo:hi] - starts[lo:hi]
        at = total[lo:hi] - total[lo]
        place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        longest = int(length.max())
        table = SMALL if longest <= 256 else factors(longest, 5)
        values = codes[data[place + np.repeat(a, length)]]
        values *= table[place]
        out[lo:hi] = mix(np.add.reduceat(values, at) + length.astype(np.uint64))
        lo = hi
    return out


@dataclass
class Words:
    """Words of a block: start and end in bytes, hash, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, lower: bool = False) -> Words:
    """The words of every document of a block; lower: A-Z count as a-z in the hash."""
    starts, ends = runs(block.data, block.offsets, ~SPACE[block.data])
    hashes = hash_spans(block.data, starts, ends, CODES_LOWER if lower else CODES)
    return Words(starts, ends, hashes, np.searchsorted(starts, block.offsets))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``size`` consecutive words that lies within one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = factors(size, 1000 + salt)
    total = hashes[:n] * each[0]
    for k in range(1, size):
        total += hashes[k:n + k] * each[k]
    end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= end)
    return at, mix(total[at])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each document's values; first has the edges."""
    total = np.cumsum(values)
    total = np.concatenate([np.zeros(1, total.dtype), total])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark has."""
    return x.view(np.int64)
