"""Vectorised views of text columns: bytes, words and rolling hashes.

The Python operators of this subpackage never build one Python string per word.
They look at the UTF-8 buffer of an Arrow string column, block by block, and
work on numpy arrays: byte classes, word boundaries, and polynomial hashes over
any byte range taken from one prefix sum (modulo 2**64, with a random-looking
64-bit value for each byte and an odd multiplier, mixed at the end).

Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the argument is overwritten."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[ord(c) for c in ".,;:!?*$%&#()"]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            if base == _BASE:
                _powers = p
            else:
                _inverses = p
    return _powers, _inverses


class Rolling:
    """Hashes of any ranges of one byte array."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = self.raw(start, end)
        h += (end - start).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt * 0xD1B54A32D192ED03 & _MASK)
        return mix(h)

    def fixed(self, width: int) -> np.ndarray:
        """The hash of each window of this width, by start."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.inverse[:n])


class Block:
    """Some rows of a text column: bytes, and where each row's bytes begin (one more than rows)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = True) -> "Words":
        return Words(LOWER[self.data] if lower else self.data, self.offsets)


class Words:
    """Runs of bytes that are not ASCII white space. offsets: each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.offsets = np.searchsorted(self.start, offsets)

    def hashes(self, salt: int = 0) -> np.ndarray:
        return Rolling(self.data).of(self.start, self.end, salt)

    def row(self) -> np.ndarray:
        """The row of each word, counted from the block's first."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and plainness of the units of a block's rows, the bytes to read them from, and the rows' first units.

    Units are words, cut where an ASCII letter meets a mark such as a full stop: tokenizers cut there too. Plain units, of ASCII
    letters only, are lower-cased, so that fewer differ.
    """
    words, data = block.words(lower=False), block.data
    cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
    inside = np.ones(len(data) + 1, bool)
    inside[block.offsets] = False
    cut = cut[inside[cut]]
    start, end = np.sort(np.concatenate([words.start, cut])), np.sort(np.concatenate([words.end, cut]))
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = letters[end] - letters[start] == end - start
    step = np.zeros(len(data) + 1, np.int8)
    step[start[plain]] += 1
    step[end[plain]] -= 1
    data = np.where(np.cumsum(step[:-1], dtype=np.int8).astype(bool), LOWER[data], data)
    return start, end, plain, data, np.searchsorted(start, block.offsets)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and where each row's begin.

    A row of fewer words than the width has its whole sequence as one shingle; a row without words has none.
    """
    h = words.hashes()
    n = np.diff(words.offsets)
    parts = np.maximum(n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), parts)
    at = words.offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(n, width)[row]
    value = size.astype(U64)
    last = len(h) - 1
    for k in range(width):
        step = np.where(k < size, h[np.minimum(at + k, last)], U64(0)) if len(h) else value
        value = mix(value * U64(0x9E3779B97F4A7C15) + step)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows in blocks of about so many bytes; a longer row is a block of its own."""
    data, offsets = buffers(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of this width, by start."""
    span = 1
    while span * 2 <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    if span < width:
        x = op(x[: len(x) - (width - span)], x[width - span :])
    return x
