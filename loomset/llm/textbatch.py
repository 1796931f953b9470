"""Vectorised views of Arrow text columns: words, word hashes and n-gram hashes of a whole block.

Every function here works on one block of rows inside one task; Spark decides which rows those are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space that separates words in all operators of this subpackage.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 23:  # a longer block is rare; its powers are not kept
            _powers[name] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows whose text has about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a block: byte ranges, the row each belongs to, and a 64-bit hash of each.

    A word is a maximal run of bytes outside SPACE. `fold` maps bytes before hashing (LOWER, say).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        black = ~SPACE[data]
        first = black.copy()
        first[1:] &= ~black[:-1]
        last = black.copy()
        last[:-1] &= ~black[1:]
        edges = offsets[1:-1]
        inner = edges[(edges > 0) & (edges < len(data))]
        first[inner] = black[inner]
        last[inner - 1] = black[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.black = black
        self.count = np.bincount(self.row, minlength=self.rows)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        codes = CODES if fold is None else CODES[fold]
        np.cumsum(codes[data] * powers("base", BASE, len(data)), out=self.prefix[1:])
        self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte range, equal for equal bytes wherever they stand."""
        back = powers("back", BASE_INV, len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * back[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words within a row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(m, np.uint64)
        for j in range(n):
            total += self.hash[j : j + m] * (CODES[j + 1] | np.uint64(1))
        ok = np.flatnonzero(self.row[:m] == self.row[n - 1 : n - 1 + m])
        return ok, mix(total[ok])


def per_row(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many of a block's bytes are flagged, by row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def map_blocks(df, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, column: str = "text", most: int = 2 << 20):
    """`df.mapInArrow` over blocks of bounded text size."""

    def run(batches):
        for block in blocks(batches, column, most):
            yield from fn(block)
            del block
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives the memory that a task no longer needs back to the system: its Python worker is used again beside other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
