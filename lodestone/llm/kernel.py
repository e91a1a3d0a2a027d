"""Vectorised word and window hashing over Arrow string columns.

A column's bytes are hashed in slices of bounded size: word hashes are differences of a polynomial prefix
sum (mod 2^64), mixed to spread their bits; window hashes are the same construction over word hashes.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text hashed at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: The same for workers that several steps share: tables of powers and arrays of a slice take a quarter.
SMALL_SLICE_BYTES = 1 << 18

def _table(word_bytes: range | list[int], lower: bool) -> np.ndarray:
    """0 for separators, else the byte (A-Z in lower case on request) plus 1."""
    t = np.zeros(256, np.uint16)
    for b in word_bytes:
        t[b] = (b + 32 if lower and 65 <= b <= 90 else b) + 1
    return t


_NOT_SPACE = [b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D]
#: Words of non-space bytes, unchanged; the same with A-Z in lower case; words of ASCII letters, digits and all beyond ASCII.
PLAIN, LOWER = _table(_NOT_SPACE, False), _table(_NOT_SPACE, True)
ALNUM = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)], True)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i up to n at least; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit hashes of the words in order, and the index of each text's first word (with the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = table[data]
    inside = low != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(int(_BASE), n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    return h, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the caller drops those that cross texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0xD1342543DE82EF95 + 2 * seed
    up, down = powers(base, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h, seed * 0x632BE59BD9B4E019 & (1 << 64) - 1) * up[: len(h)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n])


def spans_to_index(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [first, first + count), and the number of the range each belongs to."""
    owner = np.repeat(np.arange(len(first)), count)
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count), owner


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(a) < width:
        return a[:0]
    step, m = 1, a
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


#: Rows of an Arrow batch on its way to a Python worker; texts are long, and both sides hold a few batches at once.
BATCH_ROWS = 500


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded size (the session's batch size is lowered if it is larger), whose workers
    give freed memory back at the end of a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
