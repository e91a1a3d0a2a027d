"""Count-min rows over partitions: sparse partial sketches, merged block by block into bit planes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

BLOCK_BITS = 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PARTIAL_SCHEMA = "block long, cells binary"


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(values, _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def partial(values: np.ndarray, rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The sketch of ``values``: for each block of each row the cells that count 1, and those that count more."""
    if not len(values):
        return
    per_block = 1 << min(BLOCK_BITS, bits)
    for row in range(rows):
        cell, times = np.unique(cells(values, row, bits), return_counts=True)
        code, block = cell % per_block * 2 + (times > 1), cell // per_block
        cut = np.flatnonzero(np.diff(block)) + 1
        payload = [zlib.compress(np.diff(part, prepend=0).astype(np.uint32).tobytes(), 1) for part in np.split(code, cut)]
        yield pa.RecordBatch.from_arrays([pa.array(row * (1 << 32) + block[np.r_[0, cut]], pa.int64()), pa.array(payload, pa.binary())], ["block", "cells"])


def _merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    one, more = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
    for part in parts["cells"]:
        code = np.cumsum(np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64))
        cell = code >> 1
        more[cell] |= one[cell] | (code & 1 == 1)
        one[cell] = True
    return pd.DataFrame({"block": [key[0]], "bits": [zlib.compress(np.packbits(more).tobytes(), 1)]})


def merged(partials: DataFrame) -> dict[int, bytes]:
    """Compressed bits of each block: cells that count 2 or more. Its size is that of the sketch, not of the data."""
    rows = partials.groupBy("block").applyInPandas(_merge, "block long, bits binary").collect()
    return {r["block"]: bytes(r["bits"]) for r in rows}


def planes(blocks: dict[int, bytes], rows: int, bits: int) -> list[np.ndarray]:
    step = max(1, (1 << min(BLOCK_BITS, bits)) // 8)
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(rows)]
    for block, packed in blocks.items():
        at = (block & 0xFFFFFFFF) * step
        out[block >> 32][at : at + step] = np.frombuffer(zlib.decompress(packed), np.uint8)[:step]
    return out


def repeated(values: np.ndarray, rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether each value's estimate is 2 or more."""
    hit = np.ones(len(values), bool)
    for row, plane in enumerate(rows):
        cell = cells(values, row, bits)
        hit &= plane[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 1
    return hit
