"""Removal of passages of ``size`` words that also start in an earlier document.

The first reading counts windows in a count-min sketch: each partition sketches its own windows, the partial sketches
are merged block by block, and the merged counts overestimate the true ones. The second reading exactly groups only the
windows whose estimate says that two documents have them; a window that repeats can never be estimated as unique, so
none is lost. A third reading rebuilds the texts.

A window enters the sketch through its anchor, the run of ``ANCHOR`` words of least hash inside it. Equal
windows have equal anchors, so an anchor's count is no lower than its windows' counts, and neighbouring
windows mostly share one, which divides the sketch's load by about 16.

The sketch is sized from the text (``CELLS_PER_BYTE``). Up to ``max_cells`` cells it is broadcast as one bit a cell.
Beyond that its cells stay where they are: they are rows of a table (one hash row of 2^40 cells), counted by a grouped
sum with partial sums before the shuffle, and the cells that count two or more are joined back to their documents. The
estimates stay overestimates, the number of readings does not grow, and the result is the same.

Windows that a task finds in several of its documents are decided on the spot: only those of the smallest id can still
be first anywhere. So a window that a third of all documents share reaches the shuffle once a task, not once a document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import materialize

ANCHOR = 20
ROWS = 3
CELLS_PER_BYTE = 1 / 14
BLOCK_BITS = 20
_ROW_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(anchors, _ROW_SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _window_anchors(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, text and anchor of every window that lies in one text."""
    gram = min(ANCHOR, size)
    count = np.maximum(np.diff(first) - size + 1, 0)
    at, text = K.spans_to_index(first[:-1], count)
    return at, text, K.sliding_min(K.windows(h, gram, 7), size - gram + 1)[at]


def _distinct_anchors(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, anchor) of every anchor of every text, once a text."""
    for lo, _, data, offsets in K.text_slices(column):
        h, first = K.words(data, offsets, K.PLAIN)
        _, text, anchor = _window_anchors(h, first, size)
        if not len(anchor):
            continue
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        anchor, text = anchor[new], text[new]
        order = np.lexsort((anchor, text))
        anchor, text = anchor[order], text[order]
        once = np.ones(len(anchor), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        yield lo + text[once], anchor[once]


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """This partition's sketch: for each block of each row, the cells that count 1 and those that count more."""
    seen = [anchor for batch in batches for _, anchor in _distinct_anchors(batch.column(0), size)]
    if not seen:
        return
    anchors = np.concatenate(seen)
    per_block = 1 << min(BLOCK_BITS, bits)
    for row in range(ROWS):
        cell, times = np.unique(_cells(anchors, row, bits), return_counts=True)
        code = cell % per_block * 2 + (times > 1)
        block = cell // per_block
        cut = np.flatnonzero(np.diff(block)) + 1
        lo = np.r_[0, cut]
        payload = [zlib.compress(np.diff(part, prepend=0).astype(np.uint32).tobytes(), 1) for part in np.split(code, cut)]
        yield pa.RecordBatch.from_arrays([pa.array(row * (1 << 32) + block[lo], pa.int64()), pa.array(payload, pa.binary())], ["block", "cells"])


def _merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Sum of the partial sketches of one block, kept as one bit a cell: counts 2 or more."""
    one = np.zeros(1 << BLOCK_BITS, np.uint8)
    more = np.zeros(1 << BLOCK_BITS, bool)
    for part in parts["cells"]:
        code = np.cumsum(np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64))
        cell = code >> 1
        more[cell] |= (one[cell] == 1) | (code & 1 == 1)
        one[cell] = 1
    return pd.DataFrame({"block": [key[0]], "bits": [zlib.compress(np.packbits(more).tobytes(), 1)]})


#: Windows that a task holds at once before it decides what it can.
HELD_WINDOWS = 1 << 21
_FOUND = "h1 long, h2 int, id long, row long, at int, many int"


def _decide(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows to be compared with other tasks' (h1 set), and runs of ``many`` windows from ``at`` on that go (h1 null):
    those that start in a document of a smaller id among the held ones."""
    h1, h2, ids, rows, at = map(np.concatenate, zip(*held))
    order = np.lexsort((at, rows, ids, h2, h1))
    h1, h2, ids, rows, at = h1[order], h2[order], ids[order], rows[order], at[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    open_, gone = np.flatnonzero(ids == least), np.flatnonzero(ids > least)
    gone = gone[np.lexsort((at[gone], rows[gone], ids[gone]))]
    i, r, a = ids[gone], rows[gone], at[gone]
    start = np.ones(len(gone), bool)
    start[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (a[1:] > a[:-1] + 1)
    run = np.flatnonzero(start)
    last = np.r_[run[1:], len(gone)] - 1
    known = np.r_[np.ones(len(open_), bool), np.zeros(len(run), bool)]
    longs = lambda x, y: np.r_[x[open_], y[run]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(longs(h1, h1[gone]), pa.int64(), mask=~known),
            pa.array(longs(h2, h2[gone]), pa.int32(), mask=~known),
            pa.array(longs(ids, i), pa.int64()),
            pa.array(longs(rows, r), pa.int64()),
            pa.array(longs(at, a), pa.int32()),
            pa.array(np.r_[np.ones(len(open_), np.int32), (a[last] - a[run] + 1).astype(np.int32)] if len(gone) else np.ones(len(open_), np.int32), pa.int32()),
        ],
        ["h1", "h2", "id", "row", "at", "many"],
    )


def _windows_found(batches: Iterator[pa.RecordBatch], size: int, estimated: Callable) -> Iterator[pa.RecordBatch]:
    """The windows of batches (id, row, text, ...) whose anchors ``estimated(batch, lo, text, anchor)`` marks, decided as far as possible."""
    held, n = [], 0
    for batch in batches:
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, _, data, offsets in K.text_slices(batch.column(2)):
            h, first = K.words(data, offsets, K.PLAIN)
            at, text, anchor = _window_anchors(h, first, size)
            if not len(at):
                continue
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            keep = np.flatnonzero(estimated(batch, lo, text[new], anchor[new])[np.cumsum(new) - 1])
            if not len(keep):
                continue
            at, text = at[keep], text[keep]
            h1, h2 = K.windows(h, size, 1)[at], K.windows(h, size, 2)[at]
            held.append((h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[lo + text], rows[lo + text], (at - first[text]).astype(np.int32)))
            n += len(at)
            if n >= HELD_WINDOWS:
                yield _decide(held)
                held, n = [], 0
    if held:
        yield _decide(held)


def _by_broadcast(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Windows (see _decide) whose estimate in the broadcast sketch is 2 documents or more."""
    partial = K.map_batches(docs.select("text"), lambda b: _sketch(b, size, bits), "block long, cells binary")
    merged = partial.groupBy("block").applyInPandas(_merge, "block long, bits binary").collect()  # one bit a cell, whatever the text
    sketch = docs.sparkSession.sparkContext.broadcast({r["block"]: bytes(r["bits"]) for r in merged})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << min(BLOCK_BITS, bits)) // 8)
        planes = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(ROWS)]
        for block, packed in sketch.value.items():
            at = (block & 0xFFFFFFFF) * step
            planes[block >> 32][at : at + step] = np.frombuffer(zlib.decompress(packed), np.uint8)[:step]

        def estimated(batch: pa.RecordBatch, lo: int, text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
            hit = np.ones(len(anchor), bool)
            for row, plane in enumerate(planes):
                cell = _cells(anchor, row, bits)
                hit &= plane[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 1
            return hit

        yield from _windows_found(batches, size, estimated)

    return K.map_batches(docs, second, _FOUND)


WIDE_BITS = 40


def _by_join(docs: DataFrame, size: int) -> DataFrame:
    """The same with a sketch whose cells are rows: one hash row, counted where its cells are, joined back to documents."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, anchor in _distinct_anchors(batch.column(2), size):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(_cells(anchor, 0, WIDE_BITS))], ["id", "row", "cell"])

    each = materialize(K.map_batches(docs, cells, "id long, row long, cell long"), "anchors")
    twice = materialize(each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cells")
    marked = each.join(twice, "cell").groupBy("id", "row").agg(F.array_sort(F.collect_set("cell")).alias("cells"))  # of one document

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def estimated(batch: pa.RecordBatch, lo: int, text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
            lists = batch.column(3)
            own, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            hit, cell = np.zeros(len(anchor), bool), _cells(anchor, 0, WIDE_BITS)
            edge = np.searchsorted(text, np.arange(int(text.max()) + 2))
            for k in np.unique(text).tolist():
                part = slice(edge[k], edge[k + 1])
                known = values[own[lo + k] : own[lo + k + 1]]
                hit[part] = np.isin(cell[part], known)
            return hit

        yield from _windows_found(batches, size, estimated)

    return K.map_batches(docs.join(marked, ["id", "row"]).select("id", "row", "text", "cells"), second, _FOUND)


def _removed(n: int, starts: np.ndarray, many: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in one of the ``many`` windows from each of ``starts`` on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + many - 1 + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated_passages(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", max_cells: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text, spans (array of [start, end) in words).

    Words are runs of anything but ASCII white space. A word goes if a window of ``size`` words of its document
    covers it whose word sequence also starts in a document with a smaller id; windows are judged on the input.
    Null and empty texts have no words. Rows with equal ids are one document for this comparison, so none removes
    the other's words. A row without an id keeps its text and removes nothing. Other columns are ignored.
    An empty table gives an empty result. Windows are compared by 96 bits of hash.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << max(10, math.ceil(math.log2(max(1.0, total * CELLS_PER_BYTE))))
    known = base.where(F.col("id").isNotNull())
    found = _by_broadcast(known, size, cells.bit_length() - 1) if cells <= max_cells else _by_join(known, size)
    # Windows that are decided already are dealt by their document; one row a task is left of the others.
    spread = F.when(F.col("h1").isNull(), F.xxhash64("id", "row", "at")).otherwise(F.col("h1"))
    group = Window.partitionBy("spread", "h1", "h2")
    compared = found.withColumn("spread", spread).withColumn("least", F.when(F.col("h1").isNotNull(), F.min("id").over(group)))
    gone = compared.where("h1 IS NULL OR id > least")
    hits = gone.groupBy("id", "row").agg(F.collect_list(F.struct("at", "many")).alias("runs"))  # of one document
    hits = hits.select("id", "row", F.col("runs.at").alias("starts"), F.col("runs.many").alias("many"))
    joined = base.join(hits, ["id", "row"], "left").select("id", "text", "starts", "many")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, starts, many in zip(*batch.columns[1:4]):
                words = text.as_py().encode().split() if text.is_valid else []
                n_words.append(len(words))
                ranges = []
                if starts.is_valid:
                    gone = _removed(len(words), np.array(starts.values, np.int64), np.array(many.values, np.int64), size)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    ranges = edges.reshape(-1, 2).tolist()
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
                spans.append(ranges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return K.map_batches(joined, rebuild, "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<long>>")


def brute_force(rows: list[tuple[int | None, str | None]], size: int = 50) -> list[tuple[int | None, int, int, str]]:
    """The contract, word for word, for small inputs in tests: (doc_id, n_words, n_removed, kept_sha256)."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[k : k + size])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1 if i is not None else 0):
            if least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
