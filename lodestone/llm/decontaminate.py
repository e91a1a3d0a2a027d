"""Benchmark decontamination with a generalised suffix automaton over the normalised test items.

The automaton is built from the items' word ids (one automaton, a fresh start for each item). Documents stream
through it word by word; the state's match length says how long a stretch of words, ending here, occurs in some
item. A stretch of ``window`` words or more hits; an item with fewer words hits as a whole.

Words outside the items' vocabulary reset the automaton, so only runs of known words that could hold a window are
streamed. The items are a stated query set, dealt into blocks of at most ``block_bytes`` of text. Their automata are
built one after another and broadcast as flat arrays (some 60 bytes a word). A worker holds one block at a time: it
loads a block, streams what it has of a batch through it and lets it go before the next.

Most documents hold no window of any item. A gate in front of the automata says which may: the hashes of all items'
windows, as a bit table and a sorted array (some 12 bytes a word, all blocks together). Documents' windows are hashed the
same way, in arrays, so none is missed; what the gate lets through the automata decide.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

#: Bytes of item text in an automaton.
BLOCK_BYTES = 1 << 20
_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z in lower case; null: none."""
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """All stretches of words of the items, and for stretches of ``window`` words (or whole shorter items) the items they are in.

    Kept as flat arrays: the transitions of a state are a range of (word, target), sorted by word; the items of a window
    are a range of item numbers at the shortest state that holds it; ``short_up`` leads along the suffix links to the
    states where a short item ends.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ids = {k: n for n, k in enumerate(dict.fromkeys(k for k, _ in items))}
        self.item_ids = list(ids)
        self.least = min([min(len(w), window) for _, w in items if w], default=window)
        ends: list[tuple[int, int]] = []  # the state and the item of every word that ends a window
        self.short: dict[int, list[tuple[int, int]]] = {}
        for key, words in items:
            last = 0
            for n, w in enumerate(words, 1):
                last = _extend(nxt, link, length, last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                if n >= window:
                    ends.append((last, ids[key]))
            if words and len(words) < window:
                self.short.setdefault(last, []).append((len(words), ids[key]))

        self.link, self.length = array("i", link), array("i", length)
        order = np.argsort(np.array(length), kind="stable")[1:].tolist()
        self.top = array("i", range(len(nxt)))  # the shortest suffix of a state that still holds its window
        self.short_up = array("i", [-1]) * len(nxt)
        for s in order:
            up = link[s]
            if length[up] >= window:
                self.top[s] = self.top[up]
            self.short_up[s] = s if s in self.short else self.short_up[up]
        pairs = np.array(sorted({(self.top[s], k) for s, k in ends}), np.int32).reshape(-1, 2)
        self.item_first = array("i", np.searchsorted(pairs[:, 0], np.arange(len(nxt) + 1)).astype(np.int32).tobytes())
        self.item = array("i", np.ascontiguousarray(pairs[:, 1]).tobytes())
        self.first = array("i", [0])
        self.word, self.target = array("i"), array("i")
        for edges in nxt:
            for c, t in sorted(edges.items()):
                self.word.append(c)
                self.target.append(t)
            self.first.append(len(self.word))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans [start, end) of a document's words, and the indices of the items with occurring windows."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False)).reshape(-1, 2)
        spans: list[list[int]] = []
        found: set = set()
        first, word, target, link, length, window, short_up = self.first, self.word, self.target, self.link, self.length, self.window, self.short_up
        for lo, hi in known[known[:, 1] - known[:, 0] >= self.least].tolist():
            state = matched = 0
            for at, c in enumerate(ids[lo:hi].tolist(), lo + 1):
                while True:
                    a, b = first[state], first[state + 1]
                    if b - a > 1:
                        a = bisect_left(word, c, a, b)
                    if a < b and word[a] == c:
                        state = target[a]
                        matched += 1
                        break
                    if not state:
                        break
                    state = link[state]
                    matched = length[state]
                hit = 0
                if matched >= window:
                    top = self.top[state]
                    found.update(self.item[self.item_first[top] : self.item_first[top + 1]])
                    hit = matched
                s = short_up[state]
                while s > 0:
                    for n, item in self.short[s]:
                        if n <= matched:
                            found.add(item)
                            hit = max(hit, n)
                    s = short_up[link[s]]
                if hit:
                    start = at - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return [(a, b) for a, b in spans], found


def _extend(nxt: list[dict[int, int]], link: list[int], length: list[int], last: int, c: int) -> int:
    """The state of the words read so far and ``c``, ``last`` being the state before it."""

    def clone(p: int, q: int) -> int:
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        k = len(nxt) - 1
        link[q] = k
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k

    if c in nxt[last]:
        q = nxt[last][c]
        return q if length[q] == length[last] + 1 else clone(last, q)
    nxt.append({})
    link.append(0)
    length.append(length[last] + 1)
    cur, p = len(nxt) - 1, last
    while p != -1 and c not in nxt[p]:
        nxt[p][c] = cur
        p = link[p]
    if p != -1:
        q = nxt[p][c]
        link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
    return cur


Item = tuple[tuple[bool, str], str | None]


def _blocks(items: Iterator[Item], most: int) -> Iterator[list[tuple[tuple[bool, str], list[bytes]]]]:
    block, held = [], 0
    for key, text in items:
        if words := item_words(text):
            if block and held + len(text) > most:
                yield block
                block, held = [], 0
            block.append((key, words))
            held += len(text)
    if block:
        yield block


class WindowGate:
    """Hashes of all windows of items (of whole shorter items), by number of words."""

    def __init__(self, window: int):
        self.window = window
        self.hashes: dict[int, list[np.ndarray]] = {}
        self.tables: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def add(self, words: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(words), np.uint8)
        h, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
        size = min(self.window, len(h))
        self.hashes.setdefault(size, []).append(K.windows(h, size, size))

    def close(self) -> WindowGate:
        """Bit tables of at least 32 bits a window: one in 32 of other windows is looked up in the sorted array."""
        for size, parts in self.hashes.items():
            every = np.unique(np.concatenate(parts))
            power = max(10, int(32 * len(every)).bit_length())
            at = every >> np.uint64(64 - power)
            bits = np.zeros(1 << (power - 3), np.uint8)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.tables[size] = (64 - power, bits, every)
        self.hashes = {}
        return self

    def look(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of words, and whether any of its windows is an item's by hash."""
        counts, hit = np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for lo, hi, data, offsets in K.text_slices(column, K.SMALL_SLICE_BYTES):
            h, first = K.words(data, offsets, K.ALNUM)
            counts[lo:hi] = np.diff(first)
            for size, (shift, bits, every) in self.tables.items():
                w = K.windows(h, size, size)
                at = w >> np.uint64(shift)
                some = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                place = np.minimum(np.searchsorted(every, w[some]), len(every) - 1)
                some = some[every[place] == w[some]]
                text = np.searchsorted(first, some, "right") - 1
                hit[lo + text[some + size <= first[text + 1]]] = True
        return counts, hit


def _broadcast_automata(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int, item_id_col: str, item_text_col: str) -> tuple[list, Broadcast]:
    """Items come to the driver in the order of their ids, one partition at a time; a null id is an item of its own."""
    rows = benchmark.select(F.col(item_id_col).isNull().alias("none"), F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).alias("text"))
    items = (((r[0], r[1]), r[2]) for r in rows.distinct().orderBy("none", "id", "text").toLocalIterator())
    gate, shared = WindowGate(window), []
    for block in _blocks(items, block_bytes):
        for _, words in block:
            gate.add(words)
        shared.append(spark.sparkContext.broadcast(SuffixAutomaton(block, window)))
    return shared, spark.sparkContext.broadcast(gate.close())


def _let_go(block: Broadcast) -> None:
    """A task's copy of a broadcast value goes; it is read from the worker's disk again when it is next asked for."""
    if block._path is not None:
        block.__dict__.pop("_value", None)


def _scan_batch(column: pa.Array, shared: list, gate: WindowGate) -> list[tuple[int, list[list[int]], list[str]]]:
    """For each text its number of words, merged hit spans and the items' ids, sorted as strings."""
    counts, hit = gate.look(column)
    suspects = np.flatnonzero(hit).tolist()
    spans: dict[int, list] = {k: [] for k in suspects}
    found: dict[int, set] = {k: set() for k in suspects}
    for block in shared if suspects else ():
        automaton = block.value
        for k in suspects:
            s, f = automaton.scan(column[k].as_buffer().to_pybytes().translate(_FOLD).split())
            spans[k] += s
            found[k].update(automaton.item_ids[x] for x in f)
        if len(shared) > 1:
            del automaton
            _let_go(block)
    out: list[tuple[int, list[list[int]], list[str]]] = [(n, [], []) for n in counts.tolist()]
    for k in suspects:
        merged: list[list[int]] = []
        for a, b in sorted(spans[k]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[k] = (out[k][0], merged, sorted(name for _, name in found[k]))
    return out


def _contaminated(n_hit: int, n_words: int, share: float) -> bool:
    return n_hit > 0 and n_hit >= share * n_words - 1e-9


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated (see find_contamination), all columns unchanged; no shuffle."""
    shared, gate = _broadcast_automata(docs.sparkSession, benchmark, window, block_bytes, item_id_col, item_text_col)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scan_batch(batch.column(at), shared, gate.value)
            keep = [not _contaminated(sum(b - a for a, b in spans), n_words, share) for n_words, spans, _ in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return K.map_batches(docs, clean, docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), hit_spans, contaminated.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter item. A
    document is contaminated if a word is hit and at least ``share`` of its words are. Null texts have no words;
    null items and items without words hit nothing; items of one id are one item, in one block or several; a null item
    id is an item of its own, shown as "null". Rows are judged one by one, so repeated rows repeat their result. Other
    columns are ignored; an empty table gives an empty result. The items (not the documents) pass through the driver, in
    blocks of at most ``block_bytes`` of text (a longer item makes a larger one).
    """
    shared, gate = _broadcast_automata(docs.sparkSession, benchmark, window, block_bytes, item_id_col, item_text_col)
    names = ["doc_id", "n_words", "n_hit", "item_ids", "hit_spans", "contaminated"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for n_words, merged, found in _scan_batch(batch.column(1), shared, gate.value):
                n_hit = sum(b - a for a, b in merged)
                for col, value in zip(out, (n_words, n_hit, found, merged, _contaminated(n_hit, n_words, share))):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.list_(pa.int64()))), pa.array(out[4], pa.bool_())], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return K.map_batches(slim, judge, "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_spans array<array<long>>, contaminated boolean")


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by comparing every window; for small inputs."""
    grams: dict[tuple, set] = {}
    for key, text in items:
        w = item_words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add((key is None, str(key)))
    out = []
    for doc_id, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (own := grams.get(tuple(w[k : k + size]))) is not None:
                    found |= own
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted("null" if none else key for none, key in found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
