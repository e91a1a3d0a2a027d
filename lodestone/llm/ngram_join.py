"""Jaccard similarity join of n-gram sets by vertical partitioning, and the classes that its links make.

The global n-gram order puts n-grams that many documents have last and orders the others by hash. Two sets that
reach the threshold share an n-gram among the first few of that order (their prefixes), so prefixes give the
candidates; length and position rule out most. The order is then cut into fragments of about equal mass. Every set
falls apart along these cuts, one row a fragment; for every candidate pair each fragment's overlap is counted by
itself, and the counts are summed per pair.

What would grow with the square of a group of copies is avoided without dropping a link:
 - equal sets are one class (a digest), represented once per partition;
 - in each prefix n-gram's group all are first compared with one hub, the set that has the fewest rarer n-grams
   before the shared one: the copy nearest to what the group has in common. Near copies are one component after that;
 - then only pairs in different components are left that could still join two classes. The smaller set of a pair has
   a shared n-gram in a shorter prefix, and a set's position bounds the size of its partner, so most sets of a group
   that is not linked end before any pair is made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import sketch as S
from .columns import private_names
from .components import connected_components
from .scratch import materialize, release

FREQUENCY_BLOCK, MOST_FREQUENCY_BITS = 20, 26
#: Cells (4 bytes each) that a task holds before it counts them.
HELD_CELLS = 1 << 22
FRAGMENTS = 8
#: Pairs that may be broadcast: 16 MB. As many holders: 8 MB.
BROADCAST_PAIRS = 500_000
PREFILTER_ROWS, MOST_PREFILTER_BITS = 3, 28


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct n-gram hashes, index of each row's first) of runs of rows."""
    for lo, _, data, offsets in K.text_slices(column, K.SMALL_SLICE_BYTES):
        h, first = K.words(data, offsets, K.LOWER)
        n_words = np.diff(first)
        at, row = K.spans_to_index(first[:-1], np.maximum(n_words - size + 1, 0))
        grams = K.windows(h, size, 11)[at]
        for short in range(1, size):  # fewer words than an n-gram has: the whole sequence as one
            where = np.flatnonzero(n_words == short)
            if len(where):
                grams, row = np.r_[grams, K.mix(K.windows(h, short, 11)[first[where]], short)], np.r_[row, where]
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        once = np.ones(len(grams), bool)
        once[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[once], row[once]
        yield lo, grams, np.searchsorted(row, np.arange(len(offsets)))


def _partial_counts(columns: Iterator[pa.Array], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(block, cells): how often each cell comes, in turns of some HELD_CELLS n-grams; a block's turns are added up later."""

    def counted(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells.sort()
        edge = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << FREQUENCY_BLOCK, np.uint32))
        for block in np.flatnonzero(np.diff(edge)).tolist():
            cell, n = np.unique(cells[edge[block] : edge[block + 1]], return_counts=True)
            pair = np.concatenate([np.diff(cell & (1 << FREQUENCY_BLOCK) - 1, prepend=0), n]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(pair.tobytes(), 1)], pa.binary())], ["block", "cells"])

    held, n_held = np.empty(HELD_CELLS, np.uint32), 0
    for column in columns:
        for _, grams, _ in _sets(column, size):
            cells = (grams >> np.uint64(64 - bits)).astype(np.uint32)
            while len(cells):
                part, cells = cells[: len(held) - n_held], cells[len(held) - n_held :]
                held[n_held : n_held + len(part)] = part
                n_held += len(part)
                if n_held == len(held):
                    yield from counted(held)
                    n_held = 0
    yield from counted(held[:n_held])


def _frequencies(docs: DataFrame, size: int, total_bytes: int) -> tuple[int, dict[int, bytes], np.ndarray]:
    """(bits, compressed blocks, cuts). A one-row count sketch over all documents says for each cell how far its count
    is above the mean, in quarter powers of two. Cells grow with the text up to a bound; blocks are summed and graded
    apart. ``cuts`` cut the order of grades and hashes (see _order) into fragments of about equal mass."""
    bits = min(MOST_FREQUENCY_BITS, max(FREQUENCY_BLOCK, round(math.log2(max(1, total_bytes) / 50))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial_counts((batch.column(0) for batch in batches), size, bits)

    def grade(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << FREQUENCY_BLOCK, np.int64)
        for x in parts["cells"]:
            at, n = np.frombuffer(zlib.decompress(x), np.uint32).reshape(2, -1)
            total[np.cumsum(at.astype(np.int64))] += n
        steps = np.clip(4 * np.log2(np.maximum(total, 1) / max(1.0, total.mean())), 0, 255).astype(np.uint8)
        mass = np.bincount(steps, weights=total, minlength=256)
        return pd.DataFrame({"block": [key[0]], "bits": [zlib.compress(steps.tobytes(), 1)], "mass": [mass]})

    rows = K.map_batches(docs.select("text"), count, S.PARTIAL_SCHEMA).groupBy("block").applyInPandas(grade, "block long, bits binary, mass array<double>").collect()
    mass = np.sum([r["mass"] for r in rows], axis=0) if rows else np.zeros(256)
    upto = np.r_[0, np.cumsum(mass)]
    at = np.interp(np.arange(1, FRAGMENTS) * upto[-1] / FRAGMENTS, upto, np.arange(257)) if upto[-1] else np.arange(1, FRAGMENTS)
    cuts = at.astype(np.uint64) << np.uint64(56) | ((at % 1) * (1 << 56)).astype(np.uint64)
    return bits, {r["block"]: bytes(r["bits"]) for r in rows}, cuts


def _grades(bits: int, blocks: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << bits, np.uint8)
    for block, packed in blocks.items():
        out[block << FREQUENCY_BLOCK : block + 1 << FREQUENCY_BLOCK] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def _grade_of(grams: np.ndarray, grades: np.ndarray) -> np.ndarray:
    return grades[(grams >> np.uint64(65 - len(grades).bit_length())).astype(np.int64)]


def _order(grams: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Place of n-grams in the global order: the grade, then the first 56 bits of the hash."""
    return _grade_of(grams, grades).astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)


def _prefixes(grams: np.ndarray, first: np.ndarray, grades: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, row, position) of the n-grams of every row's prefix in the global order."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    rank = np.lexsort((grams, _grade_of(grams, grades), row))
    length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
    at, row = K.spans_to_index(first[:-1], length)
    return grams[rank[at]], row, at - first[row]


def _digest(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit digest of every row's set; 0 for an empty set."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(K.mix(grams, 29), out=total[1:])
    n = np.diff(first)
    d = K.mix(total[first[1:]] - total[first[:-1]], 31) + n.astype(np.uint64)
    return np.where(n > 0, np.where(d == 0, np.uint64(1), d), np.uint64(0))


def _table(docs: DataFrame, size: int, percent: int, total_bytes: int, classes: Broadcast) -> DataFrame:
    """For every row id, node (the set's digest), n; for a set with prefix n-grams that another may have also these (grams) and their positions (at)."""
    bits = min(MOST_PREFILTER_BITS, max(12, math.ceil(math.log2(max(1, total_bytes) / 8))))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, grades = [], set(), _grades(*classes.value)
        for batch in batches:
            for _, grams, first in _sets(batch.column(0), size):
                digest = _digest(grams, first)
                gram, row, _ = _prefixes(grams, first, grades, percent)
                new = np.array([not (d in seen or seen.add(d)) for d in digest.tolist()], bool)
                found.append(gram[new[row]])
        if found:
            yield from S.partial(np.concatenate(found), PREFILTER_ROWS, bits)

    blocks = docs.sparkSession.sparkContext.broadcast(S.merged(K.map_batches(docs.select("text"), first_pass, S.PARTIAL_SCHEMA)))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, grades = S.planes(blocks.value, PREFILTER_ROWS, bits), _grades(*classes.value)
        seen: set[int] = set()
        longs = pa.list_(pa.int64())
        for batch in batches:
            for lo, grams, first in _sets(batch.column(1), size):
                digest = _digest(grams, first)
                gram, row, at = _prefixes(grams, first, grades, percent)
                hit = S.repeated(gram, planes, bits)
                gram, row, at = gram[hit].view(np.int64), row[hit], at[hit]
                edge = np.searchsorted(row, np.arange(len(first)))
                n = np.diff(first)
                ids = batch.column(0).slice(lo, len(n))
                new = [i.is_valid and not (d in seen or seen.add(d)) for d, i in zip(digest.tolist(), ids)]
                spans = [slice(a, b) if f and b > a else None for a, b, f in zip(edge[:-1], edge[1:], new)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(digest.view(np.int64)), pa.array(n, pa.int64()), pa.array([x and gram[x] for x in spans], longs), pa.array([x and at[x] for x in spans], longs)],
                    ["id", "node", "n", "grams", "at"],
                )

    schema = "id long, node long, n long, grams array<long>, at array<long>"
    table = materialize(K.map_batches(docs.select("id", "text"), second_pass, schema), "ngrams")
    blocks.destroy()
    return table


def _fragments(rows: DataFrame, size: int, classes: Broadcast) -> DataFrame:
    """(node, fragment, grams) from rows (node, text): each set cut along the n-gram order, one row a fragment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, cuts = _grades(*classes.value), classes.value[2]
        for batch in batches:
            for lo, grams, first in _sets(batch.column(1), size):
                nodes = batch.column(0).slice(lo, len(first) - 1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(nodes)), np.diff(first))
                own = (_digest(grams, first).view(np.int64) == nodes)[row]  # a row of the same id may hold another text
                grams, row = grams[own], row[own]
                fragment = np.searchsorted(cuts, _order(grams, grades), "right")
                by = np.lexsort((fragment, row))
                grams, row, fragment = grams[by].view(np.int64), row[by], fragment[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])
                start = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), pa.array(grams, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[row[start]], pa.int64()), pa.array(fragment[start], pa.int32()), lists], ["node", "fragment", "grams"])

    return materialize(K.map_batches(rows, cut, "node long, fragment int, grams array<long>"), "fragments")


def _possible(percent: int, n: str, at: str, n2: str, at2: str) -> Column:
    """Whether sizes and the position of a shared n-gram (in each set) allow the threshold."""
    na, nb = F.col(n), F.col(n2)
    most = F.least(na - F.col(at), nb - F.col(at2))  # overlap * (100 + percent) >= percent * (na + nb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most * (100 + percent) >= percent * (na + nb))


def _rows_of(base: DataFrame, holders: DataFrame) -> DataFrame:
    """(node, text) of the holders (node, id). Few holders are broadcast. Of more, a Bloom filter of their ids, of bounded
    size, keeps most other texts out of the shuffle; the join decides. Either way no stage has Python twice, which would
    double the workers that an executor holds, also in the steps after it."""
    spark = base.sparkSession
    n = holders.count()
    if n <= BROADCAST_PAIRS:
        return base.select("id", "text").join(F.broadcast(holders), "id").select("node", "text")
    bits = min(MOST_PREFILTER_BITS, max(12, math.ceil(math.log2(max(1, n) * 12))))

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        if ids:  # every id twice: the merged planes mark what counts two or more
            yield from S.partial(np.repeat(np.concatenate(ids).astype(np.int64).view(np.uint64), 2), 2, bits)

    blocks = spark.sparkContext.broadcast(S.merged(K.map_batches(holders.select("id"), note, S.PARTIAL_SCHEMA)))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = S.planes(blocks.value, 2, bits)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(S.repeated(ids, planes, bits)))

    return K.map_batches(base.select("id", "text"), maybe, "id long, text string").join(holders.hint("merge"), "id").select("node", "text")


def _left(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb), stored, whose prefixes leave the threshold possible.

    Of the set whose prefix ends first in the global order, what is common lies in both prefixes or behind its own, so
    the overlap of the prefixes and the longer rest bound the sum: pairs that share a chance n-gram end here, before
    any text is read. A node that several partitions have comes with the same prefix from each.
    """
    few = (lambda df: F.broadcast(df)) if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    side = lambda node, kept: table.where("grams IS NOT NULL").select(F.col("node").alias(node), F.col("grams").alias(kept))
    second = side("b", "y").join(few(pairs.select("b").distinct()), "b", "left_semi").dropDuplicates(["b"])
    met = side("a", "x").join(few(pairs), "a").join(second, "b")
    behind = F.ceil(percent * F.greatest("na", "nb") / 100) - 1
    most = F.size(F.array_intersect("x", "y")) + behind
    return materialize(met.where(most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb").distinct(), "left")


def _linked(pairs: DataFrame, base: DataFrame, known: DataFrame, size: int, percent: int, classes: Broadcast) -> DataFrame:
    """The pairs (a, b, na, nb), stored, that reach the threshold, as (a, b), stored: one overlap a pair and fragment,
    summed per pair. A row that comes twice has its fragments twice: the same overlap, counted once by the largest."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    holders = materialize(known.groupBy("node").agg(F.min("id").alias("id")).join(needed, "node", "left_semi"), "holders")
    pieces = _fragments(_rows_of(base, holders), size, classes)
    side = lambda node, kept: pieces.select(F.col("node").alias(node), "fragment", F.col("grams").alias(kept))
    # Second ends are mostly hubs, far fewer than first ends: only their fragments travel to meet the others'. Pairs
    # (four numbers each) are broadcast while they are few, so that first ends travel once.
    few = (lambda df: F.broadcast(df)) if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    second = side("b", "y").join(few(pairs.select("b").distinct()), "b", "left_semi")
    both = side("a", "x").join(few(pairs), "a").join(second, ["b", "fragment"])
    counted = both.groupBy("a", "b", "na", "nb", "fragment").agg(F.max(F.size(F.array_intersect("x", "y"))).alias("o"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    links = materialize(summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b"), "links")
    release(holders, pieces)
    return links


def _distinct_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the possible pairs in rows (node, n, at, node2, n2, at2), stored; b is the hub."""
    ends = [F.col(p).alias(name) for p, name in (("node", "a"), ("node2", "b"), ("n", "na"), ("n2", "nb"))]
    return materialize(rows.where(_possible(percent, "n", "at", "n2", "at2")).select(*ends).distinct(), "pairs")


def _prefix_groups(table: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, at, node2, n2, at2), stored: rows of prefix n-grams that two sets have, each with the n-gram's hub.

    Of two linked sets the smaller (either, of equal sizes) holds the shared n-gram so early that a twin of its size
    could link with it; ``least`` is the size of the smallest such set. A row whose position does not even allow a
    partner of that size ends here.
    """
    g = table.where("grams IS NOT NULL").select("node", "n", F.explode(F.arrays_zip("grams", "at")).alias("g"))
    groups = g.select(F.col("g.grams").alias("gram"), "node", (F.shiftleft(F.col("g.at"), 32) + F.col("n")).alias("pos"))
    n, at = F.col("pos").bitwiseAND((1 << 32) - 1), F.shiftright("pos", 32)
    early = (100 + percent) * (n - at) >= 2 * percent * n
    several = groups.groupBy("gram").agg(F.min(F.struct("pos", "node")).alias("hub"), F.max("node").alias("y"), F.min("node").alias("x"), F.min(F.when(early, n)).alias("least"))
    # Stored, so that both sides of the join are plain shuffles, which can be split where they are skewed.
    several = materialize(several.where("x != y AND least IS NOT NULL").select("gram", F.col("hub.pos").alias("pos2"), F.col("hub.node").alias("node2"), "least"), "hubs")
    partner = F.greatest(F.col("least"), F.ceil(percent * n / 100))
    rows = groups.join(several.hint("merge"), "gram").where((100 + percent) * (n - at) >= percent * (n + partner))
    hub = [F.col("pos2").bitwiseAND((1 << 32) - 1).alias("n2"), F.shiftright("pos2", 32).alias("at2")]
    shared = materialize(rows.select("gram", "node", n.alias("n"), at.alias("at"), "node2", *hub), "shared")
    release(several)
    return shared


def _across(shared: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one n-gram whose sets are in different components and might still link.

    Where all sets of an n-gram are in its hub's component nothing is left. Elsewhere at least one of a pair is a
    stranger to the hub, and the smaller set's row is an early one.
    """
    named = lambda node, c: parts.select(F.col("node").alias(node), F.col("component").alias(c))
    rows = shared.join(named("node", "c"), "node", "left").join(named("node2", "c2"), "node2", "left")
    rows = rows.select("gram", "node", "n", "at", F.coalesce("c", "node").alias("c"), F.coalesce("c2", "node2").alias("hub"))
    rows = materialize(rows.withColumn("stranger", F.col("c") != F.col("hub")).drop("hub"), "rows")
    unsettled = materialize(rows.where("stranger").select("gram").distinct(), "unsettled")
    rows = materialize(rows.join(unsettled, "gram"), "rows")
    early = rows.where((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"))
    early = early.select("gram", *[F.col(c).alias(c + "2") for c in ("node", "n", "at", "c", "stranger")])
    crossed = rows.join(early.where("stranger2"), "gram").unionByName(rows.where("stranger").join(early.where("NOT stranger2"), "gram"))
    return crossed.where((F.col("c") != F.col("c2")) & (F.col("n") >= F.col("n2")) & _possible(percent, "n", "at", "n2", "at2"))


def similar_sets(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set: distinct ``size``-word n-grams of its text (words: anything but ASCII white space, A-Z in lower
    case); with fewer words the whole sequence as one; null and empty texts have empty sets and link with nothing.
    Documents link when 100 * intersection >= ``percent`` * union; component_id is the smallest id that links reach.
    Rows of one id count as one document (their sets are linked); a row without an id gets no component. Other columns
    are ignored; an empty table gives an empty result. N-grams and sets are compared by 64 bits of hash.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    classes = base.sparkSession.sparkContext.broadcast(_frequencies(base, size, total))
    table = _table(base, size, percent, total, classes)

    members = table.select("id", "node", "n")
    known = members.where("n > 0 AND id IS NOT NULL")
    shared = _prefix_groups(table, percent)
    first = _left(_distinct_pairs(shared.where("node != node2"), percent), table, percent)
    links = _linked(first, base, known, size, percent, classes)
    parts = materialize(connected_components(links), "parts")  # its size is known to the joins then
    rest = _left(_distinct_pairs(_across(shared, parts, percent), percent), table, percent)
    if not rest.isEmpty():
        links = links.unionByName(_linked(rest, base, known, size, percent, classes))
    classes.destroy()
    release(shared, first, rest, parts)

    twice = known.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("id", "a")
    same_id = known.join(twice, "id").where("a != node").select("a", F.col("node").alias("b"))
    parts = connected_components(links.unionByName(same_id))

    nodes = known.groupBy("node").agg(F.min("id").alias("least")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(named, "component").select("node", "component_id")
    out = members.join(named, "node", "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of ``docs`` (the smallest id; of its rows the one with the least text hash), all columns.

    Documents without words are classes of their own; rows without an id stay; an empty table stays empty. ``docs`` may
    have columns of any other names.
    """
    keep, nth = private_names(docs, "keep", "nth")
    out = similar_sets(docs, id_col=id_col, text_col=text_col, **options)
    first = out.where("component_id = doc_id").select(F.col("doc_id").alias(keep)).distinct()
    kept = docs.join(first, F.col(id_col).cast("long") == F.col(keep), "left_semi")
    row = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(F.col(text_col))))
    kept = kept.withColumn(nth, row).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def brute_force(rows: list[tuple], size: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs; for small inputs with distinct ids."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(fold).encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                o = len(a & b)
                if 100 * o >= percent * (len(a) + len(b) - o):
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return [(i, len(sets[i]), find(i)) for i in ids]
