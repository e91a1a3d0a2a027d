"""Product quantisation of vectors in integers: codebooks by k-means, codes by exact nearest entries.

Components become integers floor(4096 x), vectors are cut into equal parts, and each part position has a codebook. The
nearest entry of a part is found in a vantage-point tree over the codebook's entries: a node holds one entry, and the rest
are in two halves by their distance from it. Branches are cut by the triangle inequality. Everything is an integer: a
node's radii are square roots rounded outwards and so are the distances of points, a branch is visited when it might hold
an entry at the best distance too, and squared distances decide, equal ones by the lower index. So the tree never changes
the result.

A round reads the vectors once. A task keeps a count and a sum for each entry, so a round shuffles one row a task and
entry and the driver gets one row an entry. Rows that stand for lost tasks are computed again; nothing is kept between rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .kernel import map_batches
from .scratch import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Scaled components beyond this would let squared distances overflow 64 bits; they are an error.
LARGEST = 1 << 28
#: Vectors that a task works on at once.
_ROWS = 1 << 14


def _root(squared: np.ndarray) -> np.ndarray:
    """Square roots of integers, rounded down."""
    r = np.sqrt(squared.astype(np.float64)).astype(np.int64)
    r -= r * r > squared
    return r + ((r + 1) * (r + 1) <= squared)


@dataclass
class _Branch:
    """A subtree and the least and greatest distance (rounded outwards) of its entries from the entry above it."""

    node: _Node
    least: int
    greatest: int


@dataclass
class _Node:
    index: int
    entry: np.ndarray
    split: int
    inside: _Branch | None
    outside: _Branch | None


def vantage_tree(entries: np.ndarray, indices: list[int] | None = None) -> _Node:
    """The tree over ``entries`` (integer rows); an entry that lies far from the others stands above them."""
    indices = list(range(len(entries))) if indices is None else indices
    rows = entries[indices]
    spread = ((rows[:, None, :] - rows[None, :, :]) ** 2).sum(2).max(1)
    top = indices[int(np.argmax(spread))]
    rest = [i for i in indices if i != top]
    if not rest:
        return _Node(top, entries[top], 0, None, None)
    squared = ((entries[rest] - entries[top]) ** 2).sum(1)
    order = np.argsort(squared, kind="stable")
    half = (len(rest) + 1) // 2

    def branch(chosen: np.ndarray) -> _Branch | None:
        if not len(chosen):
            return None
        low, high = _root(np.array([squared[chosen].min(), squared[chosen].max()])).tolist()
        return _Branch(vantage_tree(entries, [rest[k] for k in chosen]), low, high + 1)

    return _Node(top, entries[top], int(squared[order[half - 1]]), branch(order[:half]), branch(order[half:]))


def nearest(tree: _Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of every point's nearest entry (the lower one of equals) and the squared distance."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    at = np.full(len(points), np.iinfo(np.int64).max)

    def enter(branch: _Branch | None, rows: np.ndarray, down: np.ndarray) -> None:
        if branch is None or not len(rows):
            return
        bound = np.maximum(np.maximum(down - branch.greatest, branch.least - (down + 1)), 0)
        rows = rows[bound * bound <= best[rows]]  # an entry at exactly the bound may have the lower index
        if len(rows):
            visit(branch.node, rows)

    def visit(node: _Node, rows: np.ndarray) -> None:
        gap = points[rows] - node.entry
        squared = (gap * gap).sum(1)
        better = (squared < best[rows]) | ((squared == best[rows]) & (node.index < at[rows]))
        best[rows[better]], at[rows[better]] = squared[better], node.index
        down, near = _root(squared), squared <= node.split
        for chosen, first, second in ((near, node.inside, node.outside), (~near, node.outside, node.inside)):
            enter(first, rows[chosen], down[chosen])
            enter(second, rows[chosen], down[chosen])

    if len(points):
        visit(tree, np.arange(len(points)))
    return at, best


def _usable(vector: Column, size: int | None = None) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.size(vector) > 0 if size is None else F.size(vector) == size
    return vector.isNotNull() & F.coalesce(fits & ~odd, F.lit(False))


def _scaled(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    ints = np.floor(values * float(SCALE))
    if len(ints) and np.abs(ints).max() > LARGEST:
        raise ValueError(f"vector components beyond {LARGEST // SCALE} cannot be compressed in 64-bit integers")
    return ints.astype(np.int64).reshape(-1, size)


def _nearest_of_parts(vectors: np.ndarray, trees: list[_Node]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = vectors.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        part = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
        yield (p, part, *nearest(tree, part))


def _first_vectors(vectors: DataFrame, n_parts: int, n_entries: int) -> np.ndarray | None:
    """Scaled vectors of the smallest ids; of an id's repeated rows the one that is smallest in order."""
    known = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    ids = [r[0] for r in known.select("vec_id").distinct().orderBy("vec_id").limit(n_entries).collect()]
    if not ids:
        return None
    rows = known.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    rows = [r["v"] for r in sorted(rows, key=lambda r: r["vec_id"])]
    size = len(rows[0])
    if size % n_parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {n_parts} equal parts")
    return _scaled(pa.array([r for r in rows if len(r) == size], pa.list_(pa.float64())), size)


def train_codebooks(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """Codebooks as integers by part position, entry and component; None if no vector is usable. Every usable vector takes
    part in every round (see compress_vectors for what is usable)."""
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    first = _first_vectors(slim, n_parts, n_entries)
    if first is None:
        return None
    size, width = first.shape[1], first.shape[1] // n_parts
    books = first.reshape(len(first), n_parts, width).transpose(1, 0, 2).copy()
    used = slim.where(_usable(F.col("v"), size)).select("v")
    sums = [f"s{k}" for k in range(width)]
    for _ in range(rounds):
        parts_of = map_batches(used, _summing([vantage_tree(b) for b in books], size, books.shape[1]), ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums)))
        for r in parts_of.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect():  # one row an entry
            books[r["part"], r["entry"]] = [r[c] // r["n"] for c in sums]
    return books


def _summing(trees: list[_Node], size: int, n_entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(trees), n_entries), np.int64)
        total = np.zeros((len(trees), n_entries, size // len(trees)), np.int64)
        for vectors in _blocks(batches, size):
            for p, part, at, _ in _nearest_of_parts(vectors[0], trees):
                count[p] += np.bincount(at, minlength=n_entries)
                for e in np.flatnonzero(np.bincount(at)):
                    total[p, e] += part[at == e].sum(0)
        part, entry = np.nonzero(count)
        if len(part):
            columns = [part, entry, count[part, entry], *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "n", *[f"s{k}" for k in range(total.shape[2])]])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[pa.RecordBatch]]]:
    """Scaled vectors of some batches together with these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield np.concatenate([_scaled(b.column("v"), size) for b in held]), held
            held = []
    if held:
        yield np.concatenate([_scaled(b.column("v"), size) for b in held]), held


def encode_vectors(vectors: DataFrame, codebooks: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, label, code (two hexadecimal digits a part), error (squared distance)."""
    size = codebooks.shape[0] * codebooks.shape[2]
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = StructType([*slim.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    trees = [vantage_tree(b) for b in codebooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, size):
            codes, error = np.zeros((len(block), len(trees)), np.uint8), np.zeros(len(block), np.int64)
            for p, _, at, squared in _nearest_of_parts(block, trees):
                codes[:, p] = at
                error += squared
            done = 0
            for b in held:
                rows = slice(done, done := done + b.num_rows)
                code = pa.array([c.tobytes().hex() for c in codes[rows]], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(error[rows])], ["vec_id", "label", "code", "error"])

    return map_batches(slim.where(_usable(F.col("v"), size)), run, schema)


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, label, code, error, label_error (of all vectors of its label; nulls are one label)
    and codebooks_sha256.

    Vectors that are null, empty or of another length than that of the smallest id, or that hold a null or non-finite
    component, are not usable and left out. Codebooks start from the smallest different ids; with fewer ids than entries
    there are fewer entries. A null id is kept but starts no entry. Repeated rows are coded alike, and each counts. A table
    without usable vectors gives an empty result. Components beyond 65,536 in size are an error, as is a length that does
    not divide by the number of parts. At most 256 entries.
    """
    if n_entries > 256:
        raise ValueError("a code has one byte a part")
    books = train_codebooks(vectors, n_parts, n_entries, rounds, id_col, vector_col)
    if books is None:
        books = np.zeros((n_parts, 1, 1), np.int64)
        vectors = vectors.limit(0)
    coded = materialize(encode_vectors(vectors, books, id_col, vector_col, label_col), "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def oracle_sql(n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The whole job in SQL: a common table expression for every assignment and every codebook."""
    steps = [
        f"""parts AS MATERIALIZED (
    SELECT vec_id, label, p, list_transform(embedding[p * w + 1:(p + 1) * w], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c
    FROM (SELECT *, len(embedding) // {n_parts} AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), range({n_parts}) r(p)
), book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM parts
    WHERE vec_id IN (SELECT vec_id FROM parts WHERE p = 0 ORDER BY vec_id LIMIT {n_entries})
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT vec_id, label, p, any_value(c) AS c, min({{'d': d, 'e': e}}) AS best FROM (
        SELECT x.vec_id, x.label, x.p, x.c, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS d
        FROM parts x JOIN book{r} b USING (p))
    GROUP BY vec_id, label, p
)""")
        if r < rounds:
            steps.append(f"""sums{r} AS MATERIALIZED (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
        SELECT p, best.e AS e, i, floor(sum(c[i])::DOUBLE / count(*))::BIGINT AS m FROM near{r}, range(1, 1025) q(i) WHERE i <= len(c) GROUP BY p, best.e, i)
    GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(s.c, b.c) AS c FROM book{r} b LEFT JOIN sums{r} s USING (p, e)
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
