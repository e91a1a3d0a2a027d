"""A kept vector index: inverted lists over centroids, with product-quantised residuals.

    lists/list=L        cid, code, v: the vectors nearest to centroid L, with the code of what the centroid leaves
    centroids           list, centroid, radius (the greatest angle of a vector of the list), n
    codebooks           part, entry, value
    settings            probes: lists that a search reads for each query unless it is told otherwise; the lists' schema

Centroids and codebooks are fitted on a sample of bounded size (``SAMPLE`` rows, the first in the order of the ids'
hashes); every row is put into a list. How many lists a query has to read is measured on the same sample when the index
is built: the fewest that hold ``TARGET`` of the ten nearest neighbours of the sample's vectors.

A search reads the partitions of the probed lists: first ids and codes only, scored by table lookup, then the vectors
of the best ``rerank`` rows of each query, compared exactly. ``exact=True`` goes on from there: a list can be passed over
for a query when its centroid's angle less the list's radius is beyond the angle of the k-th hit, and all others are
compared in full, so the result is that of ``retrieval.knn``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.similarity import cosine_similarity
from ..shared import exists
from .retrieval import CELLS, Nearest, slices, top_k

#: Rows that centroids, codebooks and the number of probes are fitted on.
SAMPLE = 65_536
#: Lists of an index at most, unless more are asked for; entries of a codebook.
MOST_LISTS, ENTRIES = 4096, 256
TARGET = 0.97
#: Queries that are searched at once.
BLOCK = 1024
_ROUNDS = 12
#: Slack for angles that are compared after rounding.
_SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centers**2).sum(1) / 2
    for lo in range(0, len(points), 4096):
        out[lo : lo + 4096] = np.argmax(points[lo : lo + 4096] @ centers.T - half, axis=1)
    return out


def _cluster(points: np.ndarray, k: int) -> np.ndarray:
    """Centers of k-means on the sample, started from its first points; a center without points stays."""
    centers = points[:k].copy()
    for _ in range(_ROUNDS):
        at = _nearest(points, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, points)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _parts(size: int) -> int:
    """The most parts of at least four components each, at most 16, that divide the vector."""
    return max(p for p in range(1, 17) if size % p == 0 and (p == 1 or size // p >= 4))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``: what is small of it (one row a list and a codebook entry) is held here."""

    spark: SparkSession
    path: str
    lists: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    codebooks: np.ndarray
    probes: int
    schema: str

    # ---- building

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "cid", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> VectorIndex:
        """An index of the rows that have a vector, in an empty folder. By default as many lists as the square root of their
        number, at most ``MOST_LISTS``."""
        spark = vectors.sparkSession
        if exists(spark, f"{path}/settings"):
            raise FileExistsError(f"there is an index at {path}")
        rows = vectors.select(F.col(id_col).alias("cid"), F.col(vector_col).alias("v")).where("v IS NOT NULL AND size(v) > 0")
        drawn = rows.orderBy(F.xxhash64("cid"), "cid").limit(sample).select(F.col("v").cast("array<double>").alias("v"))
        points = _unit(np.array([r[0] for r in drawn.collect()], float)) if not rows.isEmpty() else np.zeros((0, 1))
        if lists is None:
            lists = min(MOST_LISTS, max(1, round(math.sqrt(rows.count()))))
        centroids = _unit(_cluster(points, min(lists, len(points)))) if len(points) else np.zeros((0, 1))
        left = points - centroids[_nearest(points, centroids)] if len(points) else points
        n_parts = _parts(points.shape[1])
        width = points.shape[1] // n_parts
        entries = max(1, min(ENTRIES, len(points)))
        books = np.stack([_cluster(np.ascontiguousarray(left[:, p * width : (p + 1) * width]), entries) for p in range(n_parts)]) if len(points) else np.zeros((1, 0, 1))
        probes = _probes(points, centroids, target)
        cls._assign(rows, centroids, books).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
        schema = f"cid {dict(rows.dtypes)['cid']}, code binary, v {dict(rows.dtypes)['v']}, angle double, list int"
        stored = spark.read.schema(schema).parquet(f"{path}/lists")
        stored.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(spark.createDataFrame([(k, c) for k, c in enumerate(centroids.tolist())], "list int, centroid array<double>"), "list").coalesce(1).write.parquet(f"{path}/centroids")
        spark.createDataFrame([(p, e, v) for p, b in enumerate(books.tolist()) for e, v in enumerate(b)], "part int, entry int, value array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
        spark.createDataFrame([(probes, schema)], "probes int, schema string").coalesce(1).write.parquet(f"{path}/settings")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        lists = sorted(tuple(r) for r in spark.read.parquet(f"{path}/centroids").select("list", "centroid", "radius").collect())
        books: dict[int, dict[int, list[float]]] = {}
        for r in spark.read.parquet(f"{path}/codebooks").collect():
            books.setdefault(r["part"], {})[r["entry"]] = r["value"]
        codebooks = np.array([[b[e] for e in sorted(b)] for _, b in sorted(books.items())], float)
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(spark, path, np.array([x[0] for x in lists], np.int64), np.array([x[1] for x in lists], float), np.array([x[2] for x in lists], float), codebooks, settings["probes"], settings["schema"])

    @staticmethod
    def _assign(rows: DataFrame, centroids: np.ndarray, books: np.ndarray) -> DataFrame:
        """The rows with their list, the code of their residual and their angle to the centroid."""
        types = dict(rows.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _unit(_vectors(batch.column("v")))
                at = _nearest(unit, centroids)
                left = unit - centroids[at]
                width = books.shape[2]
                codes = np.stack([_nearest(left[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)], 1).astype(np.uint8)
                angle = np.arccos(np.clip((unit * centroids[at]).sum(1), -1, 1))
                angle[np.linalg.norm(unit, axis=1) == 0] = math.pi  # at distance 1 of every query, whatever the list
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("v"), pa.array(angle), pa.array(at, pa.int32())], ["cid", "code", "v", "angle", "list"])

        return rows.mapInArrow(run, f"cid {types['cid']}, code binary, v {types['v']}, angle double, list int")

    def add(self, vectors: DataFrame, id_col: str = "cid", vector_col: str = "embedding") -> VectorIndex:
        """Put further rows (of new ids) into the lists; centroids and codebooks stay. The index as it is then. One that was
        built of no vectors has no lists to put them into: an error."""
        if not len(self.lists):
            raise ValueError("the index was built without vectors; build it anew")
        rows = vectors.select(F.col(id_col).alias("cid"), F.col(vector_col).alias("v")).where("v IS NOT NULL AND size(v) > 0")
        of_all = np.zeros((int(self.lists.max()) + 1, self.centroids.shape[1]))
        of_all[self.lists] = self.centroids
        self._assign(rows, of_all, self.codebooks).hint("rebalance", "list").write.partitionBy("list").mode("append").parquet(f"{self.path}/lists")
        found = self.rows().groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        kept = self.spark.createDataFrame([(int(k), c) for k, c in zip(self.lists, self.centroids.tolist())], "list int, centroid array<double>")
        done = found.join(kept, "list").select("list", "centroid", "radius", "n").collect()  # one row a list
        self.spark.createDataFrame(done, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return VectorIndex.open(self.spark, self.path)

    # ---- searching

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The stored rows, of all lists or of some: their partitions alone are read then."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None, exact: bool = False, query_id: str = "query_id", vector_col: str = "embedding", digits: int = 9) -> DataFrame:
        """(query_id, cid, distance, dense_score, rank) as of ``retrieval.knn``: approximate, or with ``exact`` the same rows.
        The queries (a stated set) are searched in blocks of ``BLOCK``. ``rerank`` rows a query (20 k, 200 at least) are
        compared in full."""
        spark, rerank = self.spark, rerank or max(200, 20 * k)
        query_type = to_arrow_type(queries.schema[query_id].dataType)
        types = (dict(queries.dtypes)[query_id], dict(self.rows().dtypes)["cid"])
        out = spark.createDataFrame([], f"query_id {types[0]}, cid {types[1]}, distance double")
        block: list = []
        asked = queries.select(query_id, F.col(vector_col).cast("array<double>")).where(F.col(vector_col).isNotNull()).toLocalIterator()
        for r in [*asked, None]:
            if r is not None:
                block.append(r)
            if block and (r is None or len(block) == BLOCK) and len(self.lists):
                out = out.unionByName(self._search_block([x[0] for x in block], np.array([x[1] for x in block], float), k, probes or self.probes, rerank, exact, query_type, types, digits))
                block = []
        return top_k(out, k, F.col("distance"), F.col("cid")).withColumn("dense_score", 1 - F.col("distance"))

    def _search_block(self, ids: list, raw: np.ndarray, k: int, probes: int, rerank: int, exact: bool, query_type: pa.DataType, types: tuple[str, str], digits: int) -> DataFrame:
        spark, q = self.spark, _unit(raw)
        near = q @ self.centroids.T
        probed = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        of_list: dict[int, np.ndarray] = {}
        for column in np.unique(probed):
            of_list[int(self.lists[column])] = np.flatnonzero((probed == column).any(1))
        index_of = {int(x): n for n, x in enumerate(self.lists)}
        shared = spark.sparkContext.broadcast((q, near, np.einsum("qpw,pew->qpe", q.reshape(len(q), *self.codebooks.shape[::2]), self.codebooks)))

        def by_codes(batch: pa.RecordBatch, name: int, rows: np.ndarray, asking: np.ndarray) -> np.ndarray:
            """1 less the estimated cosine: the centroid's share and a table lookup for each part of the code."""
            _, near, tables = shared.value
            codes = np.frombuffer(b"".join(batch.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
            estimate = np.repeat(near[asking, index_of[name]][:, None], len(rows), axis=1)
            for p in range(codes.shape[1]):
                estimate += tables[asking, p][:, codes[:, p]]
            return 1 - estimate

        def in_full(batch: pa.RecordBatch, name: int, rows: np.ndarray, asking: np.ndarray) -> np.ndarray:
            return np.round(1 - shared.value[0][asking] @ _unit(_vectors(batch.column("v").take(pa.array(rows)))).T, digits)

        codes_only = self.rows(sorted(of_list)).select("list", "cid", "code")
        best = _scan(codes_only, of_list, by_codes, rerank, f"query int, list int, cid {types[1]}, distance double")
        best = top_k(best, rerank, F.col("distance"), F.col("cid"), by="query").select("query", "list", "cid")
        asking = spark.createDataFrame([(n, v) for n, v in enumerate(raw.tolist())], "query int, q array<double>")
        # At most BLOCK x rerank rows of three numbers are broadcast.
        full = self.rows(sorted(of_list)).select("list", "cid", "v").join(F.broadcast(best), ["list", "cid"]).join(F.broadcast(asking), "query")
        distance = F.round(1 - cosine_similarity(F.col("v"), F.col("q")), digits)
        found = full.select("query", "cid", distance.alias("distance"))
        named = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"query int, query_id {types[0]}")
        name = lambda df: df.join(F.broadcast(named), "query").select("query_id", "cid", "distance")
        if not exact:
            return name(found)
        edge = {r["query"]: r["distance"] for r in top_k(found, k, F.col("distance"), F.col("cid"), by="query").where(F.col("rank") == k).select("query", "distance").collect()}  # one row a query
        reach = np.array([math.acos(max(-1.0, min(1.0, 1 - edge[n]))) if n in edge else math.pi for n in range(len(ids))])
        # Vectors without length, queries too, are at distance 1 from everything: no angle holds for them.
        reach = np.where((np.linalg.norm(q, axis=1) == 0) | (reach >= math.pi / 2), math.pi, reach)
        open_lists = np.arccos(np.clip(near, -1, 1)) - self.radius <= reach[:, None] + _SLACK
        of_list = {int(self.lists[c]): np.flatnonzero(open_lists[:, c]) for c in np.flatnonzero(open_lists.any(0))}
        return name(_scan(self.rows(sorted(of_list)).select("list", "cid", "v"), of_list, in_full, k, f"query int, list int, cid {types[1]}, distance double").drop("list"))


def _scan(rows: DataFrame, of_list: dict[int, np.ndarray], distance: Callable[[pa.RecordBatch, int, np.ndarray, np.ndarray], np.ndarray], k: int, schema: str) -> DataFrame:
    """(query, list, cid, distance): of every task the best k rows of each query among the lists that the query asks for."""

    asked = 1 + max((int(x.max()) for x in of_list.values() if len(x)), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Nearest(asked, k)
        for batch in batches:
            for part in slices(batch, asked):
                lists = part.column("list").to_numpy(zero_copy_only=False)
                for name in np.unique(lists).tolist():
                    rows, asking = np.flatnonzero(lists == name), of_list[name]
                    kept.add(distance(part, name, rows, asking), asking, {"list": pa.array(np.full(len(rows), name), pa.int32()), "cid": part.column("cid").take(pa.array(rows))})
        best = kept.best()
        if best is not None:
            yield from best.rename_columns(["query", "list", "cid", "distance"]).to_batches(max_chunksize=CELLS)

    return rows.mapInArrow(run, schema)


def _probes(points: np.ndarray, centroids: np.ndarray, target: float, queries: int = 1024, k: int = 10) -> int:
    """The fewest probed lists that hold ``target`` of the k nearest neighbours of some of the sample's vectors in it."""
    if len(points) < 2:
        return 1
    q, list_of = points[:queries], _nearest(points, centroids)
    k = min(k, len(points) - 1)
    hits = np.empty((len(q), k), np.int64)
    for lo in range(0, len(q), 64):
        s = q[lo : lo + 64] @ points.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        hits[lo : lo + 64] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(q), 0), 1)
    needed = np.sort(np.take_along_axis(place, list_of[hits], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true rows of a query that were found; true rows as of ``retrieval.knn``."""
    hit = truth.select("query_id", "cid").join(found.select("query_id", "cid", F.lit(1).alias("hit")), ["query_id", "cid"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
