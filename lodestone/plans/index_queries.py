"""Registered queries of kept indexes: they are built from the tables, changed, and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex, recall
from ..shared import fresh_path
from .registry import Tables, query

_SCORED = """
  left_docs AS (SELECT doc_id AS cid, text FROM {documents} WHERE doc_id % 11 <> 0),
  tokens AS (SELECT cid, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM left_docs),
  stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean FROM tokens),
  terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {benchmark}),
  asked AS (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id),
  post AS (SELECT cid, len(ts) AS length, term, count(*) AS tf FROM (SELECT cid, ts, unnest(ts) AS term FROM tokens) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  scored AS (SELECT query_id, cid, count(*) AS hits, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
             FROM post JOIN df USING (term) JOIN terms USING (term), stats GROUP BY query_id, cid)"""


def _changed_index(t: Tables) -> TextIndex:
    """All documents, a third of them first with other texts, and of the whole every eleventh taken out again."""
    docs = t.documents.select(F.col("doc_id").alias("cid"), "text")
    late = F.col("cid") % 3 == 0
    index = TextIndex.build(docs.withColumn("text", F.when(late, F.concat(F.lit("stale "), F.reverse("text"))).otherwise(F.col("text"))).where("cid % 7 != 0"), fresh_path(t.spark, "text-index"))
    index.put(docs.where(late | F.expr("cid % 7 = 0")))
    index.remove(docs.where("cid % 11 = 0"))
    return index


def _items(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""WITH {_SCORED}
SELECT query_id, cid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM scored) WHERE rank <= 10""")
def text_index_topk(t: Tables) -> DataFrame:
    """Searched over a base and two deltas."""
    return _changed_index(t).search(_items(t), 10)


@query(f"""WITH {_SCORED}
SELECT query_id, cid, score, CAST(rank AS INT) AS rank FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM scored JOIN asked USING (query_id) WHERE hits = n) WHERE rank <= 10""")
def text_index_all_terms(t: Tables) -> DataFrame:
    """Searched after compaction, every term asked for."""
    index = _changed_index(t)
    index.compact()
    return index.search(_items(t), 10, operator="and")


@query("SELECT doc_id AS cid, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS length FROM {documents} WHERE doc_id % 11 <> 0")
def text_index_documents(t: Tables) -> DataFrame:
    return _changed_index(t).documents()


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


def _vector_index(t: Tables) -> VectorIndex:
    """Nine tenths of the vectors when it is built, the rest added afterwards."""
    rows = t.embeddings.select(F.col("vec_id").alias("cid"), "embedding")
    return VectorIndex.build(rows.where("cid % 10 != 3"), fresh_path(t.spark, "vector-index")).add(rows.where("cid % 10 = 3"))


@query()
def vector_index_topk(t: Tables) -> DataFrame:
    """Approximate; its recall is a query of its own."""
    return _vector_index(t).search(t.vector_queries, 10).select("query_id", "cid", "rank", F.round("distance", 6).alias("distance"))


@query()
def vector_index_recall(t: Tables) -> DataFrame:
    found = _vector_index(t).search(t.vector_queries, 10)
    return recall(found, retrieval.knn(t.embeddings, t.vector_queries, 10, id_col="vec_id"))


@query(f"""
SELECT query_id, cid, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cid) AS rank FROM (
    SELECT q.query_id, e.vec_id AS cid, round(1 - {_COSINE}, 9) AS distance FROM {{vector_queries}} q, {{embeddings}} e))
WHERE rank <= 10""")
def vector_index_exact(t: Tables) -> DataFrame:
    """Lists that the triangle inequality rules out are not read; the result is the exact one."""
    return _vector_index(t).search(t.vector_queries, 10, exact=True).select("query_id", "cid", "rank", F.round("distance", 6).alias("distance"))
