"""Registered queries that run operators on whole texts, pages and vectors whose other queries use keys or few fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fusion, graph, maintenance, mutations
from ..shared import fresh_path
from ..sources import files
from . import pipeline
from .queries import _bonus, _tokens, corpus_chunks
from .registry import Tables, query

_POOL = f"""
  taken AS (SELECT item_id AS query_id, {_tokens('text')} AS q FROM {{benchmark}}),
  parts AS (SELECT query_id, cid, rank, source_path, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^ | $', '', 'g') AS whole, {_tokens('text')} AS p FROM {{candidates}}),
  pool AS (SELECT *, array_to_string(p, ' ') AS joined FROM parts JOIN taken USING (query_id)),
  scored AS (SELECT query_id, cid, rank, source_path, whole, CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0 ELSE round(len(list_intersect(q, p)) / len(list_distinct(q)) + {_bonus(4)} + {_bonus(3)} + {_bonus(2)}, 9) END AS score FROM pool)"""


def _asked(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return t.candidates.select("query_id", "cid", "rank", "source_path", "text").join(items, "query_id")


@query(f"WITH {_POOL} SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) AS rank, score AS lexical_score FROM scored")
def lexical_rerank_texts(t: Tables) -> DataFrame:
    """Whole documents by how well their words match a benchmark item's."""
    return fusion.lexical_rerank(_asked(t)).select("query_id", "cid", "rank", "lexical_score")


@query(f"""WITH {_POOL},
  once AS (SELECT *, row_number() OVER (PARTITION BY query_id, whole ORDER BY rank) AS n FROM scored WHERE whole <> ''),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM once WHERE n = 1),
  capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY r) AS m FROM best WHERE r <= 36)
SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS rank FROM capped WHERE m <= 2""")
def local_rerank_texts(t: Tables) -> DataFrame:
    """Repeated documents go, lexical scores decide, two a file stay."""
    return fusion.local_rerank(_asked(t)).select("query_id", "cid", "rank")


@query("SELECT vec_id, label, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM {embeddings}")
def joined_vectors(t: Tables) -> DataFrame:
    """Vectors of even and of odd ids stored apart, put together by key with their labels."""
    kind = dict(t.embeddings.dtypes)["embedding"]
    old = t.embeddings.select("vec_id", "label", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("embedding"))
    late = t.embeddings.where("vec_id % 2 = 1").select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    out = mutations.update_columns(old, late, "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("""WITH ends AS (SELECT string_split(min(url), '/') AS a, string_split(max(url), '/') AS b FROM {pages}),
  places AS (SELECT i, a[i] = b[i] AS same FROM ends, range(1, 50) r(i) WHERE i <= len(a)),
  cut AS (SELECT coalesce(min(i) FILTER (same IS NULL OR NOT same), 1000) AS k FROM places)
SELECT array_to_string(a[1:k - 1], '/') AS folder FROM ends, cut""")
def common_folder_of_pages(t: Tables) -> DataFrame:
    return graph.common_folder(t.pages, "url")


@query("""WITH turns AS (SELECT conv_id, turn, length(text) AS n FROM {conversations}),
  spans AS (SELECT conv_id, CAST(row_number() OVER w AS INT) AS page, sum(n) OVER w - n AS s, sum(n) OVER w AS e FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  asked AS (SELECT conv_id, turn, turn * 131 % 1500 AS place FROM turns)
SELECT conv_id, turn, coalesce((SELECT min(page) FROM spans x WHERE x.conv_id = a.conv_id AND s <= place AND place < e), (SELECT max(page) FROM spans x WHERE x.conv_id = a.conv_id)) AS page FROM asked a""")
def pages_of_talks(t: Tables) -> DataFrame:
    """The turn of a conversation that holds an offset of its joined texts, else the last one."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("xs"))  # the turns of one talk
    kind = "struct<start:int,end:int,page:int>"
    reached = lambda a: F.element_at(a, -1)["end"]
    span = lambda a, x: F.concat(a, F.array(F.struct(reached(a), reached(a) + x["n"], F.size(a)).cast(kind)))
    first = F.array(F.struct(F.lit(0), F.lit(0), F.lit(0)).cast(kind))
    spans = F.aggregate("xs", first, span, lambda a: F.slice(a, F.lit(2), F.size(a)))
    return turns.select("conv_id", spans.alias("spans"), F.explode("xs.turn").alias("turn")).select("conv_id", "turn", text.page_at(F.col("spans"), F.col("turn") * 131 % 1500).alias("page"))


@query("""SELECT doc_id, doc_id % 3 <> 2 AS latin, CAST(CASE doc_id % 3 WHEN 0 THEN strlen(text) + 1 WHEN 1 THEN 2 * strlen(text) + 3 ELSE length(text) END AS BIGINT) AS n FROM {documents}""")
def decoded_bytes(t: Tables) -> DataFrame:
    """Texts whose last sequence is cut, texts with a byte in the middle that is never UTF-8, and sound ones."""
    raw, d = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    content = F.when(d == 0, F.concat(raw, F.unhex(F.lit("C3")))).when(d == 1, F.concat(raw, F.unhex(F.lit("FFC3A9")), raw)).otherwise(raw)
    out = files.decode_text(t.documents.select("doc_id", content.alias("content")))
    return out.select("doc_id", (F.col("doc_id") % 3 != 2).alias("latin"), F.length("text").cast("long").alias("n"))


@query("""SELECT query_id || '/' || cid AS pair, CASE WHEN rank % 4 = 0 THEN 5.0 ELSE CAST(length(text) AS DOUBLE) END AS score FROM {candidates}""")
def stored_scores(t: Tables) -> DataFrame:
    """A cache of a quarter of the scores after a rerank of all candidates: what was new is kept beside it."""
    pool = t.candidates.select("query_id", "cid", "rank", F.concat_ws("/", F.col("query_id").cast("string"), "cid").alias("pair"), F.col("query_id").cast("string").alias("query"), "text")
    key = text.rerank_key(F.col("query"), F.col("cid").cast("string"), F.lit("model"))
    cache = pool.where("rank % 4 = 0").select(key.alias("cache_key"), F.lit(5.0).alias("score"))
    _, fresh = fusion.cross_rerank(pool, lambda queries, texts: [float(len(x)) for x in texts], cache)
    return pool.select("pair", key.alias("cache_key")).join(fusion.store_scores(cache, fresh), "cache_key").select("pair", "score")


@query("""SELECT source_path, count(*) AS n, CAST(count(*) FILTER (coalesce(node_type, '') IN ('', 'chunk')) AS BIGINT) AS plain FROM {chunks} GROUP BY source_path""")
def enriched_files(t: Tables) -> DataFrame:
    """Stages by name: node types alone."""
    out, done = maintenance.enrich(t.chunks, only=["node_type"])
    return out.where(F.lit(done == ["node_type"])).groupBy("source_path").agg(F.count("*").alias("n"), F.count(F.when(F.col("node_type") == "chunk", 1)).alias("plain"))


_HYBRID = f"""
  corpus AS (SELECT c.chunk_id AS cid, c.text, c.source_path, e.embedding FROM {{chunks}} c JOIN {{embeddings}} e ON e.vec_id = c.doc_id % (SELECT count(*) FROM {{embeddings}}) WHERE coalesce(c.is_current, true)),
  asked AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding, {_tokens('b.text')} AS q FROM {{benchmark}} b JOIN {{embeddings}} e ON e.vec_id = b.item_id),
  near AS (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS rank FROM (
    SELECT a.query_id, c.cid, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS d FROM asked a, corpus c)),
  words AS (SELECT cid, source_path, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS whole, {_tokens('text')} AS p FROM corpus WHERE cid IN (SELECT cid FROM near WHERE rank <= 100)),
  pool AS (SELECT n.query_id, n.cid, n.rank, w.source_path, w.whole, a.q, w.p, array_to_string(w.p, ' ') AS joined FROM near n JOIN words w USING (cid) JOIN asked a USING (query_id) WHERE n.rank <= 100),
  scored AS (SELECT query_id, cid, rank, source_path, whole, CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0 ELSE round(len(list_intersect(q, p)) / len(list_distinct(q)) + {_bonus(4)} + {_bonus(3)} + {_bonus(2)}, 9) END AS score FROM pool),
  once AS (SELECT *, row_number() OVER (PARTITION BY query_id, whole ORDER BY rank) AS n FROM scored WHERE whole <> ''),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM once WHERE n = 1),
  capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY r) AS m FROM best WHERE r <= 36),
  dense AS (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY r) AS dense_rank FROM capped WHERE m <= 2),
  tokens AS (SELECT cid, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM corpus),
  totals AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean FROM tokens),
  terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked),
  post AS (SELECT cid, len(ts) AS length, term, count(*) AS tf FROM (SELECT cid, ts, unnest(ts) AS term FROM tokens) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  held AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  text_scored AS (SELECT query_id, cid, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM post JOIN held USING (term) JOIN terms USING (term), totals GROUP BY query_id, cid),
  sparse AS (SELECT query_id, cid, sparse_rank FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS sparse_rank FROM text_scored) WHERE sparse_rank <= 100),
  both_lists AS (SELECT query_id, cid, dense_rank, sparse_rank FROM dense FULL JOIN sparse USING (query_id, cid)),
  sizes AS (SELECT query_id, count(dense_rank) + 1 AS nd, count(sparse_rank) + 1 AS ns FROM both_lists GROUP BY query_id),
  fused AS (SELECT x.*, round(0.7 / (60 + coalesce(dense_rank, nd)) + 0.3 / (60 + coalesce(sparse_rank, ns)), 9) AS fused_score FROM both_lists x JOIN sizes USING (query_id))"""


@query(f"""WITH {_HYBRID}
SELECT query_id, cid, CAST(rank AS INT) AS rank FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM fused) WHERE rank <= 10""")
def hybrid_ranking(t: Tables) -> DataFrame:
    """The default profile end to end without near-duplicate removal, which hybrid_pipeline has besides."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return pipeline.Pipeline(corpus_chunks(t), pipeline.Config(k=10, dedup_threshold=None)).retrieve(asked).select("query_id", "cid", "rank")


def _profile_sql(vector: str, order: str, most: int = 36) -> str:
    """Ranks of a profile over the vectors as chunks: search by ``vector`` of query q, two a file, then ``order``."""
    return f"""WITH b AS (SELECT q.vec_id AS query_id, e.vec_id AS v, 'v' || CAST(e.vec_id AS STRING) AS cid, 's' || CAST(e.vec_id % 40 AS STRING) AS p,
    round(1 - list_cosine_similarity({vector}, CAST(e.embedding AS DOUBLE[])), 9) AS d FROM {{embeddings}} q, {{embeddings}} e WHERE q.vec_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS r FROM b), t AS (SELECT * FROM k WHERE r <= {most}), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY r) AS m FROM t),
  l AS (SELECT query_id, v, cid, row_number() OVER (PARTITION BY query_id ORDER BY r) AS was FROM c WHERE m <= 2)
SELECT query_id, cid, CAST(rank AS INT) AS rank FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM l) WHERE rank <= 10"""


def _profile(t: Tables, name: str, models: pipeline.Models) -> DataFrame:
    v = F.col("vec_id")
    rows = t.embeddings.select(F.concat(F.lit("v"), v).alias("chunk_id"), F.concat(F.lit("t"), v).alias("text"), F.concat(F.lit("s"), v % 40).alias("source_path"), F.lit(True).alias("is_current"), "embedding")
    queries = t.embeddings.where("vec_id % 20 = 0").select(v.alias("query_id"), F.lit("absent").alias("query"), "embedding")
    return pipeline.Pipeline(rows, pipeline.Config(name, k=10, dedup_threshold=None), models).retrieve(queries).select("query_id", "cid", "rank")


_OWN = "CAST(q.embedding AS DOUBLE[])"


@query(_profile_sql(_OWN, "v % 13 DESC, was"))
def cross_rerank_profile(t: Tables) -> DataFrame:
    """Dense candidates in the order of an injected pair scorer, equal scores as they were."""
    return _profile(t, "dense_cross_rerank", pipeline.Models(cross_score=lambda queries, texts: [float(int(x[1:]) % 13) for x in texts]))


@query(_profile_sql(_OWN, "CASE was WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 7 THEN 3 ELSE 3 + was END"))
def model_ranked_profile(t: Tables) -> DataFrame:
    """An injected model names three candidates by their places, one twice and one that is not there; the rest follow."""
    named = lambda local: local.select("query_id").distinct().withColumn("indices", F.lit([3, 1, 3, 99, 6]))
    return _profile(t, "llm_rerank", pipeline.Models(rank=named))


@query(_profile_sql("list_transform(list_zip(q.embedding, (SELECT h.embedding FROM {embeddings} h WHERE h.vec_id = q.vec_id + 1)), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2)", "was"))
def hypothetical_profile(t: Tables) -> DataFrame:
    """The query's vector and that of an injected hypothetical document, pooled."""
    made = t.embeddings.select((F.col("vec_id") - 1).alias("query_id"), "embedding")
    return _profile(t, "hyde_hybrid", pipeline.Models(hypothetical=lambda queries: made.join(queries.select("query_id"), "query_id", "left_semi")))


@query("""SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT source, CAST(doc_id % 4 AS INT) AS part, sum(strlen(replace(replace(text, chr(10), ' '), chr(13), ' ')) + 1) AS n FROM {documents} WHERE doc_id % 4 <> 3 GROUP BY ALL) GROUP BY source""")
def scanned_files(t: Tables) -> DataFrame:
    """Documents written as text files in nested folders, one of which is left out of the scan."""
    folder = fresh_path(t.spark, "scan")
    line = F.regexp_replace("text", "[\n\r]", " ")
    rows = t.documents.select("source", (F.col("doc_id") % 4).cast("int").alias("part"), line.alias("value"))
    rows.repartition(8, "source", "part").write.partitionBy("source", "part").text(folder)
    found = files.scan_files(t.spark, [folder], extensions=(".txt",), exclude_dirs=("part=3",))
    each = found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "size")
    return each.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
