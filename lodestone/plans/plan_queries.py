"""Registered queries of local plans, task graphs, schedules and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_path_of
from ..operators import density, schedule, task_graph
from .local_plan import LocalPolicy, conditioned_knn, prepare_local
from .registry import Tables, query

_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN source || '/' || lang WHEN 2 THEN regexp_replace(substr(text, 1, 20), '^\s+|\s+$', '', 'g') WHEN 3 THEN '' ELSE source || '/7' END AS path FROM {documents}""")
def heading_paths(t: Tables) -> DataFrame:
    """Heading paths as they are stored: nothing, JSON lists with blanks, plain text, broken JSON."""
    d = F.col("doc_id") % 5
    plain = F.substring("text", 1, 20)
    raw = F.when(d == 1, F.concat(F.lit('["'), "source", F.lit('", " ", "'), "lang", F.lit('"]'))).when(d == 2, plain).when(d == 3, F.lit("[]")).when(d == 4, F.concat(F.lit(' ["'), "source", F.lit('", 7, ""] ')))
    return t.documents.select("doc_id", F.array_join(heading_path_of(raw), "/").alias("path"))


_ROWS = "rows AS (SELECT 'v' || vec_id AS cid, vec_id AS v, embedding, 's' || (vec_id % 40) AS source_path, CASE vec_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' END AS ext FROM {embeddings})"


def _vector_chunks(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    ext = F.when(v % 3 == 0, F.lit(".md")).when(v % 3 == 1, F.lit(".TXT"))
    return t.embeddings.select(F.concat(F.lit("v"), v).alias("chunk_id"), F.concat(F.lit("t"), v).alias("text"), F.concat(F.lit("s"), v % 40).alias("source_path"), ext.alias("ext"), (v % 7 != 0).alias("is_current"), "embedding", F.col("label").cast("string").alias("lang"))


@query(f"""WITH {_ROWS},
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cid) AS rank FROM (SELECT q.query_id, e.cid, e.v, e.source_path, e.ext, round(1 - {_COSINE}, 9) AS distance FROM {{vector_queries}} q, rows e WHERE e.v % 7 <> 0)),
  kept AS (SELECT query_id, cid, source_path, 1 AS p, rank FROM near WHERE rank <= 30 AND (ext IS NULL OR lower(ext) <> '.txt')),
  pins AS (SELECT query_id, r.cid, source_path, 0 AS p, 1 AS rank FROM {{vector_queries}} JOIN rows r ON r.v = query_id + 1),
  fore AS (SELECT query_id, r.cid, source_path, 0 AS p, 1 AS rank FROM {{vector_queries}} JOIN rows r ON r.v = query_id + 2),
  pinned AS (SELECT query_id, cid, source_path, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank FROM (SELECT * FROM kept UNION ALL SELECT * FROM pins x WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.query_id = x.query_id AND k.cid = x.cid))),
  anchored AS (SELECT query_id, cid, source_path, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank FROM (SELECT * FROM fore UNION ALL SELECT query_id, cid, source_path, 1, rank FROM pinned x WHERE NOT EXISTS (SELECT 1 FROM fore f WHERE f.query_id = x.query_id AND f.cid = x.cid))),
  capped AS (SELECT query_id, cid, source_path, 1 AS p, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY rank) AS n FROM anchored WHERE rank <= 10) WHERE n <= 2)
SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS INT) AS rank FROM (SELECT * FROM fore UNION ALL SELECT * FROM capped x WHERE NOT EXISTS (SELECT 1 FROM fore f WHERE f.query_id = x.query_id AND f.cid = x.cid))""")
def local_plan(t: Tables) -> DataFrame:
    """Search, extension filter, a pinned chunk and an anchor a query, caps; no chunk's text has the question's word."""
    queries = t.vector_queries.withColumn("query", F.lit("absent"))
    stated = lambda n: queries.select("query_id", F.concat(F.lit("v"), F.col("query_id") + n).alias("cid"))
    plan = prepare_local(_vector_chunks(t), queries, LocalPolicy(k=10, ext_deny=[".txt"]), pinned=stated(1), anchors=stated(2))
    return plan.filtered.select("query_id", "cid", "rank")


@query(f"""SELECT query_id, cid, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cid) AS rank FROM (
  SELECT q.query_id, 'v' || e.vec_id AS cid, round(1 - {_COSINE}, 9) AS distance FROM {{vector_queries}} q, {{embeddings}} e
  WHERE e.label = q.query_id % 7 AND (q.query_id % 40 <> 0 OR e.vec_id % 3 = 0))) WHERE rank <= 8""")
def conditioned_search(t: Tables) -> DataFrame:
    """Each query among the rows that meet its own conditions."""
    label = t.vector_queries.select("query_id", F.lit("lang").alias("field"), (F.col("query_id") % 7).cast("string").alias("value"))
    ext = t.vector_queries.where("query_id % 40 = 0").select("query_id", F.lit("ext").alias("field"), F.lit(".md").alias("value"))
    return conditioned_knn(_vector_chunks(t), t.vector_queries, label.unionByName(ext), 8).select("query_id", "cid", "rank")


def _tasks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts as tasks: each waits for the part of half its number, some for a third of it, and some for one just before."""
    k = F.col("p_partkey")
    tasks = t.part.select(k.alias("task_id"), k.alias("position"), F.when(k % 4 != 0, F.concat(F.lit("g"), F.floor(F.log2(k)).cast("string"), F.lit("_"), (k % 4).cast("string"))).alias("parallel_group"))
    on = F.array(F.floor(k / 2), F.when(k % 3 == 0, F.floor(k / 3)), F.when(k % 100 == 1, k - 1))
    deps = t.part.select(k.alias("task_id"), F.explode(F.array_compact(on)).alias("depends_on")).where("depends_on > 0")
    return tasks, deps


_DEPS = "deps AS (SELECT p_partkey AS task_id, p_partkey // 2 AS depends_on FROM {part} WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey > 2 UNION SELECT p_partkey, p_partkey - 1 FROM {part} WHERE p_partkey % 100 = 1 AND p_partkey > 1)"


@query(f"""WITH RECURSIVE {_DEPS},
  reached(task_id, level) AS (SELECT p_partkey, 0 FROM {{part}} UNION SELECT d.task_id, r.level + 1 FROM reached r JOIN deps d ON d.depends_on = r.task_id)
SELECT task_id, CAST(max(level) AS INT) AS level FROM reached GROUP BY task_id""")
def task_levels(t: Tables) -> DataFrame:
    return task_graph.topological_order(*_tasks(t)).select("task_id", "level")


@query(f"""WITH {_DEPS}, named AS (SELECT p_partkey AS task_id, CASE WHEN p_partkey % 4 <> 0 THEN 'g' || CAST(floor(log2(p_partkey)) AS INT) || '_' || (p_partkey % 4) ELSE 'group_' || p_partkey END AS group_id FROM {{part}}),
  own AS (SELECT group_id, min(task_id) AS p, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_id) AS tasks FROM named GROUP BY group_id),
  between_groups AS (SELECT DISTINCT a.group_id, b.group_id AS other FROM deps JOIN named a USING (task_id) JOIN named b ON b.task_id = deps.depends_on WHERE a.group_id <> b.group_id)
SELECT own.group_id, own.tasks, coalesce((SELECT string_agg(x.other, ',' ORDER BY o.p) FROM between_groups x JOIN own o ON o.group_id = x.other WHERE x.group_id = own.group_id), '') AS depends_on FROM own""")
def task_groups(t: Tables) -> DataFrame:
    found = task_graph.parallel_groups(*_tasks(t))
    return found.select("group_id", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks"), F.array_join("depends_on", ",").alias("depends_on"))


@query("""WITH e AS (SELECT event_id, ts, date_trunc('second', ts) AS s, date_trunc('minute', ts) AS m, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d, event_id % 10 AS k FROM {events})
SELECT event_id, CASE k WHEN 0 THEN ts + INTERVAL 1 HOUR WHEN 1 THEN ts + INTERVAL 1 DAY WHEN 2 THEN ts + INTERVAL 7 DAY WHEN 3 THEN ts + INTERVAL 90 SECOND
  WHEN 4 THEN h + to_minutes((floor(date_part('minute', m) / 15) * 15 + 15)::INT)
  WHEN 5 THEN CASE WHEN d + INTERVAL 195 MINUTE > m THEN d + INTERVAL 195 MINUTE ELSE d + INTERVAL 1635 MINUTE END
  WHEN 6 THEN (SELECT min(x) FROM (SELECT d + to_days(i::INT) + INTERVAL 270 MINUTE AS x FROM range(0, 9) r(i)) WHERE x > m AND date_part('dow', x) IN (1, 5))
  WHEN 7 THEN (SELECT min(x) FROM (SELECT date_trunc('month', d) + to_months(i::INT) AS x FROM range(0, 3) r(i)) WHERE x > m)
  WHEN 8 THEN (SELECT min(x) FROM (SELECT m + to_seconds(i::INT) AS x FROM range(0, 121, 20) r(i)) WHERE x > s)
  ELSE (SELECT min(x) FROM (SELECT make_timestamp(y::INT, 2, 29, 0, 0, 0) AS x FROM range(2024, 2033, 4) r(y)) WHERE x > m) END AS next_run
FROM e""")
def next_runs(t: Tables) -> DataFrame:
    """Every event's time and the next run of one of ten schedules after it."""
    names = ["hourly", "Daily", "weekly", "90s", "*/15 * * * *", "15 3 * * *", "30 4 * * 1,5", "0 0 1 * *", "*/20 * * * * *", "0 0 29 2 *"]
    interval = F.element_at(F.lit(names), (F.col("event_id") % 10 + 1).cast("int"))
    return t.events.select("event_id", schedule.next_run(interval, F.col("ts")).alias("next_run"))


@query()
def density_clustered(t: Tables) -> DataFrame:
    """Vectors in clusters of their density, noise put to the nearest; tested against a tree over all pairs."""
    return density.density_clusters(t.embeddings, id_col="vec_id")[0]
