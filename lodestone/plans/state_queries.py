"""Registered queries of tables that change: mutations, versions, memory, caches, registries, backfills, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import evaluation, filters, fusion, graph, maintenance, memory, mutations, retrieval, stats, structure
from ..sources import files
from ..streaming import ingest as streaming
from . import pipeline
from .registry import Tables, query

_NOW = "1998-01-01 00:00:00"


def _ts(x: str):  # noqa: ANN202
    return F.lit(x).cast("timestamp")


# --- chunks ----------------------------------------------------------------------------------------------------------


@query("SELECT chunk_id FROM {chunks} WHERE doc_id % 8 <> 3")
def delete_by_id(t: Tables) -> DataFrame:
    return mutations.delete_by_id(t.chunks, t.chunks.where("doc_id % 8 = 3").select("chunk_id")).select("chunk_id")


@query("SELECT count(*) FILTER (coalesce(is_current, true)) AS deleted, CAST(0 AS BIGINT) AS left_over FROM {chunks}")
def delete_all(t: Tables) -> DataFrame:
    empty, n = mutations.delete_all(t.chunks)
    return n.crossJoin(empty.agg(F.count("*").alias("left_over")))  # one row each


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'b,new' WHEN 1 THEN 'new' ELSE 'a,new' END AS added, CASE doc_id % 3 WHEN 0 THEN 'b' ELSE '' END AS removed FROM {documents}")
def user_tags(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.select(d, F.when(d % 3 == 0, F.array(F.lit("b"))).when(d % 3 == 2, F.array(F.lit("a"))).alias("user_tags"))
    added = mutations.add_tags(rows, F.array(F.lit(" NEW "), F.lit("new"))).select("doc_id", F.array_join("user_tags", ",").alias("added"))
    removed = mutations.remove_tags(rows, F.array(F.lit("A"))).select("doc_id", F.array_join("user_tags", ",").alias("removed"))
    return added.join(removed, "doc_id")


@query("SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'x' END AS tag FROM {documents}")
def all_tags(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return stats.all_tags(t.documents.select(F.array(F.when(d % 3 == 0, F.col("lang")).when(d % 3 == 1, F.col("source")).otherwise("x")).alias("tags")), "tags")


@query("SELECT chunk_id FROM {chunks} WHERE doc_id % 3 <> 1 ORDER BY chunk_id LIMIT 100")
def untagged_chunks(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    tags = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.lit("x")))
    return filters.untagged(t.chunks.withColumn("ai_tags", tags)).select("chunk_id")


@query("SELECT chunk_id FROM (SELECT chunk_id, source_path FROM {chunks} WHERE ext = '.md' AND lang = 'en' ORDER BY chunk_id LIMIT 50) WHERE lower(source_path) LIKE '%src1%'")
def metadata_search(t: Tables) -> DataFrame:
    return filters.search_metadata(t.chunks.withColumn("author", F.col("lang")), "SRC1", "en", ".md", 50).select("chunk_id")


@query("SELECT chunk_id, coalesce(cluster_id, 0) AS cluster_id, CASE WHEN coalesce(node_type, '') = '' THEN 'chunk' ELSE node_type END AS node_type, coalesce(is_current, true) AS is_current, ext FROM {chunks}")
def normalized_metadata(t: Tables) -> DataFrame:
    return filters.normalized_metadata(t.chunks).select("chunk_id", "cluster_id", "node_type", "is_current", "ext")


@query("SELECT c.chunk_id, e.vec_id FROM {chunks} c JOIN {embeddings} e ON c.doc_id = e.vec_id WHERE coalesce(is_current, true)")
def stored_embeddings(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), F.struct("embedding", "vec_id").alias("embedding"))
    return retrieval.embeddings_of(t.chunks, vectors).select("chunk_id", "embedding.vec_id")


@query(f"""WITH w AS (SELECT doc_id, CAST(('0x' || substring(md5(w), 17, 16)) AS UBIGINT) AS h FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {{documents}})),
  s AS (SELECT doc_id, {', '.join(f"sum(((CAST(h AS HUGEINT) >> {b}) & 1) * 2 - 1) AS s{b}" for b in range(64))} FROM w GROUP BY doc_id),
  u AS (SELECT doc_id, {' + '.join(f"(CASE WHEN s{b} > 0 THEN CAST({1 << b} AS HUGEINT) ELSE 0 END)" for b in range(64))} AS v FROM s)
SELECT chunk_id, CASE WHEN simhash IS NULL AND coalesce(is_current, true) THEN CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) ELSE simhash END AS simhash FROM {{chunks}} LEFT JOIN u USING (doc_id)""")
def backfill_simhash(t: Tables) -> DataFrame:
    return maintenance.backfill_simhash(t.chunks).select("chunk_id", "simhash")


@query("""SELECT chunk_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 5 ELSE strpos('xx' || text, substring(text, 1, 100)) - 1 END AS INT) AS start_char,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 9 ELSE strpos('xx' || text, substring(text, 1, 100)) - 1 + length(text) END AS INT) AS end_char FROM {chunks}""")
def backfill_positions(t: Tables) -> DataFrame:
    known = lambda x: F.when(F.col("doc_id") % 2 == 0, F.lit(x))
    rows = t.chunks.withColumn("source_path", F.col("chunk_id")).withColumn("start_char", known(5)).withColumn("end_char", known(9))
    texts = t.chunks.select(F.col("chunk_id").alias("source_path"), F.concat(F.lit("xx"), "text").alias("text"))
    return maintenance.backfill_positions(rows, texts).select("chunk_id", "start_char", "end_char")


@query("""SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN source_path LIKE '/src1%' THEN 'one' WHEN source_path LIKE '/src%' THEN 'any' END AS root_tags, CASE WHEN source_path LIKE '/src1%' THEN 'paper' WHEN source_path LIKE '/src%' THEN 'note' END AS content_type FROM {chunks}""")
def backfill_tags(t: Tables) -> DataFrame:
    rows = t.chunks.withColumn("root_tags", F.when(F.col("doc_id") % 5 == 0, "own")).withColumn("content_type", F.lit(None).cast("string"))
    return maintenance.backfill_tags(rows, _roots(t)).select("chunk_id", "root_tags", "content_type")


def _roots(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("/src1", 1, "one", "paper"), ("/src", 2, "any", "note")], "root string, position int, tags string, content_type string")


@query("SELECT DISTINCT source_path FROM {chunks} WHERE coalesce(is_current, true) AND doc_id % 9 <> 0 AND source_path LIKE '/src1%'")
def metadata_missing(t: Tables) -> DataFrame:
    one = F.col("source_path").like("/src1%") & (F.col("doc_id") % 9 != 0)
    rows = t.chunks.withColumn("root_tags", F.when(F.col("source_path").like("/src1%"), F.when(~one, "one")).otherwise("any")).withColumn("content_type", F.when(F.col("source_path").like("/src1%"), "paper").otherwise("note"))
    return maintenance.metadata_missing(rows, _roots(t))


@query("""WITH c AS (SELECT * FROM {chunks} WHERE coalesce(is_current, true))
SELECT 'no file_summary' AS gap, count(DISTINCT source_path) AS files FROM c WHERE coalesce(node_type, 'chunk') = 'chunk' AND source_path NOT IN (SELECT source_path FROM c WHERE node_type = 'file_summary') HAVING count(*) > 0
UNION ALL SELECT 'no section_summary', count(DISTINCT source_path) FROM c WHERE coalesce(node_type, 'chunk') = 'chunk' AND source_path NOT IN (SELECT source_path FROM c WHERE node_type = 'section_summary') HAVING count(*) > 0
UNION ALL SELECT 'no simhash', count(DISTINCT source_path) FROM c WHERE simhash IS NULL HAVING count(*) > 0 UNION ALL SELECT 'no cluster_id', count(DISTINCT source_path) FROM c WHERE cluster_id IS NULL HAVING count(*) > 0""")
def gap_report(t: Tables) -> DataFrame:
    return maintenance.gap_report(t.chunks)


@query("SELECT chunk_id, version, coalesce(is_current, true) AS is_current, CASE WHEN coalesce(node_type, '') = '' THEN 'chunk' ELSE node_type END AS node_type, CASE WHEN source_path LIKE '/src1%' THEN 'one' WHEN source_path LIKE '/src%' THEN 'any' END AS root_tags FROM {chunks}")
def enriched_chunks(t: Tables) -> DataFrame:
    rows = t.chunks.withColumn("root_tags", F.lit(None).cast("string")).withColumn("content_type", F.lit(None).cast("string"))
    return maintenance.enrich(rows, roots=_roots(t), skip=["simhash"])[0].select("chunk_id", "version", "is_current", "node_type", "root_tags")


# --- manifests, versions, registries ---------------------------------------------------------------------------------


@query("SELECT '/m/' || c_custkey AS source_path, CASE WHEN o IS NULL THEN CAST(c_custkey % 20 AS BIGINT) ELSE n END AS size FROM {customer} LEFT JOIN (SELECT o_custkey AS o, count(*) AS n FROM {orders} GROUP BY o_custkey) ON c_custkey = o")
def manifest_copied(t: Tables) -> DataFrame:
    target = t.listing.select("source_path", F.col("size").cast("long").alias("size"))
    known = t.manifest.join(target, "source_path", "left_semi")
    return mutations.copy_table(target, known, "source_path", ("source_path", "size"))


@query("SELECT ext FROM (VALUES ('.md'), ('.txt'), ('.pdf')) x(ext) WHERE ext NOT IN (SELECT DISTINCT ext FROM {chunks} WHERE ext IS NOT NULL)")
def new_extensions(t: Tables) -> DataFrame:
    manifest = t.chunks.select(F.concat("source_path", F.lit("/file"), F.upper(F.coalesce("ext", F.lit("")))).alias("source_path"))
    return maintenance.new_extensions(t.spark.createDataFrame([(".md",), (".txt",), (".pdf",)], "ext string"), manifest)


_CONFIG = {"embedding_model": "m2", "embedding_dim": 384, "chunk_size": 1800, "chunk_overlap": 200, "chunking_strategy": "structure", "schema_version": 3}


def _history(t: Tables) -> DataFrame:
    row = F.col("o_orderkey")
    return t.orders.select(row.alias("id"), F.when(row % 2 == 0, "m1").otherwise("m2").alias("embedding_model"), F.lit("384").alias("embedding_dim"), (row % 3).cast("string").alias("chunk_size"), F.lit("200").alias("chunk_overlap"), F.lit(None).cast("string").alias("chunking_strategy"), F.lit("3").alias("schema_version"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("""WITH l AS (SELECT max(o_orderkey) AS k FROM {orders})
SELECT 'embedding_model' AS field, 'm1' AS recorded, 'm2' AS configured FROM l WHERE k % 2 = 0 UNION ALL SELECT 'chunk_size', CAST(k % 3 AS STRING), '1800' FROM l UNION ALL SELECT 'chunking_strategy', NULL, 'structure' FROM l""")
def fingerprint_changes(t: Tables) -> DataFrame:
    return maintenance.fingerprint_changes(_history(t), _CONFIG)


@query("SELECT max(o_orderkey) + 1 AS id, 'm2' AS embedding_model, '1800' AS chunk_size, CAST(0 AS BIGINT) AS changes FROM {orders}")
def recorded_version(t: Tables) -> DataFrame:
    after = maintenance.record_version(_history(t), _CONFIG, _ts(_NOW))
    changes = maintenance.fingerprint_changes(after, _CONFIG).agg(F.count("*").alias("changes"))
    return after.orderBy(F.desc("id")).limit(1).select("id", "embedding_model", "chunk_size").crossJoin(changes)  # one row each


@query("SELECT CASE WHEN max(o_orderkey) % 2 = 0 THEN 'embedding_upgrade' ELSE 'chunk_boundary_update' END AS mode FROM {orders}")
def completion_mode(t: Tables) -> DataFrame:
    changed = [r["field"] for r in maintenance.fingerprint_changes(_history(t), _CONFIG).collect()]  # at most six fields
    return t.spark.createDataFrame([(maintenance.completion_mode(changed, True, True),)], "mode string")


@query("SELECT s_name AS job_name, CASE WHEN s_suppkey = 3 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN s_suppkey = 3 THEN 77 ELSE s_suppkey END AS corpus_size, (CASE WHEN s_suppkey = 3 THEN 1000 > 1.2 * 77 ELSE 1000 > 1.2 * s_suppkey END) AS advise FROM {supplier}")
def job_ledger(t: Tables) -> DataFrame:
    jobs = t.supplier.select(F.col("s_name").alias("job_name"), F.lit("failed").alias("status"), F.col("s_suppkey").cast("long").alias("corpus_size"), F.lit(None).cast("timestamp").alias("finished_at"))
    name = t.supplier.where("s_suppkey = 3").first()["s_name"]
    after = maintenance.record_job(jobs, name, _ts(_NOW), corpus_size=77)
    return after.select("job_name", "status", "corpus_size", maintenance.cluster_advice(F.lit(1000), F.col("corpus_size")).alias("advise"))


@query("SELECT s_suppkey AS model_id, CAST(row_number() OVER (ORDER BY s_suppkey % 7 DESC, s_suppkey) AS INT) AS position FROM {supplier} WHERE s_suppkey <> 5")
def listed_models(t: Tables) -> DataFrame:
    models = t.supplier.select(F.col("s_suppkey").alias("model_id"), (F.col("s_suppkey") % 7).alias("created_at"))
    return maintenance.list_models(maintenance.delete_model(models, 5)).select("model_id", "position")


@query("SELECT s_suppkey AS cache_key, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS value, s_suppkey % 2 = 0 AS lives FROM {supplier}")
def saved_cache(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").alias("cache_key")
    old = t.supplier.select(k, F.lit("old").alias("value"), _ts("1997-01-01").alias("saved_at"), _ts("1997-01-02").alias("expires_at"))
    after = maintenance.save_cached(old, t.supplier.where("s_suppkey % 2 = 0").select(k, F.lit("new").alias("value")), _ts(_NOW), 3600)
    live = maintenance.live(after, _ts("1998-01-01 00:30:00")).select("cache_key", F.lit(True).alias("lives"))
    return after.join(live, "cache_key", "left").select("cache_key", "value", F.coalesce("lives", F.lit(False)).alias("lives"))


@query("SELECT coalesce(e.name, a.name) AS table_name, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual, coalesce(e.n, 0) = coalesce(a.n, 0) AS ok FROM (SELECT lang AS name, count(*) AS n FROM {documents} GROUP BY lang) e FULL JOIN (SELECT lang AS name, count(*) AS n FROM {documents} WHERE lang <> 'de' AND (lang <> 'fr' OR doc_id % 2 = 0) GROUP BY lang) a ON e.name = a.name")
def count_differences(t: Tables) -> DataFrame:
    n = lambda df: df.groupBy(F.col("lang").alias("table_name")).agg(F.count("*").alias("rows"))
    return stats.count_differences(n(t.documents), n(t.documents.where("lang != 'de' AND (lang != 'fr' OR doc_id % 2 = 0)")))


@query("SELECT o_orderkey, o_custkey % 3 <> 0 OR o_orderdate < DATE '1997-12-31' AS stale FROM {orders}")
def stale_statistics(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", stats.is_stale(F.col("o_custkey") % 3, F.lit(0), F.col("o_orderdate").cast("timestamp"), _ts(_NOW), 86400).alias("stale"))


@query("SELECT (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'F') AS failed_documents, (SELECT count(*) FROM {lineitem}) AS page_errors, (SELECT string_agg(p, ',' ORDER BY o_orderkey) FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey ELSE 'unknown' END AS p FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5)) AS sample")
def error_summary(t: Tables) -> DataFrame:
    path = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("c"), "o_custkey"))
    failed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("position"), path.alias("source_path"))
    return stats.error_summary(failed, t.lineitem).withColumn("sample", F.array_join("sample", ","))


@query("SELECT s, count(*) AS evidence, string_agg(DISTINCT p, ',' ORDER BY p) AS nodes FROM (SELECT 's' || l_suppkey AS s, 'p' || lpad(CAST(l_partkey AS STRING), 9, '0') AS p FROM {lineitem}) GROUP BY s".replace("SELECT s, count", "SELECT s AS source_path, count"))
def source_map(t: Tables) -> DataFrame:
    node = F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    rows = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source_path"), node.alias("node_id"), node.alias("rank"))
    return stats.evidence_per_source(rows).select("source_path", "evidence", F.array_join("nodes", ",").alias("nodes"))


# --- memory ----------------------------------------------------------------------------------------------------------


@query("SELECT candidate_id, CASE WHEN candidate_id % 10 = 0 THEN 'promoted' WHEN candidate_id % 10 = 4 THEN 'rejected' ELSE status END AS status FROM {memory_candidates}")
def decided_candidates(t: Tables) -> DataFrame:
    c = t.memory_candidates
    promoted = memory.set_status(c, c.where("candidate_id % 10 = 0"), "promoted")
    return memory.set_status(promoted, c.where("candidate_id % 10 = 4"), "rejected").select("candidate_id", "status")


@query("SELECT c.candidate_id, CASE WHEN m.expires_at <= TIMESTAMP '1995-01-01' AND c.status <> 'rejected' THEN 'expired' ELSE c.status END AS status FROM {memory_candidates} c JOIN {memories} m ON c.memory_id = m.memory_id")
def expired_candidates(t: Tables) -> DataFrame:
    return memory.expire(t.memories, t.memory_candidates, _ts("1995-01-01")).select("candidate_id", "status")


@query("SELECT memory_id, CASE WHEN memory_id % 6 = 0 THEN TIMESTAMP '1998-01-01' ELSE CAST(last_used_at AS TIMESTAMP) END AS last_used_at FROM {memories}")
def used_memories(t: Tables) -> DataFrame:
    m = t.memories.withColumn("last_used_at", F.col("last_used_at").cast("timestamp"))
    return memory.mark_used(m, m.where("memory_id % 6 = 0"), _ts(_NOW)).select("memory_id", "last_used_at")


@query("SELECT memory_id, CASE WHEN pinned THEN NULL ELSE least(coalesce(CAST(expires_at AS TIMESTAMP), TIMESTAMP '1998-01-31'), TIMESTAMP '1998-01-31') END AS expires_at, memory_id % 4 = 0 AS tagged FROM {memories}")
def capped_memories(t: Tables) -> DataFrame:
    tags = F.when(F.col("memory_id") % 4 == 0, F.array(F.lit("B"), F.lit("a"), F.lit("c"))).when(F.col("memory_id") % 4 == 1, F.array(F.lit("a")))
    return t.memories.select("memory_id", memory.capped_expiry(F.col("expires_at").cast("timestamp"), F.col("pinned"), _ts(_NOW), 30).alias("expires_at"), memory.has_all_tags(tags, F.array(F.lit("A"), F.lit("b"))).alias("tagged"))


@query("""SELECT m.memory_id, 'pending' AS status, CASE WHEN m.type = 'F' THEN least(coalesce(CAST(m.expires_at AS TIMESTAMP), TIMESTAMP '1998-01-08'), TIMESTAMP '1998-01-08') ELSE CAST(m.expires_at AS TIMESTAMP) END AS expires_at FROM {memories} m WHERE memory_id % 3 = 0""")
def new_candidates(t: Tables) -> DataFrame:
    m = t.memories.withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    new = m.where("memory_id % 3 = 0").withColumns({"candidate_id": F.col("memory_id"), "provenance": F.lit(" run "), "rationale": F.lit("why")})
    empty = t.spark.createDataFrame([], "candidate_id long, memory_id long, provenance string, rationale string, status string, created_at timestamp")
    memories, candidates = memory.put_candidates(m.limit(0), empty, new, _ts(_NOW), {"F": 7})
    return candidates.where("provenance = 'run'").join(memories, "memory_id").select("memory_id", "status", "expires_at")


@query("SELECT memory_id, CAST(greatest(1, (length('{{\"type\":\"' || type || '\",\"scope\":\"' || scope || '\"}}')) // 4) AS BIGINT) AS cost FROM {memories}")
def memory_costs(t: Tables) -> DataFrame:
    return t.memories.select("memory_id", memory.token_cost(F.col("type"), F.col("scope")).alias("cost"))


# --- graph, evaluation, ingest, pipeline -----------------------------------------------------------------------------


@query("SELECT src_id, dst_id, weight FROM (SELECT src_id, dst_id, 1.0 AS weight FROM {edges} UNION ALL SELECT src_id, dst_id, 2.0 FROM {edges} WHERE edge_type = 'cites')".replace("1.0 AS", "CAST(1 AS DOUBLE) AS").replace("2.0 FROM", "CAST(2 AS DOUBLE) FROM"))
def inserted_edges(t: Tables) -> DataFrame:
    old = t.edges.withColumn("weight", F.lit(None).cast("double"))
    return graph.insert_edges(old, t.edges.where("edge_type = 'cites'").withColumn("weight", F.lit(2.0))).select("src_id", "dst_id", "weight")


@query("SELECT node_id, CAST(CASE node_type WHEN 'part' THEN 1 ELSE 2 END AS INT) AS depth, node_type FROM {nodes} WHERE node_type = 'part'")
def graph_outline(t: Tables) -> DataFrame:
    leveled = t.nodes.withColumn("depth", F.when(F.col("node_type") == "part", 1).otherwise(2))
    return graph.outline(leveled, 1, ["part", "other"]).select("node_id", "depth", "node_type")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_partkey, l_orderkey, l_linenumber) AS INT) AS position FROM {lineitem}")
def ordered_nodes(t: Tables) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("path"), F.col("l_quantity").alias("start_line"), F.col("l_partkey").alias("start_char"), F.col("l_orderkey").alias("end_line"), F.col("l_linenumber").alias("end_char"), F.lit(0).alias("depth"), F.lit("x").alias("node_type"), F.lit("").alias("name"), key.alias("node_id"))
    return graph.ordered_nodes(rows).select("l_orderkey", "l_linenumber", "position")


@query("""WITH d AS (SELECT doc_id, 'note-' || doc_id AS p FROM {documents}), l AS (
  SELECT p, 'd' || (doc_id + 1) AS target, 'link_target' AS kind, 'references' AS e FROM d UNION ALL SELECT p, 'sub/' || doc_id || '.md', 'link_target', 'references' FROM d
  UNION ALL SELECT p, '10.1234/abc-' || doc_id, 'doi', 'cites' FROM d WHERE doc_id % 2 = 0)
SELECT substring(sha1(p || '|file'), 1, 16) AS src_id, substring(sha1(target || '|' || kind), 1, 16) AS dst_id, e AS edge_type FROM l""")
def text_links(t: Tables) -> DataFrame:
    """Links of notes: bare DOIs, web addresses, anchors and repeats are no links."""
    d = F.col("doc_id")
    cited = F.when(d % 2 == 0, F.concat(F.lit(" DOI:10.1234/abc-"), d, F.lit(" and https://doi.org/10.1234/abc-"), d)).otherwise(F.concat(F.lit(" 10.1234/abc-"), d))
    note = F.concat(F.lit("See [[d"), d + 1, F.lit("|next]] and [[ d"), d + 1, F.lit(" ]], [file](sub/"), d, F.lit(".md), [w](https://x.org), [a](#top)"), cited, F.lit(" end"))
    return graph.extract_links(t.documents.select(F.concat(F.lit("note-"), d).alias("source_path"), note.alias("text")))[1].select("src_id", "dst_id", "edge_type")


@query("""WITH f AS (SELECT DISTINCT source_path FROM {chunks}), n AS (SELECT source_path, row_number() OVER (ORDER BY source_path) AS i FROM f),
  hop AS (SELECT a.source_path AS s, b.source_path AS d FROM n a JOIN n b ON b.i = a.i + 1), both_ways AS (SELECT s, d FROM hop UNION SELECT d, s FROM hop),
  seeds AS (SELECT 1 AS query_id, source_path FROM n WHERE i % 10 = 1), one AS (SELECT DISTINCT query_id, d AS source_path FROM seeds JOIN both_ways ON s = source_path), two AS (SELECT DISTINCT query_id, d AS source_path FROM one JOIN both_ways ON s = source_path),
  r AS (SELECT * FROM one UNION SELECT * FROM two), x AS (SELECT r.query_id, c.chunk_id AS cid, r.source_path, row_number() OVER (PARTITION BY r.source_path ORDER BY chunk_index, chunk_id) AS k FROM r JOIN {chunks} c USING (source_path) WHERE coalesce(is_current, true) AND (r.query_id, r.source_path) NOT IN (SELECT query_id, source_path FROM seeds))
SELECT query_id, cid, source_path, round(1 / (1 + row_number() OVER (ORDER BY source_path, k)), 9) AS graph_score FROM x WHERE k <= 2""")
def graph_expansion(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    paths = t.chunks.select("source_path").distinct().withColumn("i", F.row_number().over(Window.orderBy("source_path")))
    nodes = paths.select(graph.file_node_id(F.col("source_path")).alias("node_id"), F.lit("file").alias("node_type"), F.col("source_path").alias("label"), "source_path")
    next_one = paths.select(F.col("i").alias("j"), F.col("source_path").alias("d"))
    edges = paths.join(next_one, F.col("j") == F.col("i") + 1).select(graph.file_node_id(F.col("source_path")).alias("src_id"), graph.file_node_id(F.col("d")).alias("dst_id"), F.lit("references").alias("edge_type"))
    seeds = paths.where("i % 10 = 1").join(t.chunks.groupBy("source_path").agg(F.min("chunk_id").alias("cid")), "source_path").select(F.lit(1).alias("query_id"), "source_path", "cid")
    return graph.expand(seeds, t.chunks, nodes, edges, 2, per_source=2)


@query("SELECT metric, round(a - b, 6) AS delta FROM (SELECT r_name AS metric, r_regionkey * 1.5 AS a, r_regionkey * 0.5 + 1 AS b FROM {region})")
def compared_runs(t: Tables) -> DataFrame:
    run = lambda x: t.region.select(F.col("r_name").alias("metric"), x.alias("value"))
    return evaluation.compare(run(F.col("r_regionkey") * 1.5), run(F.col("r_regionkey") * 0.5 + 1)).select("metric", "delta")


@query("""WITH r AS (SELECT doc_id % 25 AS query_id, doc_id, CAST(1 + floor(doc_id / 25) AS INT) AS rank FROM {documents}), rel AS (SELECT DISTINCT doc_id % 25 AS query_id, doc_id FROM {labels} WHERE quality > 0),
  q AS (SELECT r.query_id, round(coalesce(1 / min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END), 0), 6) AS mrr FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc_id = rel.doc_id GROUP BY r.query_id) SELECT round(avg(mrr), 6) AS mrr FROM q""")
def evaluation_run(t: Tables) -> DataFrame:
    results = t.documents.select((F.col("doc_id") % 25).alias("query_id"), "doc_id", (1 + F.floor(F.col("doc_id") / 25)).cast("int").alias("rank"))
    qrels = t.labels.select((F.col("doc_id") % 25).alias("query_id"), "doc_id", F.col("quality").alias("score"))
    return evaluation.macro(evaluation.per_query(results, qrels, (10,))).select("mrr")


@query("""WITH l AS (SELECT '/f/' || doc_id AS source_path, text FROM {documents} WHERE doc_id % 4 <> 3), n AS (SELECT source_path, trim(regexp_replace(substring(text, 1, 40), '\\s+', ' ', 'g')) AS text FROM l)
SELECT source_path, CAST(CASE WHEN CAST(substring(source_path, 4) AS BIGINT) % 4 = 0 THEN 3 ELSE 1 END AS INT) AS version, true AS is_current FROM n WHERE CAST(substring(source_path, 4) AS BIGINT) % 4 <> 2 AND text <> ''
UNION ALL SELECT '/f/' || doc_id, 2, CASE WHEN doc_id % 4 = 0 THEN false ELSE true END FROM {documents} WHERE doc_id % 4 IN (0, 2)""")
def ingested_chunks(t: Tables) -> DataFrame:
    """One incremental run: changed (id % 4 = 0), new (1) and unchanged (2) files; the fourth is not listed and unknown."""
    d = F.col("doc_id")
    rows = t.documents.where(d % 4 != 3)
    short = F.trim(F.regexp_replace(F.substring("text", 1, 40), r"\s+", " "))
    path = F.concat(F.lit("/f/"), d)
    listing = rows.select(path.alias("source_path"), d.alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.sha2("text", 256).alias("file_hash"), short.alias("text"))
    known = rows.where(d % 4 != 1)
    manifest = known.select(path.alias("source_path"), F.when(d % 4 == 2, d).otherwise(-1).alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.lit("old").alias("file_hash"), F.lit(2).alias("version"), F.lit(None).cast("timestamp").alias("updated_at"))
    chunks = known.select(F.concat(F.lit("old"), d).alias("chunk_id"), path.alias("source_path"), F.lit(0).alias("chunk_index"), short.alias("text"), F.lit(2).alias("version"), F.lit(True).alias("is_current"), F.lit(None).cast("timestamp").alias("ingested_at"))
    return streaming.ingest_batch(listing, manifest, chunks, _ts(_NOW))[0].select("source_path", "version", "is_current")


@query("SELECT query_id, cid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) AS rank FROM (SELECT query_id, cid, rank, CASE WHEN rank % 2 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(length('x' || cid) AS DOUBLE) END AS score FROM {candidates} WHERE rank <= 20)")
def cached_rerank(t: Tables) -> DataFrame:
    """Scores of a model, every second one from the cache."""
    pool = t.candidates.where("rank <= 20").select("query_id", "cid", "rank", F.lit("q").alias("query"), F.concat(F.lit("x"), "cid").alias("text"))
    cache = pool.where("rank % 2 = 0").select(text.rerank_key(F.col("query"), F.col("cid").cast("string"), F.lit("model")).alias("cache_key"), F.lit(5.0).alias("score"))
    out, _ = fusion.cross_rerank(pool, _lengths, cache)
    return out.select("query_id", "cid", F.round("score", 6).alias("score"), "rank")


def _lengths(queries: list[str], texts: list[str]) -> list[float]:
    return [float(len(x)) for x in texts]


@query("""SELECT query_id, cid, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rank) AS r, rank AS was FROM (SELECT query_id, cid, rank, CASE WHEN contains(' ' || lower(cid) || ' ', ' none ') THEN 1 ELSE 0 END AS hits FROM {candidates})) WHERE false
UNION ALL SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) FROM (SELECT query_id, cid, rank, CASE WHEN rank % 3 = 0 THEN 1.0 WHEN rank % 3 = 1 THEN 0.5 ELSE 0 END AS score FROM {candidates})""")
def lexical_rerank(t: Tables) -> DataFrame:
    """Two words asked for: passages with both, with one and with none; no two stand side by side."""
    r = F.col("rank") % 3
    passage = F.when(r == 0, "alpha stands before something and then beta").when(r == 1, "only beta").otherwise("neither")
    return fusion.lexical_rerank(t.candidates.select("query_id", "cid", "rank", F.lit("alpha beta").alias("query"), passage.alias("text"))).select("query_id", "cid", "rank")


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY query_id, CAST(rank % 50 AS INT) ORDER BY rank) AS n FROM {candidates}), k AS (SELECT query_id, cid, source_path, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u WHERE n = 1),
  p AS (SELECT * FROM k WHERE rank <= 36), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY rank) AS m FROM p)
SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM c WHERE m <= 2""")
def local_rerank(t: Tables) -> DataFrame:
    """Fifty different texts a query, none with the word asked for: repeats go, the order stays, two a file stay."""
    rows = t.candidates.select("query_id", "cid", "rank", "source_path", F.lit("absent").alias("query"), F.concat(F.lit("Text  "), (F.col("rank") % 50).cast("int").cast("string")).alias("text"))
    return fusion.local_rerank(rows).select("query_id", "cid", "rank")


@query("""WITH b AS (SELECT q.vec_id AS query_id, 'v' || CAST(e.vec_id AS STRING) AS cid, 's' || CAST(e.vec_id % 40 AS STRING) AS p, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS d FROM {embeddings} q, {embeddings} e WHERE q.vec_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS r FROM b), t AS (SELECT * FROM k WHERE r <= 36), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY r) AS m FROM t)
SELECT query_id, cid, CAST(rank AS INT) AS rank FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM c WHERE m <= 2) WHERE rank <= 10""")
def dense_profile(t: Tables) -> DataFrame:
    """The dense profile end to end, without near-duplicate removal; every chunk has a text of its own without the question's word."""
    v = F.col("vec_id")
    rows = t.embeddings.select(F.concat(F.lit("v"), v).alias("chunk_id"), F.concat(F.lit("t"), v).alias("text"), F.concat(F.lit("s"), v % 40).alias("source_path"), F.lit(True).alias("is_current"), "embedding")
    queries = t.embeddings.where("vec_id % 20 = 0").select(v.alias("query_id"), F.lit("absent").alias("query"), "embedding")
    return pipeline.Pipeline(rows, pipeline.Config("dense_only", k=10, dedup_threshold=None)).retrieve(queries).select("query_id", "cid", "rank")


@query("""SELECT '/a/b/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'root,b' ELSE 'root' END AS tags FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'b/' || doc_id ELSE 'x/' || doc_id END AS k, doc_id FROM {documents}) WHERE doc_id % 2 = 0
UNION ALL SELECT '/a/x/' || doc_id, 'root' FROM {documents} WHERE doc_id % 2 <> 0""")
def folder_tags(t: Tables) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/a/b/"), "doc_id")).otherwise(F.concat(F.lit("/a/x/"), "doc_id"))
    tagged = t.spark.createDataFrame([("/a", ["root"]), ("/a/b", ["b", "root"]), ("/a/b/c", ["deep"])], "folder string, tags array<string>")
    return files.folder_tags(t.documents.select(path.alias("path")), tagged).select("path", F.array_join("tags", ",").alias("tags"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'body ' || lang ELSE '--- no' END AS body FROM {documents}""")
def front_matter(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 2 == 0, F.concat(F.lit('---\ntitle: "T '), d, F.lit('"\ntags:\n---\n\nbody '), F.col("lang"), F.lit("\n"))).otherwise(F.lit("--- no"))
    return files.front_matter(t.documents.select("doc_id", raw.alias("text"))).select("doc_id", F.try_element_at("meta", F.lit("title")).alias("title"), "body")


@query("SELECT doc_id, (doc_id % 2 = 0 OR text LIKE '%é') AS latin, length(text) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM {documents}")
def decoded_texts(t: Tables) -> DataFrame:
    """UTF-8 texts as they are; bytes that are none, as Latin-1."""
    latin = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", "e"), "UTF-8"), F.unhex(F.lit("E9")))
    content = F.when(F.col("doc_id") % 2 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    out = files.decode_text(t.documents.select("doc_id", content.alias("content")))
    return out.select("doc_id", F.col("text").endswith("é").alias("latin"), F.length("text").cast("long").alias("n"))


@query("SELECT vec_id, label FROM {embeddings}")
def vector_joins(t: Tables) -> DataFrame:
    """Vectors stored in two halves, put together by key."""
    half = lambda c: t.embeddings.select("vec_id", c)
    return mutations.update_columns(half("label").withColumn("label", F.lit(None).cast(dict(t.embeddings.dtypes)["label"])), half("label"), "vec_id").select("vec_id", "label")


@query()
def simhash_columns(t: Tables) -> DataFrame:
    """The column form of the fingerprint, which simhash_docs computes for whole tables."""
    return t.documents.select("doc_id", similarity.simhash(F.col("text")).alias("simhash"))


@query()
def text_structure(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("source_path"), "text")
    return structure.text_graph(docs).select("path", "node_id", "parent_id", "node_type", "depth", "start_char", "end_char")


@query()
def html_structure(t: Tables) -> DataFrame:
    pages = t.pages.select(F.col("page_id").cast("string").alias("source_path"), "html")
    return structure.html_graph(pages).select("path", "node_id", "parent_id", "node_type", "depth", "start_line", "end_line")


@query("""WITH b AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\s*\\n')) AS b FROM {documents}) WHERE regexp_replace(b, '\\s+', '', 'g') <> '' GROUP BY doc_id)
SELECT CAST(doc_id AS STRING) AS path, 1 + coalesce(n, 0) AS nodes FROM {documents} LEFT JOIN b USING (doc_id)""")
def structure_sizes(t: Tables) -> DataFrame:
    """Nodes of each document's tree: the document and its blank-line blocks."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("source_path"), "text")
    return structure.text_graph(docs).groupBy("path").agg(F.count("*").alias("nodes"))
