"""Reference tables that the registered queries run on, derived from the driver's tables in SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import read_table

#: Tables with much work a row.
_HEAVY = ("documents", "pages", "embeddings")

#: {name} stands for a driver table or an earlier view.
VIEWS: dict[str, str] = {
    # One row a document as a chunk: 5 chunks to a file, versions by position, some nulls.
    "chunks": """
        SELECT doc_id, 'c' || CAST(doc_id AS STRING) AS chunk_id, text, lang,
               '/' || source || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS STRING) AS source_path,
               source AS source_name,
               CASE CAST(floor(doc_id / 100) AS BIGINT) % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.html' ELSE NULL END AS ext,
               CAST(floor((doc_id % 100) / 20) AS INT) AS chunk_index,
               CAST(floor((doc_id % 100) / 20) AS INT) + 1 AS version,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 100) >= 60 END AS is_current,
               CASE doc_id % 10 WHEN 0 THEN 'section_summary' WHEN 1 THEN 'file_summary' WHEN 2 THEN NULL ELSE 'chunk' END AS node_type,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'H' || CAST((doc_id % 100) % 4 AS STRING) END AS heading,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 10 AS INT) END AS cluster_id,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id * 31 END AS simhash,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1700000000000000000 + doc_id * 3600000000000 END AS mtime_ns,
               CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) + CAST(doc_id % 300 AS INT) END AS ingested_at
        FROM {documents}""",
    # Ranked candidates of 25 queries, every chunk one of them.
    "candidates": """
        SELECT doc_id % 25 AS query_id, chunk_id AS cid, CAST(1 + floor(doc_id / 25) AS INT) AS rank, text, source_path, source_name, ext, chunk_index,
               heading, mtime_ns, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 END AS distance
        FROM {chunks}""",
    # Vectors as chunks of three levels.
    "vectors": """
        SELECT vec_id, embedding, label, 's' || CAST(vec_id % 40 AS STRING) AS source_path, true AS is_current,
               CASE vec_id % 10 WHEN 0 THEN 'section_summary' WHEN 1 THEN 'file_summary' ELSE 'chunk' END AS node_type
        FROM {embeddings}""",
    "vector_queries": "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 20 = 0",
    # A property graph over parts, suppliers and orders' customers.
    "nodes": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS node_id, 'part' AS node_type, p_brand AS label, '/p/' || CAST(p_partkey % 50 AS STRING) AS source_path FROM {part}
        UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'supplier', s_name, '/s/' || CAST(s_suppkey AS STRING) FROM {supplier}""",
    "edges": """
        SELECT DISTINCT 'p' || CAST(l_partkey AS STRING) AS src_id, 's' || CAST(l_suppkey AS STRING) AS dst_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'references' ELSE 'cites' END AS edge_type
        FROM {lineitem}""",
    "usage": "SELECT event_id, ts, user_id, event_type AS provider, value AS cost FROM {events}",
    "manifest": """
        SELECT '/m/' || CAST(o_custkey AS STRING) AS source_path, max(o_orderkey) AS mtime_ns, count(*) AS size,
               'h' || CAST(max(o_orderkey) % 10 AS STRING) AS file_hash, CAST(count(*) AS INT) AS version FROM {orders} GROUP BY o_custkey""",
    "listing": """
        SELECT '/m/' || CAST(c_custkey AS STRING) AS source_path, c_custkey * 3 AS mtime_ns, c_custkey % 20 AS size,
               'h' || CAST(c_custkey % 10 AS STRING) AS file_hash FROM {customer}""",
    "memories": """
        SELECT o_orderkey AS memory_id, CASE o_orderkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'project' ELSE 'agent' END AS scope,
               o_orderstatus AS type, o_orderkey % 10 = 0 AS pinned, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS last_used_at,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS expires_at, 1 + o_orderkey % 37 AS tokens FROM {orders}""",
    "memory_candidates": "SELECT o_orderkey AS memory_id, o_orderkey * 2 AS candidate_id, o_orderdate AS created_at, CASE WHEN o_custkey % 3 = 0 THEN 'promoted' WHEN o_custkey % 3 = 1 THEN 'pending' ELSE 'rejected' END AS status FROM {orders}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view as a DataFrame."""
    if name not in VIEWS:
        path = f"{sf_dir}/{name}.parquet"
        return read_table(spark, path) if name in _HEAVY else spark.read.parquet(path)
    text = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _used(text)}
    return spark.sql(text, **parts)


def _used(text: str) -> list[str]:
    import string

    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def with_views(sql: str) -> str:
    """Oracle SQL in which {name} stands for a driver table or a view (made a common table expression)."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _used(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = {n: n for n in (*VIEWS, *_TABLES)}
    head = ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in order)
    body = sql.format(**plain)
    if not head:
        return body
    return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE '):]}" if body.startswith("WITH RECURSIVE ") else f"WITH {head} {',' + body[5:] if body.startswith('WITH ') else body}"


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
