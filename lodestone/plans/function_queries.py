"""Registered queries of the column functions: text, identifiers, scores, notes and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import filters, fusion, graph, rendering, retrieval, stats
from .registry import Tables, query

_ONE = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query("""SELECT o_orderkey, CAST(floor(o_totalprice / 3600) AS BIGINT) || printf(':%02d:%02d', CAST(floor(o_totalprice / 60) AS BIGINT) % 60, CAST(floor(o_totalprice) AS BIGINT) % 60) AS elapsed,
  strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS at FROM {orders}""")
def times_shown(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.format_time(F.col("o_totalprice")).alias("elapsed"), text.iso_utc(F.col("o_orderdate")).alias("at"))


@query("""SELECT s_suppkey, CASE WHEN e IS NULL OR trim(e) = '' THEN NULL WHEN trim(e) LIKE '.%' THEN lower(trim(e)) ELSE '.' || lower(trim(e)) END AS ext,
  CASE WHEN b IS NULL THEN true ELSE lower(trim(b)) IN ('1', 'true', 'yes', 'on', 'y', 't') END AS flag FROM (
  SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ' PDF ' WHEN 1 THEN '.Md' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'txt' END AS e,
    CASE s_suppkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' WHEN 2 THEN 'off' WHEN 3 THEN NULL WHEN 4 THEN 'T' ELSE '' END AS b FROM {supplier})""")
def lenient_values(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    e = F.when(k % 5 == 0, " PDF ").when(k % 5 == 1, ".Md").when(k % 5 == 2, "").when(k % 5 == 4, "txt")
    b = F.when(k % 6 == 0, " Yes").when(k % 6 == 1, "0").when(k % 6 == 2, "off").when(k % 6 == 4, "T").when(k % 6 == 5, "")
    return t.supplier.select(k, text.normalize_ext(e).alias("ext"), text.lenient_bool(b).alias("flag"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a,' || c_custkey WHEN 1 THEN 'plain ' || c_custkey WHEN 2 THEN '' ELSE c_name END AS vs FROM {customer}""")
def listed_values(t: Tables) -> DataFrame:
    """Tag lists kept as JSON text, as single values and not at all."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('["a", " ", "'), k, F.lit('"]'))).when(k % 4 == 1, F.concat(F.lit(" plain "), k)).when(k % 4 == 3, F.concat(F.lit('["'), F.col("c_name"), F.lit('"]')))
    return t.customer.select(k, F.array_join(text.values_of(raw), ",").alias("vs"))


@query(r"""SELECT p_partkey, lower(replace(trim(p), '/', chr(92))) AS path FROM (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_partkey AS p FROM {part})""")
def query_paths(t: Tables) -> DataFrame:
    p = F.concat(F.lit(" /"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")), F.lit("/ "))
    return t.part.select("p_partkey", text.query_path(p).alias("path"))


@query("""SELECT item_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '["*^(){{}}]', ' ', 'g')), '\\s+'), lambda x: x <> ''), ' ') AS terms FROM {benchmark}""")
def full_text_terms(t: Tables) -> DataFrame:
    marked = F.concat(F.lit('"'), F.replace("text", F.lit(" "), F.lit("* ")))
    plain = text.fts_terms(F.col("text"))
    return t.benchmark.select("item_id", F.when(F.array_join(text.fts_terms(marked), "") == F.array_join(plain, ""), F.array_join(plain, " ")).alias("terms"))


_STOPS = ", ".join(f"'{w}'" for w in sorted({*text.STOP_WORDS, *text.KEYWORD_STOP_WORDS}))


@query(r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_\-]{{2,}}'), lambda w: w NOT IN (""" + _STOPS + r"""))))[1:8], ',') AS tags FROM {benchmark}""")
def prompt_tags(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(text.prompt_tags(F.col("text")), ",").alias("tags"))


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '(\d)[.\-](\d)', '\1\2', 'g'), '(\d)[.\-](\d)', '\1\2', 'g'), '[a-zA-Z0-9'']+') AS ws FROM {benchmark}),
  e AS (SELECT item_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w), f AS (SELECT item_id, w, min(i) AS i FROM e WHERE length(w) >= 4 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + r""") GROUP BY ALL)
SELECT b.item_id, coalesce(tags, '') AS tags FROM {benchmark} b LEFT JOIN (SELECT item_id, string_agg(w, ',' ORDER BY i) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f) WHERE n <= 8 GROUP BY item_id) x ON b.item_id = x.item_id""")
def topic_tags(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(text.topic_tags(F.col("text")), ",").alias("tags"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'asked ' || c_custkey ELSE 'title:"' || c_name || '" author:"' || n_name || '" ' || CASE WHEN c_custkey % 3 = 1 THEN 'doi:10.1234/' || c_custkey || ' ' ELSE '' END || '1999 a b' END AS query
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")
def composed_queries(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" asked "), k))
    doi = F.when(k % 3 == 1, F.concat(F.lit("10.1234/"), k))
    return j.select(k, text.compose_query(F.coalesce(asked, F.lit(" ")), F.col("c_name"), F.col("n_name"), doi, F.lit(1999), F.array(F.lit("a"), F.lit("b"))).alias("query"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1200 THEN substring(text, 1, 1150) || chr(10) || '[...truncated...]' ELSE text END AS shown FROM {documents}""")
def rerank_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.rerank_text(F.col("text")).alias("shown"))


@query("""SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) > 0 THEN greatest(1, length(text) // 4) WHEN doc_id % 2 = 0 THEN 256 ELSE 0 END AS BIGINT) AS tokens FROM {documents}""")
def output_tokens(t: Tables) -> DataFrame:
    limit = F.when(F.col("doc_id") % 2 == 0, F.lit(256))
    return t.documents.select("doc_id", text.output_tokens(F.col("text"), limit).alias("tokens"))


@query("""SELECT doc_id, md5('Question:' || chr(10) || lang || chr(10) || chr(10) || 'Sources:' || chr(10) || text || chr(10) || chr(10) || 'Write the answer with inline citations.') AS digest FROM {documents}""")
def user_contents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.user_content(F.col("lang"), F.col("text"))).alias("digest"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'first ' || c_custkey || '|second' WHEN 1 THEN 'What is ' || c_name ELSE 'inner one|inner two' END AS questions FROM {customer}""")
def sub_questions(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    answer = F.when(k % 3 == 0, F.concat(F.lit('["first '), k, F.lit('", " ", "second", "third"]'))).when(k % 3 == 1, F.concat(F.lit("1. What is "), F.col("c_name"), F.lit("\n2) short\n"))).otherwise(F.lit('Here: ["inner one", "inner two"] done'))
    return t.customer.select(k, F.array_join(text.sub_questions(answer, 2), "|").alias("questions"))


@query("""SELECT query_id, cid, coalesce(greatest(least(1 - distance, 1), -1), 0) AS relevance FROM {candidates}""")
def candidate_relevances(t: Tables) -> DataFrame:
    return t.candidates.select("query_id", "cid", text.candidate_relevance(F.col("distance")).alias("relevance"))


@query("""SELECT o_orderkey, CAST(1 + o_orderkey % 7 AS INT) AS page FROM {orders}""")
def pages_of_offsets(t: Tables) -> DataFrame:
    """The page of an offset among pages of 100 characters; what is beyond the last page belongs to it."""
    spans = F.array(*[F.struct(F.lit(100 * n).alias("start"), F.lit(100 * (n + 1)).alias("end"), F.lit(n + 1).alias("page")) for n in range(7)])
    offset = F.when(F.col("o_orderkey") % 7 == 6, F.lit(600) + F.col("o_orderkey") % 1000).otherwise(F.col("o_orderkey") % 7 * 100 + F.col("o_custkey") % 100)
    return t.orders.select("o_orderkey", text.page_at(spans, offset).alias("page"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'docs' || chr(92) || 's' || s_suppkey END AS path, CASE s_suppkey % 5 WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' END AS ext,
  CASE s_suppkey % 5 WHEN 3 THEN 'a*' || s_suppkey END AS pattern, CASE s_suppkey % 5 WHEN 0 THEN 'Docs/S' || s_suppkey WHEN 1 THEN 'ext:MD' WHEN 2 THEN '.pdf' WHEN 3 THEN 'A*' || s_suppkey ELSE 'All files' END AS root, s_suppkey % 5 = 0 AS full_path FROM {supplier}""")
def explore_fields(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    asked = F.when(k % 5 == 0, F.concat(F.lit("Docs/S"), k, F.lit(" --full-path"))).when(k % 5 == 1, F.lit("ext:MD")).when(k % 5 == 2, F.lit(".pdf")).when(k % 5 == 3, F.concat(F.lit("A*"), k)).otherwise(F.lit(" "))
    return t.supplier.select(k, text.explore_fields(asked).alias("q")).select("s_suppkey", "q.*")


@query("SELECT source_path FROM (SELECT DISTINCT source_path FROM {chunks}) WHERE lower(source_path) LIKE '%src1%'")
def explore_path(t: Tables) -> DataFrame:
    return filters.explore(t.chunks.select("source_path").distinct(), "SRC1")


@query(r"SELECT source_path FROM (SELECT DISTINCT source_path FROM {chunks}) WHERE regexp_matches(source_path, '^.*src1/[0-3]$')")
def explore_glob(t: Tables) -> DataFrame:
    return filters.explore(t.chunks.select("source_path").distinct(), "*src1/[0-3]")


@query("SELECT '' AS folder")
def common_folder(t: Tables) -> DataFrame:
    return graph.common_folder(t.chunks)


@query("SELECT DISTINCT '/src1' AS folder")
def common_folder_of_source(t: Tables) -> DataFrame:
    return graph.common_folder(t.chunks.where("source_path LIKE '/src1/%'"))


@query(r"""SELECT DISTINCT source_path FROM {chunks} WHERE regexp_matches(text, '\bder\b') OR source_path LIKE '%/2' ORDER BY source_path LIMIT 50""")
def find_files(t: Tables) -> DataFrame:
    found = filters.find_files(t.chunks, name="^2$", content=r"\bder\b", regex=True, most=None)
    return found.select("source_path").distinct().orderBy("source_path").limit(50)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE n_name END AS matched FROM {nation}""")
def inventory_matches(t: Tables) -> DataFrame:
    inventory = t.nation.agg(F.array_sort(F.collect_list("n_name")).alias("values")).select(F.lit("author").alias("field"), "values")
    asked = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("no "), "n_name")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).alias("value"))
    return filters.match_inventory(asked, inventory).select("n_nationkey", "matched")


@query("""SELECT n_nationkey AS query_id, 'author' AS field, n_name AS value FROM {nation} WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'content_type', r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'year', '1999' FROM {nation} UNION ALL SELECT n_nationkey, 'ai_tags', 'graphs' FROM {nation}""")
def question_conditions(t: Tables) -> DataFrame:
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    question = F.concat(F.lit("graphs in "), F.lower("r_name"), F.lit(" since 1999"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" author: "), F.lower("n_name"))).otherwise(F.lit("")))
    lists = [t.nation.agg(F.array_sort(F.collect_set("n_name")).alias("values")).select(F.lit("author").alias("field"), "values"), t.region.agg(F.array_sort(F.collect_set("r_name")).alias("values")).select(F.lit("content_type").alias("field"), "values")]
    more = t.spark.createDataFrame([("year", ["1998", "1999"]), ("ai_tags", ["graphs", "other"])], "field string, values array<string>")
    return filters.metadata_conditions(j.select(F.col("n_nationkey").alias("query_id"), question.alias("question")), lists[0].unionByName(lists[1]).unionByName(more))


@query("""WITH e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM {embeddings}))
SELECT a AS vec_id, round(s, 6) AS cosine FROM e""")
def cosine_similarities(t: Tables) -> DataFrame:
    n = t.embeddings.agg(F.count("*").alias("n"))
    a = t.embeddings.crossJoin(n).select("vec_id", "embedding", ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("other"))  # one row of counts
    j = a.join(t.embeddings.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e")), "other")
    return j.select("vec_id", F.round(similarity.cosine_similarity(F.col("embedding"), F.col("e")), 6).alias("cosine"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE ((CASE WHEN l_partkey % 2 = l_suppkey % 2 THEN 1 ELSE 0 END) + (CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN 1 ELSE 0 END)) / 2 END AS similarity,
  l_linenumber % 3 <> 0 AND l_partkey % 6 = l_suppkey % 6 AS near FROM {lineitem}""")
def signature_similarities(t: Tables) -> DataFrame:
    sign = lambda c: F.array(F.col(c) % 2, F.col(c) % 3)
    b = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.col("l_suppkey") % 2)).otherwise(sign("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", similarity.signature_similarity(sign("l_partkey"), b).alias("similarity"), similarity.near_duplicates(sign("l_partkey"), b).alias("near"))


# --- costs, notes, citations -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, round((o_custkey * 3.0 + o_orderkey * 15.0) / 1000000, 9) AS cost, CASE WHEN o_custkey % 4 = 0 THEN 'ok' WHEN o_totalprice >= 200000 THEN 'exceeded' WHEN o_totalprice >= 160000 THEN 'warning' ELSE 'ok' END AS status FROM {orders}""")
def cost_states(t: Tables) -> DataFrame:
    cost = stats.cost_estimate(F.col("o_custkey"), F.col("o_orderkey"), F.lit(3.0), F.lit(15.0))
    status = stats.budget_status(F.col("o_totalprice"), F.when(F.col("o_custkey") % 4 != 0, F.lit(200000.0)))
    return t.orders.select("o_orderkey", F.round(cost, 9).alias("cost"), status.alias("status"))


@query("SELECT count(*) AS calls, round(sum(cost), 2) AS cost FROM {usage}")
def total_cost(t: Tables) -> DataFrame:
    return stats.total_usage(t.usage).withColumn("cost", F.round("cost", 2))


@query("""SELECT q.query_id, CAST(greatest(1, (2 + length(CAST(q.query_id AS STRING)) + n + chars) // 4) AS BIGINT) AS input_tokens, CAST(150 AS BIGINT) AS output_tokens
FROM (SELECT query_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM {candidates} WHERE rank <= 5 GROUP BY query_id) q""")
def rerank_estimates(t: Tables) -> DataFrame:
    questions = t.candidates.select("query_id").distinct().withColumn("question", F.concat(F.lit("q "), "query_id"))
    return stats.rerank_estimate(t.candidates, questions, 5)


@query("""SELECT query_id, cid, md5('Closest passage for: q' || chr(10) || chr(10) || CASE WHEN length(text) > 1200 THEN substring(text, 1, 1200) || '...' ELSE text END || chr(10) || chr(10) || '[' || source_path || ']') AS digest FROM {candidates} WHERE rank <= 20""")
def fallback_answers(t: Tables) -> DataFrame:
    top = t.candidates.where("rank <= 20")
    return top.select("query_id", "cid", F.md5(rendering.excerpt_answer(F.lit("q"), F.col("text"), F.col("source_path"))).alias("digest"))


_CITED = """SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'https://x.org/' || doc_id WHEN doc_id % 5 = 1 THEN source_path || '.PDF' WHEN doc_id % 5 = 2 THEN source_path || '.html' ELSE source_path END AS p,
  CASE WHEN doc_id % 3 = 0 THEN heading END AS title, CASE WHEN doc_id % 4 = 0 THEN 'A. Uthor' END AS author, source_name, CAST(ingested_at AS TIMESTAMP) AS seen_at, mtime_ns FROM {chunks}"""


@query(f"""WITH s AS ({_CITED}), c AS (SELECT *, coalesce(title, source_name) AS shown, CAST(year(coalesce(seen_at, make_timestamp(mtime_ns // 1000))) AS STRING) AS y FROM s)
SELECT chunk_id, regexp_replace(regexp_replace(lower(coalesce(author, shown) || '-' || coalesce(y, 'n.d.')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS key, shown AS title, author, y AS year, p AS source_path,
  CASE WHEN p NOT LIKE 'http%' AND lower(p) LIKE '%.pdf' THEN 'article' ELSE 'misc' END AS entry_type,
  CASE WHEN p LIKE 'http%' THEN 'webpage' WHEN lower(p) LIKE '%.pdf' THEN 'journalArticle' WHEN lower(p) LIKE '%.html' THEN 'webpage' ELSE 'document' END AS item_type FROM c""")
def source_citations(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    p = F.when(d % 5 == 0, F.concat(F.lit("https://x.org/"), d)).when(d % 5 == 1, F.concat("source_path", F.lit(".PDF"))).when(d % 5 == 2, F.concat("source_path", F.lit(".html"))).otherwise(F.col("source_path"))
    rows = t.chunks.withColumn("source_path", p).withColumn("title", F.when(d % 3 == 0, F.col("heading"))).withColumn("author", F.when(d % 4 == 0, F.lit("A. Uthor")))
    return rendering.citations(rows, keep=("chunk_id",))


@query("""SELECT s_suppkey, '@misc{{' || regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') || ',' || chr(10) || '  title = {{' || s_name || '}},' || chr(10) || '  year = {{2020}},' || chr(10) || '  note = {{/s/' || s_suppkey || '}}' || chr(10) || '}}' AS entry FROM {supplier}""")
def bibtex_entries(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/s/"), "s_suppkey")
    return t.supplier.select("s_suppkey", rendering.bibtex(F.col("s_name"), F.lit(None).cast("string"), F.lit(2020), path).alias("entry"))


@query("""SELECT s_suppkey, '{{"itemType":"document","title":"' || s_name || '","creators":[{{"creatorType":"author","name":"n' || s_nationkey || '"}}],"date":"2020","url":"/s/' || s_suppkey || '"}}' AS entry FROM {supplier}""")
def zotero_entries(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/s/"), "s_suppkey")
    return t.supplier.select("s_suppkey", rendering.zotero(F.col("s_name"), F.concat(F.lit("n"), "s_nationkey"), F.lit(2020), path).alias("entry"))


@query("""SELECT chunk_id, md5('### Source ' || (chunk_index + 1) || ': ' || string_split(source_path, '/')[-1] || chr(10) || '**Relevance:** 0.75 | **Chunk:** ' || chunk_index || chr(10) || '**Path:** `' || source_path || '`' || chr(10) || chr(10)
  || '**Tags:** #' || CASE WHEN 'a' < lang THEN 'a #' || lang ELSE lang || ' #a' END || chr(10) || chr(10) || '**Content:**' || chr(10) || '```' || chr(10) || CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END || chr(10) || '```' || chr(10)) AS digest FROM {chunks}""")
def local_notes(t: Tables) -> DataFrame:
    note = rendering.local_source_note(F.col("chunk_index") + 1, F.col("source_path"), F.col("chunk_index"), F.lit(0.25), F.col("text"), F.array(F.col("lang"), F.lit("a"), F.col("lang")))
    return t.chunks.select("chunk_id", F.md5(note).alias("digest"))


@query("""SELECT s_suppkey, '### Remote Source 1: ' || s_name || chr(10) || '**Score:** 0.50' || chr(10) || '**URL:** http://x/' || s_suppkey || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '**Summary:**' || chr(10) || '> sum' || chr(10) ELSE '' END AS note FROM {supplier}""")
def remote_notes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k, rendering.remote_source_note(F.lit(1), F.col("s_name"), F.concat(F.lit("http://x/"), k), F.when(k % 2 == 0, F.lit("sum")), F.lit(0.5)).alias("note"))


@query("""SELECT s_suppkey AS note_id, CAST(1 AS INT) AS position, '/s/' || s_suppkey AS source_path, CAST(s_suppkey AS STRING) AS source_name, s_name AS title, CAST(NULL AS STRING) AS author FROM {supplier}
UNION ALL SELECT s_suppkey, 2, '/t/x.md', 'x.md', NULL, 'B' FROM {supplier}""")
def note_sources(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    note = F.concat(F.lit("Intro **Path:** `no`\n### Source 1: a\n**Title:** "), F.col("s_name"), F.lit("\n**Path:** `/s/"), k, F.lit("`\n\n  ### Source 2: b\n**Author:** B\n**Path:** see `/t/x.md` here\n### Source 3: none\n"))
    return rendering.note_sources(t.supplier.select(k.alias("note_id"), note.alias("text")))


# --- ranked lists ----------------------------------------------------------------------------------------------------


@query("""SELECT query_id, cid, round(1 - distance, 6) AS dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS dense_rank FROM {candidates}""")
def score_breakdown(t: Tables) -> DataFrame:
    return retrieval.with_scores(t.candidates).select("query_id", "cid", F.round("dense_score", 6).alias("dense_score"), "dense_rank")


@query("""WITH h AS (SELECT query_id, cid, rank, rank % 3 AS hop FROM {candidates} UNION ALL SELECT query_id, cid, rank + 1, 5 FROM {candidates})
SELECT query_id, cid, CAST(r AS INT) AS rank FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank, cid) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cid ORDER BY hop, rank) AS n FROM h) WHERE n = 1) WHERE r <= 30""")
def hops_united(t: Tables) -> DataFrame:
    c = t.candidates.select("query_id", "cid", "rank")
    hops = c.withColumn("hop", F.col("rank") % 3).unionByName(c.withColumn("rank", F.col("rank") + 1).withColumn("hop", F.lit(5)))
    return fusion.union_hops(hops, 30).select("query_id", "cid", "rank")


@query("""WITH r AS (SELECT query_id, 'web' AS provider, 'u' || cid AS url, 1 - coalesce(distance, 1) AS score, CASE WHEN rank % 4 = 0 THEN 2.0 END AS weight FROM {candidates} WHERE rank % 2 = 0)
SELECT query_id, 'remote:web:' || CAST(n AS STRING) AS cid, url AS source_path, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score * coalesce(weight, 1) DESC, provider, url) AS n FROM r)""")
def remote_candidates(t: Tables) -> DataFrame:
    rows = t.candidates.where("rank % 2 = 0").select("query_id", F.lit("web").alias("provider"), F.concat(F.lit("u"), "cid").alias("url"), (1 - F.coalesce("distance", F.lit(1.0))).alias("score"), F.when(F.col("rank") % 4 == 0, F.lit(2.0)).alias("weight"))
    return rendering.remote_candidates(rows).select("query_id", "cid", "source_path", "rank")


@query("""WITH l AS (SELECT query_id, cid, rank FROM {candidates} WHERE rank <= 5), r AS (SELECT query_id, 'r' || cid AS cid, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(distance, 0) DESC, rank) AS rank FROM {candidates} WHERE rank BETWEEN 6 AND 12)
SELECT query_id, cid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS INT) AS rank FROM (SELECT *, 0 AS p FROM l UNION ALL SELECT *, 1 FROM r)""")
def remote_merged(t: Tables) -> DataFrame:
    local = t.candidates.where("rank <= 5").select("query_id", "cid", "rank")
    remote = t.candidates.where("rank BETWEEN 6 AND 12").select("query_id", F.concat(F.lit("r"), "cid").alias("cid"), "rank", F.coalesce("distance", F.lit(0.0)).alias("score"), F.lit(None).cast("double").alias("weight"))
    return fusion.merge_remote(local, remote).select("query_id", "cid", "rank")


@query("""SELECT query_id, source_path, cid, snippet, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS r FROM (
  SELECT query_id, source_path, cid, substring('text of ' || CAST(cid AS STRING), 1, 9) AS snippet, round(greatest(least(1 - d, 1), -1), 6) AS score, row_number() OVER (PARTITION BY query_id, source_path ORDER BY d, cid) AS n FROM (
    SELECT q.query_id, v.source_path, v.vec_id AS cid, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS d FROM {vector_queries} q JOIN {vectors} v ON v.source_path IN ('s1', 's2', 's3')))
  WHERE n <= 4) WHERE r <= 4""")
def snippets(t: Tables) -> DataFrame:
    sources = t.vector_queries.select("query_id").crossJoin(t.spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s1",)], "source_path string"))  # the stated queries times the asked sources
    rows = t.vectors.withColumn("text", F.concat(F.lit("text of "), F.col("vec_id").cast("string")))
    return retrieval.snippets(rows, sources, t.vector_queries, 4, 9, "vec_id")
