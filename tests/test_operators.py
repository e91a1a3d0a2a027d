"""Hand-computed cases of the engine's operators."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity, text
from lodestone.operators import chunking, evaluation, filters, fusion, graph, maintenance, memory, mutations, rendering, retrieval, stats
from lodestone.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.normalize_whitespace(lit(" a \t b\r\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, text.tokenize(lit("What is Python 3.9-1 programming?"))) == ["python", "391", "programming"]
    assert one(spark, text.slugify(lit("--Ab c!!"), 3)) == "ab"
    assert one(spark, text.slugify(lit("!!"), empty="source")) == "source"
    assert one(spark, text.estimate_tokens(lit(""))) == 0 and one(spark, text.estimate_tokens(lit("abc"))) == 1
    assert one(spark, text.format_time(lit(3725))) == "1:02:05"
    assert [one(spark, text.heading_level(lit(x), True)) for x in ("## A b", "<h3>x</h3>", "**B**", "Chapter 2.1: Start", "plain", "<h2></h2>")] == [2, 3, 1, 2, None, None]
    assert one(spark, text.is_list_block(lit("- a\n\n2) b"))) and not one(spark, text.is_list_block(lit("")))
    f = one(spark, text.query_fields(lit("papers by Ada Lovelace from 1990 to 2001 doi 10.1234/ab.c title: \"On engines\"")))
    assert (f["doi"], f["author"], f["title"], f["first_year"], f["last_year"]) == ("10.1234/ab.c", "Ada Lovelace", "On engines", "1990", "2001")
    assert one(spark, text.normalize_ext(lit(" TXT "))) == ".txt" and one(spark, text.normalize_ext(lit(" "))) is None
    assert one(spark, text.cited_numbers(lit("[S3] [S1] [S3] [S0]"))) == [3, 1]
    assert one(spark, text.lexical_score(text.tokenize(lit("python programming")), text.tokenize(lit("python programming guide")))) == pytest.approx(1.1)


def test_slugs_of_whole_texts(spark, tmp_path):
    import re

    from lodestone.plans.queries import QUERIES

    rows = [(1, "!" * 100 + " Late Words"), (2, "Яд " * 40 + "after"), (3, "ab-" * 40), (4, None), (5, ""), (6, "x" * 49 + " - yz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: re.sub(r"[^a-z0-9]+", "-", (t or "").lower()).strip("-")[:50].rstrip("-") for i, t in rows}
    assert want[1] == "late-words" and want[2] == "after"
    assert {r["doc_id"]: r["slug"] for r in QUERIES["whole_slugs"](spark, str(tmp_path)).collect()} == want


def test_signatures(spark):
    import hashlib

    t = "The quick  brown fox the"
    words = t.lower().split()
    sums = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16) & (1 << 64) - 1
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if sums[b] > 0)
    want -= (1 << 64) if want >> 63 else 0
    assert one(spark, similarity.simhash(F.lit(t))) == want
    joined = " ".join(words)
    hs = {int(hashlib.md5(joined[i : i + 3].encode()).hexdigest(), 16) & 0xFFFFFFFF for i in range(len(joined) - 2)}
    want = [min(((i * 0x5BD1E995 * h + i * 0x1B873593) % ((1 << 61) - 1)) & 0xFFFFFFFF for h in hs) for i in range(1, 6)]
    assert one(spark, similarity.minhash(F.lit(t), 5)) == want
    assert one(spark, similarity.minhash(F.lit(" "), 2)) == [0xFFFFFFFF] * 2
    assert one(spark, similarity.signature_similarity(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 0.5
    assert one(spark, similarity.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_repeats_by_folded_text(spark):
    wide = "a" + " " * 2000
    texts = [wide + "one", wide + "two", "\n" * 2000 + "late", "A\n\tone", "b" * 2000 + "x", "b" * 2000 + "y", " \n", None]
    df = spark.createDataFrame([(1, str(n), n, t) for n, t in enumerate(texts, 1)], "query_id int, cid string, rank int, text string")
    assert [r["cid"] for r in fusion.drop_repeats(df).orderBy("rank").collect()] == ["1", "2", "3", "5", "6"]
    assert [r["cid"] for r in fusion.drop_repeats(df, most=2000).orderBy("rank").collect()] == ["1", "2", "3", "5"]


def test_near_repeats_take_128_slots(spark):
    import random

    import numpy as np

    from lodestone.plans.queries import QUERIES
    from lodestone.plans.views import view

    sf = "/root/testdata/sf0.001"
    odd = [(1, "The  Quick\nbrown fox"), (2, None), (3, " "), (4, "ab"), (5, "Éa 中文 😀 x"), (6, " ".join(f"w{random.Random(k).random()}" for k in range(900)))]
    df = spark.createDataFrame(odd, "id int, text string")
    got = {r["id"]: np.frombuffer(r["signature"], "<u4").tolist() for r in similarity.minhash_table(df, "id", 20).collect()}
    assert got == {r["id"]: r["s"] for r in df.select("id", similarity.minhash(F.coalesce("text", F.lit("")), 20).alias("s")).collect()}
    pools = {}
    for r in view(spark, sf, "candidates").orderBy("query_id", "rank").collect():
        pools.setdefault(r["query_id"], []).append((r["cid"], r["text"]))
    signer, want = similarity.Signer(128), set()
    for q, pool in pools.items():
        kept = []
        for cid, t in pool:
            sig = signer.sign(" ".join((t or "").lower().split()))
            if all((sig == x).sum() < 0.8 * 128 for _, x in kept):
                kept.append((cid, sig))
        want |= {(q, cid, n + 1) for n, (cid, _) in enumerate(kept)}
    assert {tuple(r) for r in QUERIES["near_repeats"](spark, sf).collect()} == want


def test_pools_of_near_repeats_hold_no_texts(spark, monkeypatch):
    """keys and signatures alone go to a pool's task, and its signatures are compared in slices."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (8, 20, 128, 248, 256):
        kept, sig = rng.integers(0, 2, (50, n)).astype("<u4"), rng.integers(0, 2, n).astype("<u4")
        kept[0], kept[1] = sig, 1 - sig
        assert fusion._equal_slots(kept, sig).tolist() == (kept == sig).sum(axis=1).tolist()
    texts = ["one two three four five", "something else is said here", "One  two three four five", None, "", "something else is said here!"]
    rows = [(q, f"c{k}", k + 1, t) for q in (1, None) for k, t in enumerate(texts)] + [(1, "c0", 9, texts[0])]
    df = spark.createDataFrame(rows, "query_id int, cid string, rank int, text string")
    monkeypatch.setattr(fusion, "SIGNATURES", 1)
    out = fusion.drop_near_repeats(df)
    assert sorted(((r["query_id"], r["cid"], r["rank"], r["text"]) for r in out.collect()), key=repr) == sorted([(q, c, n, t) for q in (1, None) for c, n, t in (("c0", 1, texts[0]), ("c1", 2, texts[1]), ("c3", 3, None))], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    pool = next(line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line)
    assert "text" not in pool and "rank" in pool


def test_registered_queries_take_the_operators_permutations(spark, monkeypatch):
    from lodestone.operators import fusion as f
    from lodestone.plans.queries import QUERIES

    seen, whole = [], f.minhash_table
    monkeypatch.setattr(f, "minhash_table", lambda df, id_col, permutations, *rest: seen.append(permutations) or whole(df, id_col, permutations, *rest))
    for name in ("near_repeats", "hybrid_pipeline"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [128, 128]


def test_full_signatures(spark):
    import hashlib
    import struct

    from lodestone.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: struct.unpack("<128I", bytes.fromhex(r["signature"])) for r in QUERIES["minhash_signature_full"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:40]:
        joined = " ".join((texts[i] or "").lower().split())
        hs = {int(hashlib.md5(joined[k : k + 3].encode()).hexdigest(), 16) & 0xFFFFFFFF for k in range(max(1, len(joined) - 2))} if joined else set()
        assert got[i] == tuple(min([((k * 0x5BD1E995 * h + k * 0x1B873593) % ((1 << 61) - 1)) & 0xFFFFFFFF for h in hs] + [0xFFFFFFFF]) for k in range(1, 129))


def test_signatures_of_tables_without_lambdas(spark, tmp_path):
    """F16: the registered query signs whole tables in Python workers, with the slots of the column form."""
    from lodestone.plans.queries import QUERIES

    odd = ["The  Quick\nbrown fox the", None, " ", "ab", "Éa 中文 😀 x\u00a0y", "\u2003x\x1cy\x85z \t\x0b\f\r w", " ".join(f"w{k % 6000}" for k in range(20_000))]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))
    want = {(r["doc_id"], n + 1, x) for r in docs.select("doc_id", similarity.minhash(F.col("text"), 8).alias("s")).collect() for n, x in enumerate(r["s"])}
    signed = QUERIES["minhash_signature"](spark, str(tmp_path))
    assert {tuple(r) for r in signed.collect()} == want
    assert "lambda" not in signed._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_fingerprints_of_tables_without_a_shuffle(spark, tmp_path):
    """a text is fingerprinted where it is read, with the bits of the column form."""
    from lodestone.plans.queries import QUERIES

    odd = ["The  Quick\nbrown fox the", None, " ", "ab", "Éa 中文 😀 x\u00a0y", "\u2003x\x1cy\x85z \t\x0b\f\r w", " ".join(f"w{k % 6000}" for k in range(20_000))]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))
    hashed = QUERIES["simhash_docs"](spark, str(tmp_path))
    assert {tuple(r) for r in hashed.collect()} == {tuple(r) for r in docs.select("doc_id", similarity.simhash(F.col("text"))).collect()}
    assert "Exchange hashpartitioning" not in hashed._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_as_in_sql(spark, tmp_path):
    """rows of one id, or of none, are one document; words part and letters are lowered as the SQL does it."""
    import duckdb

    from lodestone.plans.queries import ORACLE, QUERIES

    odd = [(1, "one two three"), (1, "four Five"), (1, None), (2, "same words"), (2, "same words"), (None, "of no"), (None, "id"), (3, "alone")]
    for name, rows in {"repeated": odd, "odd": [(1, "a\x0bb c"), (2, "\x0b"), (3, "\u0130stanbul"), (4, "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3 \u03a3"), (5, "x\u00a0y\x1cz\x85 W")]}.items():
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        want = con.sql(ORACLE["simhash_docs"]).fetchall()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted((tuple(r) for r in QUERIES["simhash_docs"](spark, path).collect()), key=key) == sorted(want, key=key)


def test_filters(spark):
    df = spark.createDataFrame([("c1", "/A/x.md", ".md", 1), ("c2", "/b/y", None, 2), ("c3", "/b/z.txt", ".txt", None)], "chunk_id string, source_path string, ext string, cluster_id int")
    ids = lambda d: [r["chunk_id"] for r in d.orderBy("chunk_id").collect()]
    assert ids(df.where(filters.predicate({"path_contains": ["a/", "Z"]}))) == ["c1", "c3"]
    assert ids(df.where(filters.predicate({"ext_deny": [".md"]}))) == ["c2", "c3"]
    assert ids(df.where(filters.predicate({"cluster_id": [2, None]}))) == ["c2"]
    assert ids(filters.get(df, limit=1, offset=1)) == ["c2"]
    with pytest.raises(ValueError):
        filters.predicate({"nope": 1})
    with pytest.raises(ValueError):
        filters.predicate({"ext": {"$gt": 1}})


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, cid string, rank int")
    s = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, cid string, rank int")
    got = {r["cid"]: (r["fused_score"], r["rank"]) for r in fusion.rrf(d, s).collect()}
    assert got["b"] == (round(0.7 / 62 + 0.3 / 61, 9), 2) and got["a"] == (round(0.7 / 61 + 0.3 / 63, 9), 1)
    assert fusion.rrf(d, s.limit(0)).count() == 2
    pool = spark.createDataFrame([(1, "a", 1, [1.0, 0.0], [1.0, 0.2]), (1, "b", 2, [1.0, 0.01], [1.0, 0.2]), (1, "c", 3, [0.0, 1.0], [1.0, 0.2])], "query_id int, cid string, rank int, embedding array<double>, query_vector array<double>")
    assert [r["cid"] for r in fusion.mmr(pool, 0.3, 2).orderBy("rank").collect()] == ["b", "c"]
    texts = spark.createDataFrame([(1, "a", 1, "one two three four"), (1, "b", 2, "one two three four"), (1, "c", 3, "nothing alike here")], "query_id int, cid string, rank int, text string")
    assert [r["cid"] for r in fusion.drop_near_repeats(texts, 0.8, 16).orderBy("rank").collect()] == ["a", "c"]
    out, fresh = fusion.cross_rerank(texts.withColumn("query", F.lit("q")), lambda q, t: [float(len(x)) for x in t])
    assert [r["cid"] for r in out.orderBy("rank").collect()] == ["a", "b", "c"] and fresh.count() == 3


def test_search_edge_cases(spark):
    corpus = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, [0.0, 0.0]), (98, None)], "cid long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["cid"] for r in retrieval.knn(corpus, q, 4).orderBy("rank").collect()] == [0, 3, 6, 9]
    assert retrieval.knn(corpus.limit(0), q, 4).count() == 0 and retrieval.knn(corpus, q.limit(0), 4).count() == 0
    assert retrieval.similar_pairs(corpus.where("cid < 4"), 0.999, "cid").collect()[0][:2] == (0, 3)


def test_similar_pairs_of_all_vectors(spark, tmp_path):
    import numpy as np

    from lodestone.plans.queries import QUERIES

    rng = np.random.default_rng(7)
    v = rng.normal(size=(90, 8))
    v[45:] = v[:45] + rng.normal(size=(45, 8)) * 0.5
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(np.round(unit @ unit.T, 6) >= 0.8, 1))}
    got = [(r["id_a"], r["id_b"]) for r in QUERIES["similar_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(bool(a % 20 and b % 20) for a, b in want) > 20


def test_versions(spark):
    rows = [("c1", "/f", 1, False), ("c2", "/f", 2, False), ("c3", "/f", 3, False), ("c4", "/f", 4, True)]
    df = spark.createDataFrame(rows, "chunk_id string, source_path string, version int, is_current boolean").withColumn("ingested_at", F.lit(None).cast("date"))
    assert sorted(r[0] for r in mutations.prune(df, 2).select("chunk_id").collect()) == ["c2", "c3", "c4"]
    assert mutations.prune(df, 0, F.current_date()).count() == 4  # no date: kept
    assert mutations.prune(df).count() == 4


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, " "), (3, None), (4, "ab")], "id int, text string")
    got = [tuple(r) for r in chunking.fixed_chunks(df, "id", size=4, overlap=1).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "abcd", 0, 4), (1, 1, "defg", 3, 7), (1, 2, "ghij", 6, 10), (4, 0, "ab", 0, 2)]
    t = "# A\n\nOne. Two two.\n\n## B\n\nThree three. Four.\n# not a heading"
    c = chunking.structure_chunks_of(t, 15, 0.5)
    assert [(x["text"], x["heading_path"]) for x in c][:2] == [("One. Two two.", ["A"]), ("Three three.", ["A", "B"])]
    assert chunking.structure_chunks_of(t, 1000, 0, max_depth=1)[0]["text"].startswith("One. Two two. ## B")


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "n", x, x) for x in "abcd"], "node_id string, node_type string, label string, source_path string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("d", "c", "x")], "src_id string, dst_id string, edge_type string")
    start = spark.createDataFrame([(1, "c"), (1, "zz")], "query_id int, node_id string")
    assert sorted((r["node_id"], r["hops"]) for r in graph.traverse(nodes, edges, start, 1).collect()) == [("b", 1), ("c", 0), ("d", 1)]
    assert sorted(r["node_id"] for r in graph.traverse(nodes, edges, start, 5, ["r"]).collect()) == ["a", "b", "c"]
    docs = spark.createDataFrame([("/f.md", "[[Note|n]] [x](rel.md) [y](http://z) 10.1234/bare doi:10.1234/abc [[rel.md]]")], "source_path string, text string")
    n, e = graph.extract_links(docs)
    assert sorted(r["label"] for r in n.collect()) == ["10.1234/abc", "Note", "rel.md"] and e.count() == 3


def test_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "a", 0)], "query_id int, doc_id string, score int")
    got = {r["query_id"]: r for r in evaluation.per_query(res, rel, (2,)).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["recall_2"] == 0.5
    assert got[1]["ndcg_2"] == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6) and got[2]["recall_2"] == 0


def test_memory_and_tables(spark):
    assert one(spark, memory.has_all_tags(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a")))) is True
    assert one(spark, stats.budget_status(F.lit(8.0), F.lit(10.0))) == "warning"
    assert maintenance.completion_mode(["chunk_size"], True, True) == "chunk_boundary_update"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, mutations.upsert(old, new, "k").collect()), key=repr) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, mutations.update_columns(old, new, "k").collect())) == [(1, "a"), (2, "b")]
    assert "@misc{on-x" in one(spark, rendering.bibtex(F.lit("On X"), F.lit("A"), F.lit("1999"), F.lit("/f.md")))


def test_html_and_front_matter(spark, tmp_path):
    body, meta = files.html_text("<title>T</title><script>x</script><h2>Head</h2><p>One <b>two</b></p><ul><li>it</ul><table><tr><td>a<td>b</table>")
    assert body == "## Head\n\nOne two\n\n- it\n\na | b" and meta == {"title": "T"}
    assert files.html_text("plain <i>text</i>")[0] == "plain text" and files.html_text(None) == ("", {})
    df = spark.createDataFrame([("---\ntitle: 'A b'\nyear: 2\n---\nBody\n",), ("no --- here",)], "text string")
    got = files.front_matter(df).select("meta", "body").collect()
    assert got[0]["meta"] == {"title": "A b", "year": "2"} and got[0]["body"].strip() == "Body" and got[1]["meta"] == {}
    (tmp_path / "skip").mkdir()
    (tmp_path / "a.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "skip" / "b.txt").write_text("x")
    found = files.decode_text(files.scan_files(spark, [str(tmp_path)], exclude_dirs=("skip",))).collect()
    assert [r["text"] for r in found] == ["é"]


def test_stream(spark, tmp_path):
    from lodestone.streaming.ingest import ingest_batch, stream_documents

    src = tmp_path / "in"
    spark.createDataFrame([(1, "x")], "id int, text string").write.parquet(str(src))
    seen = []
    q = stream_documents(spark, str(src), spark.read.parquet(str(src)).schema, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 1
    listing = spark.createDataFrame([("/a", 1, 2, "h", "text one"), ("/b", 1, 2, "h2", "new text")], "source_path string, mtime_ns long, size long, file_hash string, text string")
    manifest = spark.createDataFrame([("/a", 1, 2, "h", 3)], "source_path string, mtime_ns long, size long, file_hash string, version int").withColumn("updated_at", F.current_timestamp())
    chunks = spark.createDataFrame([("c", "/b", 0, "old", 1, True)], "chunk_id string, source_path string, chunk_index int, text string, version int, is_current boolean").withColumn("ingested_at", F.current_timestamp())
    after, entries = ingest_batch(listing, manifest, chunks, F.current_timestamp())
    assert sorted((r["text"], r["is_current"]) for r in after.collect()) == [("new text", True), ("old", False)]
    assert {r["source_path"]: r["version"] for r in entries.collect()} == {"/a": 3, "/b": 1}


def test_exact_quantiles(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    for n in (1, 2, 7, 3000):
        xs = [rng.choice((0.0, 1.5, rng.gauss(0, 10))) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").repartition(3)
        got = evaluation.exact_quantiles(df, "x", [0.0, 0.37, 0.5, 0.99, 1.0], accuracy=100)
        assert all(abs(v - np.quantile(xs, q)) < 1e-9 for q, v in got.items()), (n, got)
    assert evaluation.exact_quantiles(df.limit(0), "x", [0.5]) == {0.5: None}


def test_baselines_and_usage_export(spark):
    from lodestone.shared import fresh_path

    folder = fresh_path(spark, "baselines")
    run = spark.createDataFrame([("recall_at_10", 0.5), ("mrr", 0.25)], "metric string, value double")
    assert evaluation.list_baselines(spark, folder) == [] and evaluation.load_baseline(spark, "a", folder) is None
    evaluation.save_baseline(run, "a-1", folder)
    evaluation.save_baseline(run.where("metric = 'mrr'"), "a-1", folder)
    evaluation.save_baseline(run, "b", folder)
    assert evaluation.list_baselines(spark, folder) == ["a-1", "b"]
    assert [tuple(r) for r in evaluation.load_baseline(spark, "a-1", folder).select("metric", "value").collect()] == [("mrr", 0.25)]
    with pytest.raises(ValueError):
        evaluation.save_baseline(run, "../x", folder)
    usage = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.5' AS timestamp, 'p,q' AS provider, 'm' AS model, 'chat' AS kind, 3 AS input_tokens, 4 AS output_tokens, CAST(NULL AS DOUBLE) AS cost")
    path = fresh_path(spark, "usage")
    stats.export_usage(usage, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ["timestamp,provider,model,kind,input_tokens,output_tokens,cost", '2024-01-02T03:04:05.500000Z,"p,q",m,chat,3,4,']


def test_enrichment_stages(spark):
    chunks = spark.createDataFrame([("c", None, None, None)], "chunk_id string, version int, is_current boolean, node_type string")
    out, done = maintenance.enrich(chunks)
    assert done == ["defaults", "node_type"] and out.first()["node_type"] == "chunk"
    out, done = maintenance.enrich(chunks, only=["summaries"], models={"summaries": lambda df: df.withColumn("summary", F.lit("s"))})
    assert done == ["summaries"] and out.first()["summary"] == "s"
    for name in ("summaries", "clusters", "graph", "tags"):
        with pytest.raises(ValueError, match=name):
            maintenance.enrich(chunks, only=[name])


def test_file_metadata(spark, tmp_path):
    from lodestone.sources import files

    (tmp_path / "A.TXT").write_text("abc")
    r = files.file_metadata(spark, [f"{tmp_path}/A.TXT"]).first()
    assert (r["size_bytes"], r["ext"]) == (3, ".txt") and r["path"].endswith("/A.TXT") and "T" in r["mtime_iso"]
    with pytest.raises(Exception):
        files.file_metadata(spark, [f"{tmp_path}/none"]).collect()
    with pytest.raises(ValueError):
        files.file_metadata(spark, [" "])
