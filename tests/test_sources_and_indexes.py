"""Word files, remote pages, languages, migration, hops, and the kept indexes, on small fixtures."""

import io
import os
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import language, migration, retrieval
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import VectorIndex, recall
from lodestone.plans.multi_hop import iterative_hops
from lodestone.plans.pipeline import Config, Pipeline
from lodestone.shared import exists, fresh_path
from lodestone.sources import connector, docx
from lodestone.sources.parsing import parse_files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


# ---- Word files


def word(body, styles="", core=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
        if core:
            z.writestr("docProps/core.xml", core)
    return out.getvalue()


def para(text, style=None, extra=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r>{extra}<w:t>{text}</w:t></w:r></w:p>"


def test_docx(spark):
    styles = '<w:style w:styleId="a"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="b"><w:name w:val="heading 7"/></w:style><w:style w:styleId="c"><w:name w:val="Heading"/></w:style>'
    core = '<cp:c xmlns:cp="x" xmlns:dc="y" xmlns:dt="z"><dc:creator>Ann</dc:creator><dc:title> T </dc:title><dc:subject/><dt:created>2024-01-02T03:04:05Z</dt:created></cp:c>'
    body = (
        para("Top", "a")
        + para("seven", "b")
        + para("bare", "c")
        + "<w:p/>"
        + "<w:tbl><w:tr><w:tc>" + para("in a table") + "</w:tc></w:tr></w:tbl>"
        + f"<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c &amp; ü</w:t></w:r></w:p>"
        + para("next", extra='<w:br w:type="page"/>')
        + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
        + para("last", "Heading 2", "<w:lastRenderedPageBreak/>")
    )
    files = [("whole", word(body, styles, core)), ("plain", word(para("x") + para("y"))), ("empty", word("")), ("null", None), ("text", b"no archive"), ("cut", word(para("x") * 50)[:200])]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("word/document.xml", "<w:document")
    files += [("xml", bad.getvalue())]
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "x")
    files += [("other", other.getvalue())]
    got = {r["path"]: r for r in docx.parse_docx(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["whole"]["text"] == "# Top\nseven\nbare\na\tb\nc & ü\nnext\n## last"
    assert got["whole"]["metadata"] == {"author": "Ann", "title": "T", "creation_date": "2024-01-02T03:04:05Z"}
    assert [(p["page_number"], p["text"]) for p in got["whole"]["pages"]] == [(1, "# Top\nseven\nbare\na\tb\nc & ü"), (2, "next"), (4, "## last")]
    assert (got["plain"]["text"], got["plain"]["pages"], got["plain"]["error"]) == ("x\ny", None, None)
    assert got["empty"]["text"] == "" and got["empty"]["error"] is None
    for name in ("null", "text", "cut", "xml", "other"):
        assert got[name]["text"] == "" and got[name]["error"], name
    assert docx.parse_docx(spark.createDataFrame(files, "path string, content binary").limit(0)).count() == 0


# ---- remote pages


def test_remote_source(spark, monkeypatch):
    here = os.path.dirname(os.path.abspath(__file__))
    monkeypatch.syspath_prepend(here)
    # The tasks' workers are started by this process and import the client by its name.
    spark.sparkContext.addPyFile(os.path.join(here, "recorded_feed.py"))
    import recorded_feed

    found = connector.search(spark, "recorded_feed:client", "x", most=12, page_size=5)
    assert found.rdd.getNumPartitions() == 3
    rows = sorted(found.collect(), key=lambda r: r["place"])
    assert [r["url"] for r in rows] == [f"http://x/{k}" for k in range(12)]
    assert rows[0]["title"] == "http://x/0" and rows[0]["snippet"] == "http://x/0" and rows[0]["score"] == 1.0 and rows[0]["metadata"] == {"source_id": "http://x/0", "n": "0"}
    assert rows[2]["metadata"]["source_id"] == "given" and rows[4]["snippet"] == "T4" and rows[4]["author"] == ["A", "4"]
    years = found.where("year = 2001")
    assert [r["url"] for r in sorted(years.collect(), key=lambda r: r["place"])] == [r["url"] for r in recorded_feed.RESULTS if r["year"] == 2001]
    assert found.where("provider = 'other'").count() == 0 and found.where("provider = 'other'").rdd.getNumPartitions() == 1
    by_fields = connector.search_structured(spark, "recorded_feed:client", {"title": "a", "author": "b", "keywords": ["k", "l"]}, most=3)
    assert by_fields.count() == 3 and by_fields.columns[:3] == ["url", "title", "description"]
    assert connector.query_of(spark, {"title": "a", "author": "b", "year": 2020, "keywords": ["k", "l"]}) == 'title:"a" author:"b" 2020 k l'
    assert connector.search_structured(spark, "recorded_feed:client", {}).count() == 0
    with pytest.raises(Exception, match="no answer"):
        connector.search(spark, "recorded_feed:client", "broken").collect()
    with pytest.raises(Exception, match="client and query"):
        spark.read.format("remote").options(client="recorded_feed:client").load().collect()


def test_word_files_are_read_in_slices(spark, monkeypatch):
    """batches of bounded size, columns that go along, and one writing and one reading of the Word files."""
    from lodestone.plans.queries import QUERIES
    from lodestone.plans.source_queries import _word_file
    from lodestone.shared import BATCH_ROWS

    monkeypatch.setattr(docx, "FILES", 3)
    files = [(f"p{k}", ".docx", _word_file(f"T{k}", "A", [f"line {k}", "x"]) if k % 4 else b"no archive") for k in range(20)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["path"]: r for r in docx.parse_docx(spark.createDataFrame(files, "path string, ext string, content binary").coalesce(1), keep=("ext",)).collect()}
    assert len(got) == 20 and all(r["ext"] == ".docx" for r in got.values())
    assert all(got[f"p{k}"]["text"] == f"## T{k}\nline {k}\nx" and got[f"p{k}"]["error"] is None if k % 4 else got[f"p{k}"]["error"] for k in range(20))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_ROWS
    plan = QUERIES["parsed_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas write(") == plan.count("MapInPandas read(") == 1


# ---- languages


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    profiles = language.fit_profiles(docs.where("doc_id % 2 = 0"))
    assert profiles.groupBy("lang").count().agg(F.max("count")).first()[0] <= language.PROFILE + 1
    odd = [(10_001, None, "x"), (10_002, "", "x"), (10_003, "the short text", "x"), (10_004, "1234567890 1234567890 !!", "x"), (10_005, "   \n" * 700 + "the words come too late to count for this", "x")]
    got = {r["doc_id"]: r["language"] for r in language.detect_languages(docs.where("doc_id % 2 = 1").unionByName(spark.createDataFrame(odd, docs.schema)), profiles).collect()}
    assert [got[i] for i, *_ in odd] == [None] * 5
    told = [(got[r["doc_id"]], r["lang"]) for r in docs.where("doc_id % 2 = 1").collect() if len(r["text"][:2000].strip()) >= 20]
    right = sum(a == b for a, b in told)
    assert right >= 0.9 * len(told), right / len(told)


def test_languages_are_counted_in_batches(spark):
    """counts and means as counted one by one, over more rows than a slice; a text is told without a shuffle."""
    import math
    import re
    from collections import Counter

    words = {"aa": ["lorem", "ipsum", "élan", "xx"], "bb": ["ipsum", "dolor", "中文字", "yy"], None: ["none"]}
    rows = [(k, " ".join(words[lang][(k * 7 + j * j) % len(words[lang])] for j in range(5 + k % 9)) + ("😀!" * (k % 3)), lang) for k in range(1200) for lang in [("aa", "bb", None)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    grams = lambda t: [g for w in re.findall(r"[^\W\d_]+", t) for s in [f" {w} "] for g in (s[i : i + 3] for i in range(len(s) - 2))]
    # A word's first trigram begins with the blank before it, its last ends with the one behind.
    counts = {lang: Counter(g for _, t, x in rows if x == lang and len(t) >= 20 for g in grams(t)) for lang in ("aa", "bb")}
    weights = {(lang, g): math.log((n + 1) / (sum(c.values()) + len(c))) for lang, c in counts.items() for g, n in c.items()}
    rest = {lang: math.log(0.5 / (sum(c.values()) + len(c))) for lang, c in counts.items()}
    profiles = language.fit_profiles(docs)
    got = {(r["lang"], r["gram"]): r["weight"] for r in profiles.collect()}
    want = weights | {(lang, ""): w for lang, w in rest.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    def tell(t):
        own = grams(t) if len(t.strip()) >= 20 else []
        means = [(round(sum(weights.get((lang, g), rest[lang]) for g in own) / len(own), 9), lang) for lang in ("aa", "bb") if any((lang, g) in weights for g in own)]
        return max(means, default=(0, None))[1]

    told = language.detect_languages(docs, profiles)
    assert {r["doc_id"]: r["language"] for r in told.collect()} == {k: tell(t) for k, t, _ in rows}
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()


# ---- migration


def test_migration(spark):
    rows = [(k if k % 10 else None, f"t{k}", {"a": k}, [k, None]) for k in range(300)] + [(7, "same", None, None)] * 100
    source = spark.createDataFrame(rows, "k int, t string, m map<string,int>, a array<int>").repartition(4)
    path = fresh_path(spark, "migration-test")
    first = migration.Migration(source, path, "k", ranges=6)
    part = first.run(most=2)
    assert part.done == 2 and 0 < part.rows < 400 and first.table().count() == part.rows
    # What a lost run left of the next range does not stay.
    source.limit(3).write.mode("overwrite").parquet(f"{path}/rows/range=2")
    done = migration.Migration(source, path, "k", ranges=50).run()
    copy = migration.Migration(source, path, "k").table()
    key = lambda df: sorted(map(repr, df.collect()))
    assert done.done == done.ranges == part.ranges and done.rows == 400 and key(copy) == key(source)
    assert key(migration.Migration(source, path, "k").table()) == key(source) and migration.Migration(source, path, "k").run().rows == 400
    both, counts = migration.migrate({"s": (source, "t"), "none": (source.limit(0), "k")}, fresh_path(spark, "migrate-test"), ranges=3)
    assert key(both["s"]) == key(source) and both["none"].count() == 0 and {r["ok"] for r in counts.collect()} == {True}


# ---- hops


def test_iterative_hops(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"/f{k}", None, f"text {k}", True, [1.0 * (k == j) for j in range(6)]) for k in range(6)], "chunk_id string, source_path string, ext string, text string, is_current boolean, embedding array<double>").withColumns({"heading_path": F.array().cast("array<string>"), "source_name": F.lit("n"), "chunk_index": F.lit(0), "heading": F.lit(None).cast("string")})
    queries = spark.createDataFrame([(k + 1, name, [1.0 * (j == k) for j in range(6)]) for k, name in enumerate(("one", "two", "three"))], "query_id int, query string, embedding array<double>")
    plan = {"one": "'' again ", "again": "more", "two": None, "three": " THREE "}  # a scripted model
    rounds = []

    def follow_up(df):
        rows = df.collect()
        rounds.append(sorted(r["query_id"] for r in rows))
        assert all(len(r["partial"]) <= 500 and r["question"] in ("one", "two", "three") for r in rows)
        return spark.createDataFrame([(r["query_id"], plan.get(r["asked"].strip())) for r in rows], "query_id int, next string")

    embed = lambda df: df.withColumn("embedding", F.when(F.trim("query") == "again", F.lit([0.0, 0.0, 0.0, 1.0, 0.0, 0.0])).otherwise(F.lit([0.0, 0.0, 0.0, 0.0, 1.0, 0.0])))
    run = Pipeline(chunks, Config("dense_only", k=1, dedup_threshold=None, min_relevance=0.0))
    answers, candidates = iterative_hops(run, queries, follow_up, embed, max_hops=3)
    got = {r["query_id"]: (r["hops"], [q.strip() for q in r["questions"]]) for r in answers.collect()}
    assert got == {1: (3, ["one", "again", "more"]), 2: (1, ["two"]), 3: (1, ["three"])}
    assert rounds == [[1, 2, 3], [1]]
    assert [(r["query_id"], r["cid"]) for r in candidates.orderBy("query_id", "rank").collect()] == [(1, "c0"), (1, "c3"), (1, "c4"), (2, "c1"), (3, "c2")]
    once, _ = iterative_hops(run, queries, follow_up, embed, max_hops=1)
    assert {r["hops"] for r in once.collect()} == {1}


# ---- kept indexes


def test_text_index_follows_changes(spark):
    """After every change the index gives the rows that scoring all texts gives."""
    rng = random.Random(1)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice("alpha beta gamma delta the of 42 x9".split()) for _ in range(rng.randint(0, 12)))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "cid long, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "The 42!"), (3, "unknown"), (4, ""), (5, None), (6, "gamma gamma delta")], "query_id int, query string")
    now = {k: text() for k in range(60)}
    path = fresh_path(spark, "text-index-test")
    index = TextIndex.build(frame(now), path, buckets=4)

    def same():
        for operator in ("or", "and"):
            want = retrieval.bm25(frame(now), queries, 5, operator=operator).collect()
            got = TextIndex.open(spark, path).search(queries, 5, operator=operator).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        assert sorted(r["cid"] for r in index.documents().collect()) == sorted(now)
        assert index.totals()[0] == len(now)

    same()
    change = {k: text() for k in (*range(0, 60, 7), *range(100, 110))}
    index.put(frame(change))
    now |= change
    index.remove(spark.createDataFrame([(k,) for k in (1, 2, 100, 5000)], "cid long"))
    for k in (1, 2, 100):
        del now[k]
    same()
    index.put(frame({1: "alpha back"}))
    now[1] = "alpha back"
    index.compact()
    same()
    with pytest.raises(FileExistsError):
        TextIndex.build(frame(now), path)
    with pytest.raises(FileNotFoundError):
        TextIndex.open(spark, path + "-none")
    # A batch without its totals was never finished: it is not read, and the next one takes its number.
    at = index._now()
    frame({999: "alpha"}).select("cid", F.lit(1).alias("length")).write.parquet(f"{at}/documents/batch=1")
    same()
    index.put(frame({200: "delta"}))
    now[200] = "delta"
    same()
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters" in plan


def test_text_index_counts_where_texts_are_read(spark, monkeypatch):
    """postings come without a shuffle, documents that reach over batches, slices or blocks of queries are
    scored whole, and what is gone is found alike with and without a broadcast."""
    from lodestone.operators import text_index

    rng = random.Random(2)
    now = {f"d{k:04}": " ".join(f"t{int(rng.random() ** 2 * 60)}" for _ in range(rng.randint(0, 80))) for k in range(900)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "cid string, text string")
    queries = spark.createDataFrame([(k, " ".join(f"t{rng.randint(0, 62)}" for _ in range(1 + k % 4))) for k in range(40)], "query_id int, query string")
    written = []
    whole = TextIndex._write_postings
    monkeypatch.setattr(TextIndex, "_write_postings", lambda self, postings, *rest: written.append(postings._jdf.queryExecution().executedPlan().toString()) or whole(self, postings, *rest))
    index = TextIndex.build(frame(now), fresh_path(spark, "text-index-size"), buckets=4)
    change = {k: "t1 t2 " + now[k] for k in list(now)[::3]}
    index.put(frame(change))
    now |= change
    assert len(written) == 2 and not any("Exchange" in plan for plan in written)
    monkeypatch.setattr(text_index, "PAIRS", 64)
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (1 << 20, 0):
            monkeypatch.setattr(text_index, "MOST_GONE", most)
            for operator in ("or", "and"):
                want = retrieval.bm25(frame(now), queries, 5, operator=operator).collect()
                assert sorted(map(tuple, index.search(queries, 5, operator=operator).collect())) == sorted(map(tuple, want)) and want
            live = index.postings(["t1"])._jdf.queryExecution().executedPlan().toString()
            assert not most or "BroadcastHashJoin" in live
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batches = [pa.record_batch({"cid": pa.array(x, pa.int64())}) for x in ([1, 1], [], [1], [1, 2, 2, 3], [3], [4])]
    assert [(rows.column(0).to_pylist(), starts.tolist()) for rows, starts in text_index._whole_documents(iter(batches))] == [([1, 1, 1, 1, 2, 2], [0, 4, 6]), ([3, 3], [0, 2]), ([4], [0, 1])]


def test_vector_index(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 1, (12, 16))
    points = np.concatenate([c + rng.normal(0, 0.25, (50, 16)) for c in centers]).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(points)] + [(5000, [0.0] * 16), (5001, None), (5002, points[3].tolist())]
    df = spark.createDataFrame(rows, "cid long, embedding array<float>")
    queries = spark.createDataFrame([(k, points[k * 31].tolist()) for k in range(12)] + [(90, [0.0] * 16), (91, None)], "query_id int, embedding array<float>")
    path = fresh_path(spark, "vector-index-test")
    index = VectorIndex.build(df.where("cid % 4 != 1"), path, lists=12, sample=300).add(df.where("cid % 4 = 1"))
    truth = retrieval.knn(df, queries, 10)
    found = index.search(queries.where("query_id < 90"), 10)
    shares = [r["recall"] for r in recall(found, truth.where("query_id < 90")).collect()]
    assert len(shares) == 12 and sum(shares) / len(shares) >= 0.9 and index.probes < 12
    key = lambda d: sorted((r["query_id"], r["rank"], r["cid"], round(r["distance"], 8)) for r in d.collect())
    assert key(index.search(queries, 10, exact=True)) == key(truth)
    assert index.rows().count() == len(rows) - 1 and exists(spark, f"{path}/lists")
    one = index.search(queries.where("query_id = 0"), 5, probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*list", one._jdf.queryExecution().executedPlan().toString())
    assert index.search(queries.limit(0), 5).count() == 0
    with pytest.raises(FileExistsError):
        VectorIndex.build(df, path)
    empty = VectorIndex.build(df.limit(0), fresh_path(spark, "vector-index-empty"))
    assert empty.search(queries, 3).count() == 0
    with pytest.raises(ValueError):
        empty.add(df)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_the_tables(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(vectors, fresh_path(spark, "vector-index-recall"), id_col="vec_id")
    shares = [r["recall"] for r in recall(index.search(queries, 10), retrieval.knn(vectors, queries, 10, id_col="vec_id")).collect()]
    assert sum(shares) / len(shares) >= 0.9


def test_parse_files(spark):
    files = [
        ("/a.DOCX", ".DOCX", word(para("Head", "Heading 1") + para("x"))),
        ("/b.docx", ".docx", b"no"),
        ("/c.html", ".html", "<title>T</title><meta name='author' content=''><h2>Hé</h2><p>p</p>".encode()),
        ("/d.md", ".md", b"---\ntitle: X\nempty:\n---\n\nbody\n"),
        ("/e.md", ".md", b"plain"),
        ("/f.txt", ".txt", b"caf\xe9"),
        ("/g.xyz", ".xyz", "ü".encode()),
        ("/h.txt", ".txt", None),
        ("/i.pdf", ".pdf", b"%PDF"),
        ("/j", None, b"bare"),
    ]
    got = {r["path"]: r for r in parse_files(spark.createDataFrame(files, "path string, ext string, content binary")).collect()}
    text = {k: r["text"].strip() for k, r in got.items()}
    assert text == {"/a.DOCX": "# Head\nx", "/b.docx": "", "/c.html": "## Hé\n\np", "/d.md": "body", "/e.md": "plain", "/f.txt": "café", "/g.xyz": "ü", "/h.txt": "", "/i.pdf": "", "/j": "bare"}
    assert got["/c.html"]["metadata"] == {"title": "T"} and got["/d.md"]["metadata"] == {"title": "X"}
    assert {k for k, r in got.items() if r["error"]} == {"/b.docx", "/i.pdf"}
