import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, token_counts
from lodestone.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_line_dedup(spark):
    page = lambda *xs: "<html><body><script>var a='<p>x</p>';</script>" + "".join(f"<p>{x}</p>" for x in xs) + "<!-- c --></body></html>"
    rows = [(k, f"http://A.com/{k}", page("Menu", f"own {k}", "both" if k < 2 else "none")) for k in range(4)]
    rows += [(10, "https://b.org:80/x", page("Menu")), (11, "https://b.org/y", page("Menu")), (12, None, None), (13, "nohost", ""), (2, "http://a.com/2", page("Menu", "own 2", "none")), (None, "http://a.com/z", page("Menu", "&amp;lt; <b>bold</b>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("lines", F.lit(1))
    got = Counter((r["page_id"], r["host"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_site_lines(df).collect())
    lines = {k: [x for x in v] for k, v in {0: ["Menu", "own 0", "both"], 1: ["Menu", "own 1", "both"], 2: ["Menu", "own 2", "none"], 3: ["Menu", "own 3", "none"]}.items()}
    want = Counter()
    for i, u, _ in rows:
        if i in lines:  # 6 pages of a.com: Menu on all, none on 3 (not above half)
            want[(i, "a.com", 3, 1, "\n".join(lines[i][1:]))] += 1
    want[(None, "a.com", 2, 1, "&lt; bold")] += 1
    want[(10, "b.org", 1, 0, "Menu")] += 1
    want[(11, "b.org", 1, 0, "Menu")] += 1
    want[(12, "", 0, 0, "")] += 1
    want[(13, "", 0, 0, "")] += 1
    assert got == want
    assert line_dedup.drop_site_lines(df.limit(0)).count() == 0


def test_op4_query(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, Q.op4_line_dedup(spark, SF).collect())) == sorted(db.execute(Q.oracle_sql()["op4_line_dedup"]).fetchall())


def test_trie_walk():
    rng = random.Random(1)
    scores = defaultdict(float)
    for _ in range(80):
        scores["".join(rng.choice("▁abcé") for _ in range(rng.randint(1, 4)))] = -rng.randint(1, 12) / 2
    for kept in (10**6, 300, 0):  # all nodes, some, none stay
        trie = token_counts.UnigramTrie(dict(scores), -7.0, kept)
        for _ in range(3):  # batches that find nodes of earlier ones
            text = " ".join("".join(rng.choice("abcéz中") for _ in range(rng.randint(1, 14))) for _ in range(400))
            counts = trie.terminal | trie.counts(set(text.encode().split()))
            assert (400, sum(counts[w] for w in text.encode().split())) == token_counts.brute_force(text, dict(scores), -7.0)
        assert len(trie.score) <= max(kept, 1) or kept == 10**6
        assert all(trie.score[n] <= 0 for n in trie.child.values())


def test_op6_query(spark):
    scores, unknown = token_counts.zipf_scores(public_tokenizers.path(Q.PIECES))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, Q.op6_token_counts(spark, SF).collect())) == sorted((i, *token_counts.brute_force(t, scores, unknown)) for i, t in rows)


def test_token_counts(spark):
    path = public_tokenizers.path(Q.PIECES)
    scores, unknown = token_counts.zipf_scores(path)
    rows = [(1, None), (2, ""), (3, "a  b\n c"), (3, "a  b\n c"), (None, "déjà 中文 x"), (4, "word " * 3000), (5, "q" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1))
    want = Counter((i, *token_counts.brute_force(t, scores, unknown)) for i, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(df, path).collect())) == want
    assert token_counts.count_tokens(df.limit(0), path).count() == 0
