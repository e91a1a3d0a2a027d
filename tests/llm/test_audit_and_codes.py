"""Filter audit, BPE with word ends and vector codes against brute force: nulls, ties, repeats, long and empty texts, empty tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, vector_codes, word_bpe
from lodestone.llm import queries as Q

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
CLASHES = ("part", "mask", "digest", "first", "n", "good", "ids", "n_tokens", "v", "code", "error", "of_label", "text_")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- op11


def audit_by_hand(docs, labels):
    """Every order applied to the documents one after another. docs: (doc_id, text, source)."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            out.add("C")
        if re.search(r"[#$%&*|]", text):
            out.add("D")
        if i is not None and i > smallest[text]:
            out.add("E")
        return out

    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((i, fails(i, t or "")))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                failing = [m for m in members if f in m[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in failing), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    docs = []
    for i in range(120):
        words = [rng.choice(["alpha", "beta", "Gamma", "DELTA", "e5", "é", "x#y", "|"][: rng.randint(2, 8)]) + (str(rng.randint(0, 99)) if i % 2 else "") for _ in range(rng.choice([5, 150, 199, 200, 260]))]
        docs.append((i, " ".join(words), f"s{i % 3}"))
    copy = docs[5][1]
    docs += [(1000 + i, copy, f"s{i % 4}") for i in range(40)]
    docs += [(7, copy, None), (7, docs[7][1], "s1"), (7, docs[7][1], "s1"), (None, copy, ""), (None, None, None), (200, None, "s0"), (201, "", "s0"), (202, " \n", None), (203, "\U0001d400" * 250, "s1"), (204, "A" * 100 + "b" * 4900, "s1"), (205, "A" * 101 + "b" * 4899, "s1"), (206, "word " * 60_000, "s2")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 300, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None)]
    return docs, labels


def test_audit(spark, audited):
    docs, labels = audited
    frame = clashing(spark.createDataFrame([(i, t, s) for i, t, s in docs], "doc_id long, text string, source string").drop("part")).repartition(3)
    said = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit_filters(frame, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == audit_by_hand(docs, labels)


def test_audit_of_the_tables(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    got = Q.op11_filter_audit(spark, SF).collect()
    want = audit_by_hand(read("documents", "doc_id", "text", "source"), read("labels", "doc_id", "quality", "toxic"))
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want
    assert len(got) == len(want)


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x")], "doc_id long, text string, source string")
    one = filter_audit.audit_filters(docs, labels, {"S": lambda text, words: F.size(words) < 2}, None).collect()
    assert [tuple(r) for r in one] == [("x", "S", 1, 1, 1, 0, 1, 0, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, {"E": lambda text, words: text == ""})


# ---- op12


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.Encoder(public_tokenizers.path(Q.WORDS))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(Q.WORDS))


def odd_texts(library, n, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "e", "t", "h", "i", "n", "s", " ", " ", "'", "’", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "É", "é", "́", "Σ", "ς", "ß", "İ", "K", "1", "½", "日本", "😀", "👍🏽", "<", "/w>", "</w>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "it's", "WE'LL", "한", "﻿", "\x00", "ا", "aaaa", "----", "hahaha"]
    known = [w.removesuffix("</w>") for w in sorted(library.get_vocab())]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return out + [" ".join("".join(rng.sample(known, rng.randint(1, 4))) for _ in range(10)) for _ in range(n // 4)]


def test_encoder(encoder, library):
    texts = odd_texts(library, 4000, 11)
    for text, packed in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert encoder.decode(packed) == library.decode(ids, skip_special_tokens=False), text


def test_pairs_are_judged_as_merging_would(encoder):
    """The check of neighbours says that a pair stays exactly where merging its symbols gives the pair back."""
    v, rng = encoder.vocabulary, random.Random(2)
    paths = {i: p for i, p in v.proposed.items()}
    inner = [i for i, p in paths.items() if p[-1] < 256]
    left, right = rng.choices(inner, k=4000), rng.choices(list(paths), k=4000)
    crossed = v.crossed(np.array(left), np.array(right)).tolist()
    assert 0 < sum(crossed) < 4000
    for x, y, c in zip(left, right, crossed):
        assert (v.merge(v.base[[*paths[x], *paths[y]]].tolist()) != [x, y]) == c


def test_merging_of_short_and_long_words(encoder, monkeypatch):
    v, rng = encoder.vocabulary, random.Random(4)
    words = [[*rng.choices(b"aehnst", k=rng.randint(1, 60)), 256 + rng.choice(b"ens")] for _ in range(300)] + [[97] * 50 + [353]]
    short = [v.merge(v.base[w].tolist()) for w in words]
    monkeypatch.setattr(word_bpe, "_SHORT", 0)
    assert [v.merge(v.base[w].tolist()) for w in words] == short
    assert v.encode_words([b"hello", b"asdfgh"])[2] <= 2


def test_encode_texts(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_PIECES", 50)
    rows = [(i, t) for i, t in enumerate(odd_texts(library, 200, 12))] + [(900, None), (901, ""), (902, " \n\t "), (903, "ab" * 30_000), (904, "It is.\n" * 50_000), (None, "x"), (5, "again"), (5, "again")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    path = public_tokenizers.path(Q.WORDS)
    encoded = word_bpe.encode_texts(docs, path)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"]
    got = word_bpe.decode_ids(encoded, path).join(encoded.withColumnRenamed("ids", "packed"), ["doc_id", "n_tokens"]).distinct().collect()
    want = {(i, tuple(x.ids), library.decode(x.ids, skip_special_tokens=False)) for i, t in rows for x in [library.encode(t or "", add_special_tokens=False)]}
    assert {(r["doc_id"], tuple(np.frombuffer(r["packed"], "<u4").tolist()), r["text"]) for r in got} == {w for w in want if w[0] is not None}
    assert encoded.count() == len(rows) and encoded.where("doc_id IS NULL").first()["n_tokens"] == 1
    assert word_bpe.encode_texts(docs.limit(0), path).collect() == []
    assert word_bpe.decode_ids(spark.createDataFrame([(1, None)], "k int, ids binary"), path).collect()[0]["text"] is None


def test_word_bpe_of_the_tables(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op12_word_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False).encode()
        assert got.pop(r["doc_id"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text).hexdigest())
    assert not got


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        word_bpe.Vocabulary(public_tokenizers.path(Q.VOCABULARY))


# ---- op13


def codes_by_hand(rows, n_parts=8, n_entries=16, rounds=6):
    """rows: (vec_id, vector, label). Plain integers, every entry compared."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in usable]
    first = sorted({i: v for i, v, _ in sorted(((i, v, label) for i, v, label in ints if i is not None), key=lambda r: r[:2], reverse=True)}.items())[:n_entries]
    width = len(first[0][1]) // n_parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in first] for p in range(n_parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in ints:
            for p in range(n_parts):
                held[p, near(v, p)[1]].append(cut(v, p))
        for (p, e), members in held.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, label in ints:
        found = [near(v, p) for p in range(n_parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    of_label = Counter()
    for *_, error, label in out:
        of_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, of_label[label], digest) for i, code, error, label in out), key=repr)


def vectors_of(spark, rows, kind="float"):
    return clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).repartition(3)


def coded(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_vector_codes(spark):
    rng = random.Random(6)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(16)], rng.choice([None, 0, 1, 2])) for i in range(300)]
    rows += [(i, [f32(rng.randint(-2, 2) / 4096) for _ in range(16)], 3) for i in range(1000, 1100)]  # ties between entries
    rows += [(2000 + i, rows[5][1], 1) for i in range(60)] + [(3, [0.5] * 16, 0), (3, [0.5] * 16, 0), (None, [0.25] * 16, None)]
    rows += [(-1, None, 1), (-2, [None] * 16, 1), (-3, [math.nan] * 16, 1), (-4, [math.inf] + [0.0] * 15, 1), (-5, [0.0] * 15 + [-math.inf], 0)]
    rng.shuffle(rows)
    assert coded(vector_codes.compress_vectors(vectors_of(spark, rows))) == codes_by_hand(rows)
    doubles = vectors_of(spark, rows[:50], "double")
    assert coded(vector_codes.compress_vectors(doubles, n_parts=4, n_entries=5, rounds=2)) == codes_by_hand(rows[:50], 4, 5, 2)
    few = [(1, [1.0] * 8, 1), (2, [1.0] * 8, 1), (3, [2.0] * 8, None), (0, [], 1)]
    assert coded(vector_codes.compress_vectors(vectors_of(spark, few))) == codes_by_hand(few)


def test_vector_codes_of_nothing_and_of_bad_vectors(spark):
    got = vector_codes.compress_vectors(vectors_of(spark, [(1, None, 1), (2, [math.nan] * 8, 1)]))
    assert got.collect() == [] and got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress_vectors(vectors_of(spark, [(1, [1.0] * 8, 1)]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(vectors_of(spark, [(1, [1.0] * 9, 1)])).collect()


@pytest.mark.parametrize("width,spread", [(1, 2), (2, 3), (8, 2), (8, 100_000)])
def test_tree_finds_the_lowest_nearest_entry(width, spread):
    rng = np.random.default_rng(width + spread)
    for n in (1, 2, 3, 16, 40):
        entries, points = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (500, width))
        at, best = vector_codes.nearest(vector_codes.vantage_tree(entries), points)
        squared = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (best == squared.min(1)).all() and (at == squared.argmin(1)).all()


def test_vector_codes_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = codes_by_hand(rows)
    assert coded(Q.op13_vector_codes(spark, SF)) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(db.execute(Q.oracle_sql()["op13_vector_codes"]).fetchall(), key=repr) == want
