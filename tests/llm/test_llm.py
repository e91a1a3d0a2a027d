"""The training-data operators against brute force on small tables, with nulls, ties, repeats, long and empty texts."""

import hashlib
import io
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import components, curriculum, decontaminate, license_scan, ngram_join, private_data, quality_rules, substring_dedup, token_binary
from lodestone.llm import queries as Q
from lodestone.llm.scratch import fresh_path, materialize

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None) for i, t in rows], SCHEMA)
    for clash in ("id", "row", "node", "n", "words", "base", "size", "mix", "metrics_", "held", "__x"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def passage(rng, n, vocabulary=200):
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, other = passage(rng, 60), passage(rng, 90)
    out = []
    for i in range(60):
        words = passage(rng, rng.randint(0, 120))
        if i % 3 == 0:
            words += shared[rng.randint(0, 8) :]
        if i % 5 == 0:
            words = list(other)
            words[rng.randrange(90)] = f"x{i}"
        out.append((i, " ".join(words) + ("\n" if i % 2 else "\t")))
    long = " ".join(passage(rng, 20_000, 100_000))
    return out + [(100, None), (101, ""), (102, " \n "), (103, long), (104, long), (105, "a a a a a a a"), (106, " ".join(["z"] * 300)), (107, " ".join(["z"] * 280)), (108, "É é \x1f Ünï \x00 ctl")]


def docs_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(xs):
    return hashlib.sha256(xs.encode()).hexdigest()


def digest1(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept_text"])) for r in df.collect())


def test_substring_dedup(spark, rows):
    assert digest1(substring_dedup.remove_repeated_passages(table(spark, rows))) == sorted(substring_dedup.brute_force(rows))
    some = rows[:30] + rows[:3] + [(None, rows[3][1])]
    got = substring_dedup.remove_repeated_passages(table(spark, some), size=20, max_cells=1 << 9)  # several slices
    key = lambda xs: sorted(xs, key=repr)
    assert key(tuple(x) for x in [(r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept_text"])) for r in got.collect()]) == key(substring_dedup.brute_force(some, 20))
    assert substring_dedup.remove_repeated_passages(table(spark, rows[:1]).limit(0)).count() == 0


def test_op1_query(spark):
    got = sorted(map(tuple, Q.op1_substring_dedup(spark, SF).collect()))
    assert got == sorted(substring_dedup.brute_force(docs_of(spark)))


def base_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_private_data(spark):
    odd = [(1, "a@b.c_d@e.f x@y.z. a@b"), (2, "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3"), (3, "4111 1111 1111 1111 and 4111-1111-1111-1112 " + "1 " * 3000), (5, "+1 (017) 555-7713 +123 +1" + "2" * 20), (6, None), (7, ""), (7, "x@y.zz"), (8, "a@b" + ".c" * 20000), (9, "é😀 x@y.zz 😀 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""), (10, "9" * 30000), (None, "x@y.z")]
    got = private_data.find_private_data(table(spark, odd)).select("doc_id", private_data.joined(F.col("base")).alias("b"), private_data.joined(F.concat("base", "added")).alias("s")).collect()
    want = Counter((i, ",".join(f"{private_data.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t))) for i, t in odd)
    assert Counter((r["doc_id"], r["b"]) for r in got) == want
    assert all(set(r["b"].split(",")) <= set(r["s"].split(",")) for r in got if r["b"])
    assert private_data.find_private_data(table(spark, odd).limit(0)).count() == 0
    rows = Q.op2_private_data(spark, SF).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {i: sha(",".join(f"{private_data.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t))) for i, t in docs_of(spark)}


def test_private_data_of_many_matches(spark):
    texts = [(1, "x " + " ".join(f"a{k}@b.co" for k in range(5000))), (2, "é " + " ".join(f"1.2.3.{k % 256}" for k in range(1000))), (3, " ".join(["a@b.c"] * private_data._BLOCK)), (4, " ".join(["a@b.c"] * (private_data._BLOCK + 1)))]
    got = {r["doc_id"]: r["b"] for r in private_data.find_private_data(table(spark, texts)).select("doc_id", private_data.joined(F.col("base")).alias("b")).collect()}
    assert got == {i: ",".join(f"{private_data.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t)) for i, t in texts}


def test_added_private_data(spark):
    """Precision and recall of the added spans on texts whose personal data are known; nothing is labelled for the operator."""
    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    last = ("Miller", "Schmidt", "Garcia", "Dubois", "Fischer", "Okafor", "Tanaka", "Novak")
    good = {
        "number": lambda: (rng.choice(("call ", "phone: ", "ssn ", "")), rng.choice((f"{digits(3)}-{digits(2)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"))),
        "secret": lambda: (rng.choice(("token: ", "api_key=", "password ", "")), rng.choice((hexes(40), "ghp_" + hexes(36), "AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(15)) + "9"))),
        "address": lambda: (rng.choice(("mail ", "contact: ", "")), f"{rng.choice(('bob', 'eve.x', 'info'))} [at] {words(1)} [dot] {rng.choice(('com', 'org', 'de'))}"),
        "name": lambda: (rng.choice(("Mr. ", "Dr. ", "name: ", "")), f"{rng.choice(private_data.FIRST_NAMES[:60])} {rng.choice(last)}"),
    }
    bad = {
        "number": lambda: (rng.choice(("page ", "")), rng.choice((f"2024-0{digits(1)}-1{digits(1)}", digits(9), "1111111111", f"{digits(4)}.{digits(5)}"))),
        "secret": lambda: ("the ", f"{'long-winded-' * 2}title{digits(2)}"),
        "name": lambda: (rng.choice(("in ", "the ")), rng.choice(("The House", "Main Street", "State University", "Der Wagen", "New Haven Road"[4:]))),
    }
    rows, want = [], Counter()
    for i in range(600):
        text = words(4)
        for _ in range(3):
            kind = rng.choice(tuple(good))
            source = good if kind == "address" or rng.random() < 0.5 else bad
            before, span = source[kind]()
            text += " " + before
            if source is good:
                want[i, kind, len(text), len(text) + len(span)] += 1
            text += span + " " + words(3)
        rows.append((i, text))
    got = Counter((r["doc_id"], x["kind"], x["start"], x["end"]) for r in private_data.find_private_data(table(spark, rows)).collect() for x in r["added"])
    for kind in private_data.ADDED_KINDS:
        of_kind = lambda c: {x for x in c if x[1] == kind}  # noqa: B023, E731
        right = of_kind(got) & of_kind(want)
        assert len(right) >= 0.9 * len(of_kind(got)) and len(right) >= 0.8 * len(of_kind(want)), (kind, len(right), len(of_kind(got)), len(of_kind(want)))


def test_texts_without_private_data(spark):
    """Capitalised words that are no names, long identifiers and plain numbers: hardly anything may be added."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(3, 8))).title()
    rows = []
    for i in range(300):
        words = [rng.choice((word().lower(), word(), "Und Und", "Sich Sich", "General Public", "Die Welt", "the", "2024", "some_long_identifier_of_code", "12.500")) for _ in range(60)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"signed {name} Jackson, call 030 555 1{i:03d}") for i, name in enumerate(private_data.FIRST_NAMES[:60])]
    added = [(r["doc_id"], x["kind"]) for r in private_data.find_private_data(table(spark, rows)).collect() for x in r["added"]]
    names = [i for i, kind in added if kind == "name"]
    assert len([i for i in names if i >= 1000]) >= 54
    assert len([i for i in names if i < 1000]) <= 0.1 * len(names)
    only = [(i, t) for i, t in rows if i < 1000]
    assert sum(len(r["added"]) for r in private_data.find_private_data(table(spark, only)).collect()) <= 3
    same = [(i, "x Aaa Bbb y") for i in range(50)]  # one pattern of votes only
    assert sum(len(r["added"]) for r in private_data.find_private_data(table(spark, same)).collect()) == 0


def test_names_of_the_tables(spark):
    """The driver's documents hold no first name before a capitalised word but by chance: names are no longer any such pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = [texts[r["doc_id"]][x["start"] : x["end"]] for r in private_data.find_private_data(docs).collect() for x in r["added"] if x["kind"] == "name"]
    sound = [x for x in found if x.split(" ")[0] in private_data.FIRST_NAMES]
    assert len(sound) >= 0.9 * len(found)


def test_reliability():
    """EM finds the labelers that votes were drawn from, and its posterior tells true spans from others."""
    rng = random.Random(22)
    truth = [(0.05, 0.7), (0.02, 0.4), (0.1, 0.6)]  # chance of a vote for, given no and yes; the last labeler votes against
    drawn, right = Counter(), Counter()
    for _ in range(20_000):
        yes = rng.random() < 0.3
        votes = (*(int(rng.random() < p[yes]) for p in truth), -int(rng.random() < (0.5, 0.05)[yes]))
        drawn[votes] += 1
        right[votes] += yes
    prior, given = private_data.estimate_reliability(sorted(drawn.items()))
    assert abs(prior - 0.3) < 0.05 and all(abs(g[1][k] - p[k]) < 0.06 for g, p in zip(given, truth) for k in (0, 1))
    for votes, n in drawn.items():
        if n > 500:
            assert abs(1 / (1 + np.exp(-private_data.log_odds(votes, prior, given))) - right[votes] / n) < 0.1
    assert private_data.estimate_reliability([]) [0] == 0.5


def water_fill(sizes):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[n % 3] for n, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        share = sum(weight[k] for k in names if k not in full) or 1
        target = {k: 3 * sizes[k] if k in full else left * weight[k] / share for k in names}
        new = {k for k in names if k not in full and target[k] > 3 * sizes[k]}
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("weights", [{"a": 40, "b": 1, "c": 2, None: 30}, {"s0": 3, "s1": 3, "s2": 3}])
def test_mix(spark, weights):
    rows, n = [], 0
    for s, many in weights.items():
        for _ in range(many):
            n += 1
            rows.append((n, " ".join(["w"] * (n % 13)), "en", s))
    rows.append((None, None, "en", "a" if "a" in weights else "s0"))
    plan = curriculum.plan_mix(spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)), buckets=8)
    got = plan.select("doc_id", "source", "mix.*", curriculum.first_position(F.col("mix")).alias("at")).collect()
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = water_fill(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert r["at"] is None or 0 <= r["at"] <= 1
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert curriculum.plan_mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixed_order(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "ab"[i % 2]) for i in range(40)], SCHEMA)
    out = curriculum.mixed_order(docs)
    assert out.columns == docs.columns and abs(out.count() - 40) <= 2
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, curriculum.mixed_order(docs).collect()))


def test_mix_names(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "ab"[i % 2]) for i in range(40)] + [(None, None, None, None), (7, "a b c", "en", "b")], SCHEMA)
    want = sorted((r["doc_id"] or -1, r["text"] or "") for r in curriculum.mixed_order(docs).collect())
    named = docs
    for clash in ("target", "source_size", "offset", "tilt", "mix", "__mix", "__pass", "__at", "size", "key", "bucket", "inside", "doc", "id", "start", "taken", "words", "none", "name", "rank", "weight", "key_source"):
        named = named.withColumn(clash, F.lit("own"))
    out = curriculum.mixed_order(named)
    assert out.columns == named.columns and sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == want
    assert {tuple(r[4:]) for r in out.collect()} == {("own",) * (len(named.columns) - 4)}
    plan = curriculum.plan_mix(named)
    assert plan.columns[:-1] == named.columns and {r["mix"] for r in plan.collect()} == {"own"}
    assert curriculum.mixed_order(named.limit(0)).count() == 0


def test_op3_query(spark):
    """Every source takes its target, in reruns alike; positions follow the inverse of the source's cumulative weight."""
    docs = {r["doc_id"]: (len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op3_curriculum_mix(spark, SF).collect()
    sizes, taken, words = Counter(), Counter(), Counter()
    for n, source in docs.values():
        sizes[source] += n
    target = water_fill(sizes)
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    assert len(rows) == len(docs) and rows == Q.op3_curriculum_mix(spark, SF).collect()
    for r in sorted(rows, key=lambda r: r["position"] is None):  # in training order, those that are not read last
        n, source = docs[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source] and abs(r["target"] - target[source]) < 1e-6 * (1 + target[source]) and 0 <= r["taken"] <= 3 * n
        if r["position"] is not None:
            tilt, t = curriculum.TILTS[names.index(source) % 3], r["position"]
            assert abs((1 - tilt) * t + tilt * t * t - min(1, words[source] / max(1, r["target"]))) < 1e-9
        words[source] += n
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_automaton():
    rng = random.Random(1)
    for _ in range(200):
        v, w = rng.choice([2, 3, 5]), rng.choice([3, 4, 5])
        items = [(i, " ".join(rng.choice("abcdef"[:v]) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        docs = [(i, " ".join(rng.choice("abcdefg"[: v + 1]) for _ in range(rng.randint(0, 30)))) for i in range(6)]
        auto = decontaminate.SuffixAutomaton([(str(k), decontaminate.item_words(t)) for k, t in items if decontaminate.item_words(t)], w)
        for (_, t), want in zip(docs, decontaminate.brute_force(docs, items, w)):
            spans, found = auto.scan(decontaminate.item_words(t))
            assert (sum(b - a for a, b in spans), sha(",".join(sorted(auto.item_ids[k] for k in found)))) == (want[2], want[4])


class Loaded:
    """A broadcast block as a worker has it: read from disk when it is asked for."""

    held = most = reads = 0

    def __init__(self, made):
        self._path, self.made = "block", made

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self.__dict__["_value"] = self.made
            Loaded.reads += 1
        Loaded.held = sum("_value" in b.__dict__ for b in Loaded.every)
        Loaded.most = max(Loaded.most, Loaded.held)
        return self.made


@pytest.mark.parametrize("n_blocks", [1, 3, 12])
def test_blocks_are_held_one_at_a_time(n_blocks):
    """Whatever the number of blocks, a worker holds one; texts that the gate stops load none."""
    rng = random.Random(n_blocks)
    items = [(k, " ".join(passage(rng, rng.choice((3, 13, 40)), 500))) for k in range(24)]
    words = [((False, str(k)), decontaminate.item_words(t)) for k, t in items]
    gate = decontaminate.WindowGate(13)
    for _, w in words:
        gate.add(w)
    gate.close()
    Loaded.every = [Loaded(decontaminate.SuffixAutomaton(words[k::n_blocks], 13)) for k in range(n_blocks)]
    Loaded.most = Loaded.reads = 0
    clean = pa.array([" ".join(passage(rng, 300, 10**6)) for _ in range(20)])
    assert [x[1:] for x in decontaminate._scan_batch(clean, Loaded.every, gate)] == [([], [])] * 20 and Loaded.reads == 0
    docs = [(k, " ".join(passage(rng, 50, 10**6)) + " " + items[k % 24][1] + (" Ünï x" if k % 2 else "")) for k in range(40)] + [(40, None), (41, ""), (42, items[0][1][:-1])]
    got = decontaminate._scan_batch(pa.array([t for _, t in docs]), Loaded.every, gate)
    want = decontaminate.brute_force(docs, items)
    assert [(n, sum(b - a for a, b in spans), sha(",".join(names))) for n, spans, names in got] == [(w[1], w[2], w[4]) for w in want]
    assert Loaded.most == 1 and Loaded.reads == n_blocks


def test_gate_misses_no_window():
    rng = random.Random(8)
    for _ in range(200):
        window = rng.choice([2, 3, 5])
        items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))) for i in range(rng.randint(0, 4))]
        docs = [(i, rng.choice(["", " ", "a-"]).join(rng.choice("aBcdef") for _ in range(rng.randint(0, 20)))) for i in range(8)]
        gate = decontaminate.WindowGate(window)
        for _, t in items:
            gate.add(decontaminate.item_words(t))
        counts, hit = gate.close().look(pa.array([t for _, t in docs]))
        want = decontaminate.brute_force(docs, items, window)
        assert counts.tolist() == [w[1] for w in want] and hit.tolist() == [w[2] > 0 for w in want]


def test_op5_query(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, Q.op5_decontaminate(spark, SF).collect())) == sorted(decontaminate.brute_force(docs_of(spark), bench))


def test_op9_query(spark):
    assert sorted(map(tuple, Q.op9_ngram_join(spark, SF).collect())) == sorted(ngram_join.brute_force(docs_of(spark)))


def test_decontaminate(spark, rows):
    items = [(1, "A b-C d e f g h i j k l m n o"), (2, "short One"), (3, None), (4, ""), (2, "other"), (10, rows[0][1]), (None, "short one"), (11, "one"), (12, "say short")]
    docs = [*rows[:20], (200, "x a b c d e f g h i j k l m y"), (201, "say short one"), (202, None), (203, "other " + "pad " * 400), (203, "other " + "pad " * 400), (None, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    for most in (1 << 20, 60):
        got = decontaminate.find_contamination(table(spark, docs), bench, block_bytes=most)
        key = lambda xs: sorted(xs, key=repr)
        assert key((r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), sha(",".join(r["item_ids"])), r["contaminated"]) for r in got.collect()) == key(decontaminate.brute_force(docs, items))
    named = bench.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))).unionByName(bench.where("item_id IS NULL").withColumn("item_id", F.lit(None).cast("string")))
    both = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_contamination(table(spark, docs), named).collect()}
    assert both[201] == ["11", "12", "2", "null", "null"]  # the item called null and the one without an id
    kept = decontaminate.drop_contaminated(table(spark, docs), bench)
    assert kept.columns == table(spark, docs).columns and kept.count() == sum(not x[5] for x in decontaminate.brute_force(docs, items))
    assert all(not r["contaminated"] for r in decontaminate.find_contamination(table(spark, docs), bench.limit(0)).collect())


def quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, rows):
    rows = [*rows, (300, "a\nb\na\n\n \na "), (301, "x | y\r\nx | y\r\n")]
    got = quality_rules.apply_quality_rules(table(spark, rows)).collect()
    for r in got:
        m = r["metrics"]
        want = quality(dict(rows)[r["doc_id"]])
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert len(got) == len(rows)
    assert quality_rules.apply_quality_rules(table(spark, rows).limit(0)).count() == 0
    rng = random.Random(2)
    clean = [(i, " ".join(passage(rng, 200, 5000))) for i in range(300)]
    junk = [(i, " ".join(w + "&&&" for w in passage(rng, 200, 5000))) for i in range(300, 310)]
    kept = quality_rules.keep_good(table(spark, clean + junk))
    assert {r["doc_id"] for r in kept.collect()} == set(range(300)) and kept.columns == table(spark, clean).columns


def quality_by_quantiles(rows):
    """(kept, near, judged) of rows (id, text, lang, source) by exact quantiles; near: within the sketch's error of a bound."""
    values, judged = {}, {}
    for i, t, lang, source in rows:
        n_words, word_chars, n_symbols, n_dup, n_repeat, failed = quality(t)
        n_lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r"))
        v = dict(symbol_share=n_symbols / max(word_chars, 1), dup_line_share=n_dup / max(n_lines, 1), repeat_share=n_repeat / max(n_words, 1), word_length=word_chars / max(n_words, 1))
        judged[i] = (lang, source, v, failed)
        if not failed:
            for key in ((lang, source), (lang,), ()):
                values.setdefault(key, []).append(v)

    def bounds(key):
        out = {}
        for k, ends in quality_rules.TAILS.items():
            xs = sorted(v[k] for v in values[key])
            q = lambda p: next(x for n, x in enumerate(xs, 1) if n >= p * len(xs))
            low, high = ends
            if low is not None:
                out[f"{k}_lower"] = q(low) - quality_rules.REACH * (q(0.5) - q(low))
            some = [x for x in xs if x > 0]
            if high is not None:  # none if nothing is above zero
                at = q(high) or (min(some) * (1 - 1e-9) if some else None)  # past zeros all that is above zero is outside
                middle = some[math.ceil(len(some) / 2) - 1] if some else None
                out[f"{k}_upper"] = None if at is None else at + quality_rules.REACH * max(0, at - middle)
        return out

    def leaning(key):
        own, n = bounds(key), len(values[key])
        up = leaning(key[:-1]) if key else own
        mean = lambda a, b: b if a is None else a if b is None else (n * a + quality_rules.PRIOR * b) / (n + quality_rules.PRIOR)
        return {b: mean(own[b], up[b]) for b in own}

    limits, near, kept = {key: leaning(key) for key in values if len(key) == 2}, set(), set()
    for i, (lang, source, v, failed) in judged.items():
        beyond = []  # how far outside each bound the document is, in the sketch's error
        for b, limit in ({} if failed else limits[(lang, source)]).items():
            if limit is None:
                continue
            x = v[b.rsplit("_", 1)[0]]
            error = (2 + 2 * quality_rules.REACH) * quality_rules.ERROR * max(x, limit) + 1e-12
            beyond.append((x - limit if b.endswith("upper") else limit - x) / error)
        if not failed and max(beyond, default=0) <= 0:
            kept.add(i)
        if beyond and abs(max(beyond)) <= 1:
            near.add(i)
    return kept, near, judged


def test_quality_thresholds(spark):
    """Groups of different habits get thresholds of their own for every metric, and verdicts follow exact quantiles within the sketch's error."""
    rng = random.Random(12)
    rows, habits = [], {("en", "a"): (0.00, 0.0, 4), ("en", "b"): (0.20, 0.3, 7), ("de", "a"): (0.05, 0.6, 10), (None, None): (0.1, 0.1, 5)}
    for (lang, source), (symbols, lines, length) in habits.items():
        for _ in range(12 if lang is None else 150):
            words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, length + rng.randint(-2, 2)))) for _ in range(rng.randint(60, 120))]
            words = [w + "#" * (rng.random() < symbols) for w in words]
            same = [" ".join(rng.choice("uvwxyz") for _ in range(3)) for _ in range(3)]
            text = "\n".join(" ".join(words[k : k + 5]) if rng.random() > lines * rng.random() else rng.choice(same) for k in range(0, len(words), 5))
            rows.append((len(rows), text, lang, source))
    rows += [(len(rows) + k, " ".join(f"w{rng.randrange(10**6)}" + "&" * 6 for _ in range(90)), "en", "a") for k in range(3)]
    rows += [(len(rows), None, "en", "a"), (len(rows) + 1, "", None, "b"), (len(rows) + 2, "only group " * 5, "fr", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    measured = materialize(quality_rules.with_metrics(docs), "m")
    found = {(r["lang"], r["source"]): r for r in quality_rules.adaptive_thresholds(measured, "lang", "source").collect()}
    assert found.keys() == habits.keys()
    for bound in quality_rules._BOUNDS:
        assert len({round(r[bound], 3) for r in found.values()}) == len(habits), bound

    kept, near, judged = quality_by_quantiles(rows)
    got = {r["doc_id"] for r in quality_rules.apply_quality_rules(docs).where("kept").collect()}
    assert got - near == kept - near and len(near) < len(rows) / 4 and len(kept - near) > len(rows) / 2
    assert len({i for i, x in judged.items() if not x[3]} - kept - near) >= 3


def test_quality_of_the_tables(spark):
    """On the driver's documents every bound differs between groups, and verdicts follow exact quantiles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = materialize(quality_rules.with_metrics(docs), "m")
    found = quality_rules.adaptive_thresholds(measured, "lang", "source").collect()
    for bound in quality_rules._BOUNDS:
        given = [r[bound] for r in found if r[bound] is not None]
        most = Counter(given).most_common(1)[0][1] if given else 0
        assert most <= len(found) / 4, (bound, most, len(found))
    kept, near, judged = quality_by_quantiles([tuple(r) for r in docs.collect()])
    got = {r["doc_id"] for r in quality_rules.apply_quality_rules(docs).where("kept").collect()}
    assert got - near == kept - near and len(near) < len(judged) / 10
    labels = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    sound = {i for i in labels & set(judged) if not judged[i][3]}
    assert len(sound & got) >= 0.95 * len(sound)


def test_quality_names(spark):
    docs = table(spark, [(1, "w " * 60), (2, None), (3, " ".join(f"a{k}" for k in range(90)))])
    own = ["base_failed", "kept", "metrics", "metric", "bucket", "n", "m", "bounds", "lang_", "__lang", "__source", "__bounds", "__words", "__lines", "all_of", "parent", "of", *quality_rules._BOUNDS]
    for clash in own:
        docs = docs.withColumn(clash, F.lit("own"))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], r["kept"], r["base_failed"], r["symbol_share_upper"]) for r in kept.collect()] == [(3, "own", "own", "own")]
    judged = quality_rules.judge(quality_rules.with_metrics(docs, out="measure"), metrics="measure", out=("failed", "good"))
    assert judged.columns == [*docs.columns, "measure", "failed", "good"] and {r["kept"] for r in judged.collect()} == {"own"}
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_licenses(spark):
    texts = [(1, "Released under the MIT License."), (2, "x Apache-License, Version 2.0!\nunder the mit license under the mit license"), (3, None), (4, ""), (5, "CC BY NC"), (6, "under the Kt license mit"), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "under the mit licenses"), (9, "é under the MIT license"), (None, "cc-by-nc"), (1, "none " * 5000)]
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"])) for r in license_scan.scan_licenses(table(spark, texts)).collect())
    want, fold = Counter(), {c: c + 32 for c in range(65, 91)}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        at = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want[(i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    assert got == want
    by_id = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, texts[1:])).collect()}
    assert by_id[7]["labels"] == ["gpl-3"] and by_id[7]["score"] >= 0.9 and by_id[5]["labels"] == ["cc-by-nc"] and by_id[4]["score"] == 0
    assert license_scan.scan_licenses(table(spark, texts).limit(0)).count() == 0


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software"
    texts = [
        (1, mit),
        (2, "// " + mit.replace("\n", "\r\n// ") + " and\r\n// associated files"),
        (3, "Intro\n\nRedistribution and use in source\nand binary forms, with or without\nmodification,\nare permitted. More"),
        (4, mit.replace("\n", "\n \t\n")),  # two paragraphs, none with enough of the words
        (5, mit.replace("person\n", "person.\n")),  # two sentences
        (6, "One line\nAll rights reserved\nthird line"),
        (7, "Licensed under\nthe Apache License,\nVersion 2.0"),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert got == {1: (["mit"], 1.0), 2: (["mit"], 1.0), 3: (["bsd"], 1.0), 4: ([], 0.0), 5: ([], 0.0), 6: (["all-rights-reserved"], 1.0), 7: (["apache-2"], 1.0)}


def test_license_containment(spark):
    """Labels, shares and blocks against a comparison of every block of every text with every template."""
    rng = random.Random(17)
    templates = license_scan.template_blocks(license_scan.LICENSE_TEXTS)
    originals = [re.split(r"(?<=[.!?])\s+|\n\n", t.strip()) for _, t in license_scan.LICENSE_TEXTS]
    assert all(len(words) >= license_scan.LEAST_WORDS or phrase == "all rights reserved" for _, words, phrase in templates)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(rng.choice(originals)).split()
            for _ in range(rng.choice((0, 0, 1, 3, 8))):
                w[rng.randrange(len(w))] = rng.choice(("", "other", "license", "the", "Lesser"))
            if rng.random() < 0.2:
                w.insert(rng.randrange(len(w) + 1), rng.choice((".\n", "\n\n", "# \n")))
            parts.append(" ".join(w))
        rows.append((i, rng.choice((". ", "\n\n", " ")).join(parts + passage(rng, rng.randint(0, 9)))))
    rows += [(900, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."), (901, " ".join(passage(rng, 30_000)) + " All rights reserved. " * 300)]
    fold = {c: c + 32 for c in range(65, 91)}
    want, best = {}, defaultdict(set)
    for i, t in rows:
        found = set()
        said = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', t.translate(fold)))} "
        for block in re.split(r"(?<=[.!?])(?<![^A-Za-z0-9][A-Za-z0-9]\.)[ \t-\r]+|\n[ \t-\r]*\n", t):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block.translate(fold)))
            met = [(label, words, len(own & words) / len(words)) for label, words, phrase in templates if len(own & words) >= 0.9 * len(words) and (len(words) >= 5 or f" {phrase} " in said)]
            found |= {(label, round(share, 9)) for label, _, share in met}
            best[i] |= {label for label, words, share in met if not any((s, len(o)) > (share, len(words)) and len(o & words) >= 0.9 * len(words) for _, o, s in met)}
        want[i] = found
    got = license_scan.scan_licenses(table(spark, rows)).collect()
    assert {r["doc_id"]: {(x["label"], round(x["share"], 9)) for x in r["blocks"] or []} for r in got} == want
    for r in got:
        assert set(r["labels"]) == set(r["base_labels"]) | best[r["doc_id"]]
        assert abs(r["score"] - (1 if r["base_labels"] else max((s for _, s in want[r["doc_id"]]), default=0))) < 1e-8
    assert best[900] == {"lgpl"} and ("lgpl", 1.0) in want[900] and sum(map(bool, want.values())) > 60


def test_prose_has_no_license(spark):
    """Ordinary sentences with numbers, single letters and words of licenses get no label; the notices themselves do."""
    rng = random.Random(4)
    prose = [
        "We shipped version 2.0 today.",
        "Scores were 0 and 2 at half time.",
        "v. 2. 0",
        "2 0",
        "The rights of all guests are reserved by the hotel.",
        "Reserved seats: all rights go to the winner.",
        "See section 4.0. If not, see page 3. Either version 2 of the plan works.",
        "In no event shall we be late. You may use this software at home.",
        "This version 3 of the license plate is blue.",
    ]
    names = ["version", "license", "2", "0", "3", "4", "software", "free", "the", "of", "rights", "all", "public", "general", "notice", "under"]
    prose += [" ".join(rng.choice(names) for _ in range(rng.randint(1, 7))) + rng.choice((".", ". 2. ", "")) for _ in range(200)]
    mpl = next(t for label, t in license_scan.LICENSE_TEXTS if label == "mpl-2")
    texts = [*enumerate(prose), (900, mpl), (901, "We hold it. All rights reserved. End")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert got.pop(900) == ["mpl-2"] and got.pop(901) == ["all-rights-reserved"]
    wrong = {i: x for i, x in got.items() if x and "all rights reserved" not in prose[i]}
    assert not wrong


def test_op8_query(spark):
    fold = {c: c + 32 for c in range(65, 91)}
    got = {r["doc_id"]: r for r in Q.op8_license_scan(spark, SF).collect()}
    assert len(got) == len(docs_of(spark))
    for i, t in docs_of(spark):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        at = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_ngram_join(spark):
    rng = random.Random(3)
    base = passage(rng, 120, 9999)
    rows = []
    for i in range(200):
        w = list(base) if i % 3 else passage(rng, 60, 99999) + base[:60]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "a b c d"), (1005, " a\tb\nc d "), (1006, "a"), (1007, "b a")]
    got = sorted(map(tuple, ngram_join.similar_sets(table(spark, rows)).collect()))
    assert got == sorted(ngram_join.brute_force(rows))
    same = table(spark, [(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (None, "a b c d e"), (3, "q"), (3, "q")])
    assert Counter(map(tuple, ngram_join.similar_sets(same).collect())) == Counter({(1, 2, 1): 2, (2, 2, 1): 1, (None, 2, None): 1, (3, 1, 3): 2})
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(same).where("doc_id IS NOT NULL").collect()) == [1, 3]
    assert ngram_join.similar_sets(same.limit(0)).count() == 0


def test_ngram_join_of_large_groups(spark):
    """Near copies on both sides of the threshold, with and without the text they come from, and unlike texts with one passage."""
    rng = random.Random(8)
    rows = []
    for start, many, edits in ((0, 150, (0, 1, 2, 3, 5)), (1000, 120, (2, 2, 2, 3))):
        base = passage(rng, 150, 99999)
        for i in range(many):
            w = list(base)
            for _ in range(rng.choice(edits)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice((0, 1, 1, 2))] = [f"x{rng.randint(0, 10**6)}"]
            rows.append((start + i, " ".join(w)))
    common = passage(rng, 30, 99999)
    rows += [(2000 + i, " ".join(common + passage(rng, rng.choice((2, 4, 6, 200)), 10**6))) for i in range(80)]
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        assert sorted(map(tuple, ngram_join.similar_sets(table(spark, rows), size, percent).collect())) == sorted(ngram_join.brute_force(rows, size, percent))


def test_keep_one_of_each_names(spark):
    docs = table(spark, [(1, "a b c d e"), (2, "a b c d e"), (1, "z"), (None, "q"), (3, None)])
    for clash in ("__keep", "__nth", "__KEEP_", "gram", "component", "n2", "rows"):
        docs = docs.withColumn(clash, F.lit("own"))
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["__nth"] for r in kept.collect()} == {"own"}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert ngram_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_ngram_join_of_empty_partitions(spark):
    empty = [(1, None), (2, ""), (3, " \n\t"), (4, None)]
    want = [(i, 0, i) for i, _ in empty]
    assert sorted(map(tuple, ngram_join.similar_sets(table(spark, empty).coalesce(1)).collect())) == want
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(table(spark, empty)).collect()) == [1, 2, 3, 4]
    full = [(10, "a b c d e f"), (11, "A b c d e f"), (12, "q")]
    parts = table(spark, empty).coalesce(1).unionByName(table(spark, full).coalesce(1))  # one partition without words
    assert sorted(map(tuple, ngram_join.similar_sets(parts).collect())) == sorted(ngram_join.brute_force(empty + full))


def test_texts_of_holders_meet_python_once(spark, monkeypatch):
    """No stage of the n-gram join has Python twice: each such task would hold two workers."""
    base = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(7, "again"), (None, "none")], "id long, text string").repartition(3)
    holders = materialize(spark.createDataFrame([(100 + i, i) for i in range(0, 50, 7)], "node long, id long"), "holders")
    want = sorted([(100 + i, f"t{i}") for i in range(0, 50, 7)] + [(107, "again")])
    few = ngram_join._rows_of(base, holders)
    assert sorted(map(tuple, few.collect())) == want
    assert "InArrow" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    many = ngram_join._rows_of(base, holders)
    assert sorted(map(tuple, many.collect())) == want
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()  # what Python gives is shuffled before the next Python
    base = [(i, " ".join(f"w{(i % 10) * 100 + k}" for k in range(40)) + f" x{i % 3}") for i in range(30)]
    assert sorted(map(tuple, ngram_join.similar_sets(table(spark, base)).collect())) == sorted(ngram_join.brute_force(base))


def test_counting_ngrams_holds_a_bounded_array(monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD_CELLS", 1 << 17)
    rng = np.random.default_rng(3)
    columns = [pa.array([" ".join(map(str, rng.integers(0, 10**6, 2000))) for _ in range(50)]) for _ in range(20)]
    total, bits = np.zeros(1 << 21, np.int64), 21
    tracemalloc.start()
    for batch in ngram_join._partial_counts(iter(columns), 5, bits):
        at, n = np.frombuffer(zlib.decompress(batch.column(1)[0].as_py()), np.uint32).reshape(2, -1)
        np.add.at(total, (batch.column(0)[0].as_py() << 20) + np.cumsum(at.astype(np.int64)), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(1 << 21, np.int64)
    for column in columns:
        for _, grams, _ in ngram_join._sets(column, 5):
            np.add.at(want, (grams >> np.uint64(64 - bits)).astype(np.int64), 1)
    assert (total == want).all() and total.sum() > 1_900_000
    assert peak < 32 << 20  # all n-grams at once, eight bytes each and sorted, took 77 MB


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in (a, b) and a != b for a, b in links)}


def test_tokens(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    encoder = token_binary.Encoder(path)
    odd = ["", "  ", " ", "a  b", "a \n b", "\n\n a", "x  y  ", "  lead", "tab\t x", "a\x1c b \x1d c", "12  34's  'll", "é  ü  z", "a   ", "it's 's ''ll x're_a _b__ c_d", "a b ́x中", "x  \n\n  y\n \n", "a\xa0 b\x85c ² ½ª", "<|endoftext|> a", "Straße Éa, b.", "a<|endoftext|>b", "a b<|endoftext|>", "a  <|endoftext|> <|endoftext|>b c", "<|endoftext|>", "<|endoftext|", "w" * 300 + " " + "v" * 300]
    assert encode("a<|endoftext|>b").count(50256) == 1
    for texts in (odd, *[[t] for t in odd]):
        assert encoder.encode(pa.array(texts)) == [np.array(encode(t), "<u4").tobytes() for t in texts]
    for planes in ("byte", "bit"):
        x = (np.arange(13, dtype="<u4") * 329_991_733).astype("<u4")
        assert (token_binary.unpack_block(token_binary.pack_block(x, planes), 13, planes) == x).all()
    docs = [*rows[::7], *[(500 + k, t) for k, t in enumerate(odd)], (3, "again"), (None, "none")]
    docs += [(None, f"none {k % 40}") for k in range(80)]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
    want, start = [], 0
    for i, t in order:
        ids = encode(t) + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    for planes in ("byte", "bit"):
        shards = token_binary.write_token_shards(table(spark, docs), fresh_path(spark, "t"), path, 2, planes=planes, block_ids=64, shard_bytes=60_000)
        assert shards.count() > 2
        assert sorted((tuple(r) for r in token_binary.read_token_shards(shards, with_ids=True).collect()), key=lambda r: r[1]) == want
    got = sorted(map(tuple, Q.op10_token_binary(spark, SF).collect()))
    start = 0
    for (i, t), row in zip(sorted(docs_of(spark)), got):
        ids = encode(t or "") + [2]
        assert row == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_binary.read_token_shards(token_binary.write_token_shards(table(spark, docs).limit(0), fresh_path(spark, "t"), path, 2)).count() == 0
    with pytest.raises(ValueError):
        list(token_binary.read_shard(io.BytesIO(b"LSTIxxxx")))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        given = {r["doc_id"] for r in held.collect()}
        out = materialize(stage(spark, held, SF), name)
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= given
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "quality_rules":
            assert not any(quality(before[i])[5] for i in ids)
        if name == "ngram_join":
            groups = ngram_join.brute_force([(i, before[i]) for i in given])
            assert ids == {c for _, _, c in groups}
        if name == "decontamination":
            assert ids == {x[0] for x in decontaminate.brute_force([(i, before[i]) for i in given], bench) if not x[5]}
        held = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, held.collect()))


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [passage(rng, 100, 99999), passage(rng, 400, 99999)]
    block = list(texts[1])
    block[150:190] = passage(rng, 40, 99999)
    rows = [(1, texts[0]), (2, texts[0] + passage(rng, 20, 99999)), (3, texts[1]), (4, block), (5, passage(rng, 100, 99999)), (6, texts[0][:60] + passage(rng, 40, 99999))]
    rows = [(i, " ".join(w)) for i, w in rows]
    kept = {r["doc_id"] for r in corpus_pipeline.ngram_join(spark, table(spark, rows), SF).collect()}
    assert kept == {c for _, _, c in ngram_join.brute_force(rows, 5, 80)} == {1, 3, 5, 6}
    assert {c for _, _, c in ngram_join.brute_force(rows)} == {1, 2, 3, 4, 5, 6}
