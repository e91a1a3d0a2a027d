"""Code trees, the published sample trees, points in spans, and the backfills that use them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import code_structure, intervals, structure
from lodestone.shared import store

# Small files and the ids, types, spans and depths that their nodes must have.
SAMPLES = {
    "code_sample.py": (
        "import os\n\nclass Widget:\n    def method(self):\n        return 1\n\ndef helper():\n    return 2\n",
        [
            ("ec3153d94dc4f18fc5e287756ede7aa181e07971", "document", "code_sample.py", 1, 9, 0, 92, 0, None),
            ("f0595f7fcf832c489169dbcf94e3959d285c23bc", "import", "import", 1, 1, 0, 9, 1, "ec3153d94dc4f18fc5e287756ede7aa181e07971"),
            ("1f2070426a804c468d3cecc4c44cccaa9010f661", "class", "Widget", 3, 5, 11, 63, 1, "ec3153d94dc4f18fc5e287756ede7aa181e07971"),
            ("e4590d007d194ddfec583c2c6a69081ce643b70b", "function", "method", 4, 5, 25, 63, 2, "1f2070426a804c468d3cecc4c44cccaa9010f661"),
            ("375c298c048c0e4f159b9ea57f2ce561f9cbf83b", "function", "helper", 7, 8, 65, 91, 1, "ec3153d94dc4f18fc5e287756ede7aa181e07971"),
        ],
    ),
    "text_sample.md": (
        "# Title\n\nParagraph one.\n\n## Section\n\n- Item A\n- Item B\n",
        [
            ("04a74b353f20366b458085682675ffb24b56855d", "document", "text_sample.md", 1, 9, 0, 55, 0, None),
            ("6fc5befefa7d3c8e663c713f08e65d8398309961", "heading", "Title", 1, 8, 0, 54, 1, "04a74b353f20366b458085682675ffb24b56855d"),
            ("0297d95c7bc82631b1347fa62f82ce39c6938ecd", "paragraph", "paragraph", 3, 3, 9, 23, 2, "6fc5befefa7d3c8e663c713f08e65d8398309961"),
            ("0392e855c3711b526abb95d59e2ba48af5221461", "heading", "Section", 5, 8, 25, 54, 2, "6fc5befefa7d3c8e663c713f08e65d8398309961"),
            ("2f5dd2c0baf96c6ad66b283261b79dc10a953442", "list", "list", 7, 8, 37, 54, 3, "0392e855c3711b526abb95d59e2ba48af5221461"),
        ],
    ),
    "html_sample.html": (
        "<html><body>\n<section id='intro'>\n  <h1>Intro</h1>\n  <p>Welcome text.</p>\n</section>\n<article>\n  <h2>Article</h2>\n  <p>Body text.</p>\n</article>\n</body></html>",
        [
            ("6ccccdd736e956d0520455b7d22e155a5cf21da2", "document", "html_sample.html", 1, 7, 0, 41, 0, None),
            ("df65714a2958886ece4add6e36c4dc6f61753f38", "section", "Intro", 1, 3, 0, 20, 1, "6ccccdd736e956d0520455b7d22e155a5cf21da2"),
            ("2563c8af5e673350886f0592bb97073d9d70dfea", "heading", "Intro", 1, 3, 0, 20, 2, "df65714a2958886ece4add6e36c4dc6f61753f38"),
            ("6a3e5a9e4025e1ae93d32b686eeee7f494e634f1", "paragraph", "paragraph", 3, 3, 7, 20, 3, "2563c8af5e673350886f0592bb97073d9d70dfea"),
            ("3403392166b4589f6d7a669296ba201a9f3535cf", "section", "Article", 5, 7, 22, 41, 1, "6ccccdd736e956d0520455b7d22e155a5cf21da2"),
            ("085f9b0656ecbdd7c83b3fea9f600b41178fb5cf", "heading", "Article", 5, 7, 22, 41, 2, "3403392166b4589f6d7a669296ba201a9f3535cf"),
            ("8697ecb74f7b0924c13258359df48e67751881bc", "paragraph", "paragraph", 7, 7, 31, 41, 3, "085f9b0656ecbdd7c83b3fea9f600b41178fb5cf"),
        ],
    ),
}
LINE_HASHES = {"Widget": "7259cce047105c64a078d7e48c5d1bafaee57b9539e3bc0f7a7a76448347cb24", "code_sample.py": "acf03e12b9dcfa13b1c4a9847605651618dd301016edf0fee3f9682301050ab6"}


def test_sample_trees(spark):
    files = spark.createDataFrame([(f"/f/{name}", text) for name, (text, _) in SAMPLES.items()] + [("/f/none.py", None), ("/f/no.html", ""), ("/f/no", None)], "source_path string, text string")
    got = structure.file_graph(files).collect()
    for name, (_, want) in SAMPLES.items():
        have = [(r["node_id"], r["node_type"], r["name"], r["start_line"], r["end_line"], r["start_char"], r["end_char"], r["depth"], r["parent_id"]) for r in got if r["path"] == f"/f/{name}"]
        assert sorted(have) == sorted(want), name
    assert {(r["path"], r["start_line"], r["end_line"], r["end_char"]) for r in got if r["path"].startswith("/f/no")} == {("/f/none.py", 1, 1, 0), ("/f/no.html", 1, 1, 0), ("/f/no", 1, 1, 0)}
    code = code_structure.code_graph(files.where("source_path LIKE '%.py'")).collect()
    assert {r["name"]: r["line_hash"] for r in code if r["name"] in LINE_HASHES} == LINE_HASHES and {r["language"] for r in code} == {"python"}


def nodes_by_hand(text, spoken):
    """Every node's end looked for line by line, every parent among all nodes."""
    lines, out = text.split("\n"), []
    indent = lambda s: len(s.replace("\t", "    ")) - len(s.replace("\t", "    ").lstrip(" "))
    for n, line in enumerate(lines):
        if spoken == "python":
            m = re.match(r"\s*(import) \w|\s*(class|def|if) ?(\w*)", line)
            if not m or line.lstrip().startswith("def") and "(" not in line:
                continue
            end = n
            if not m[1]:
                for k in range(n + 1, len(lines)):
                    if lines[k].strip() and indent(lines[k]) <= indent(line):
                        break
                    end = k if lines[k].strip() else end
        else:
            m = re.match(r"\s*(import)\b|\s*(class|function|if) ?(\w*)", line)
            if not m:
                continue
            end, depth, started, seen = n, 0, False, n
            if not m[1]:
                for k in range(n, len(lines)):
                    depth += lines[k].count("{") - lines[k].count("}")
                    started |= "{" in lines[k]
                    seen = k if lines[k].strip() else seen
                    if started and depth <= 0:
                        break
                end = seen
        out.append((m[1] or m[2], n, end))
    holds = lambda a, b: a is not b and a[1] <= b[1] and a[2] >= b[2]
    up = [min(((a[2] - a[1], k) for k, a in enumerate(out) if holds(a, b)), default=(0, -1))[1] for b in out]
    return out, up


@pytest.mark.parametrize("spoken", ["python", "javascript"])
def test_code_nodes(spoken):
    rng = random.Random(len(spoken))
    pieces = {"python": ["import os", "class A:", "def f(x):", "if x:", "x = 1", "", "   ", "# y"], "javascript": ["import x", "class A {", "function f(x) {", "if (x)", "if (x) {", "}", "}}", "} {", "y();", "", "{"]}[spoken]
    for _ in range(300):
        text = "\n".join((rng.choice(["", "    ", "\t", "        ", "  "]) if spoken == "python" else "") + rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        nodes = code_structure.code_nodes(text.split("\n"), spoken)
        kinds = {"function": "def" if spoken == "python" else "function", "block": "if", "class": "class", "import": "import"}
        want, up = nodes_by_hand(text, spoken)
        assert [(kinds[k], a, b) for k, _, a, b in nodes] == want, text
        assert code_structure.parents(nodes) == up, text
    assert code_structure.code_nodes(["class A", "def f", "if x"], "generic") == [["class", "A", 0, 0], ["function", "f", 1, 1]]


def test_long_code(spark):
    deep = "\n".join(" " * min(k, 400) + f"def f{k}(x):" for k in range(3000))
    rows = code_structure.code_graph(spark.createDataFrame([("/a.py", deep), ("/b.js", "if (x)\n" * 3000)], "source_path string, text string")).collect()
    assert len(rows) == 6002 and max(r["depth"] for r in rows) > 400


def test_stab(spark):
    rng = random.Random(8)
    spans = [(f"f{rng.randint(0, 2)}", k, s := rng.randint(0, 400), s + rng.choice([0, 1, 2, 7, 64, 300])) for k in range(120)] + [("f0", 500, 0, 1 << 20), ("f1", 501, None, 5), ("f1", 502, -3, 5), (None, 503, 0, 9)]
    points = [(f"f{rng.randint(0, 2)}", k, rng.randint(0, 800)) for k in range(300)] + [("f0", 900, None), ("f0", 901, -1), (None, 902, 1), ("f0", 903, (1 << 20) - 1), ("f0", 904, 1 << 20), ("f0", 904, 1 << 20)]
    got = intervals.stab(spark.createDataFrame(points, "file string, p int, at int"), spark.createDataFrame(spans, "file string, s int, lo int, hi int"), ["file"], "at", "lo", "hi")
    assert got.columns == ["file", "p", "at", "s", "lo", "hi"]
    want = sorted((p[1], s[1]) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[2], s[2]) and 0 <= s[2] <= p[2] < s[3])
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want
    empty = spark.createDataFrame([], "file string, s int, lo int, hi int")
    assert intervals.stab(spark.createDataFrame(points, "file string, p int, at int"), empty, ["file"], "at", "lo", "hi").count() == 0


def test_stab_totals(spark):
    rng = random.Random(9)
    spans = [(f"f{rng.randint(0, 2)}", rng.choice([None, rng.randint(1, 9)]), s := rng.randint(0, 300), s + rng.choice([0, 1, 7, 64, 300])) for _ in range(150)] + [("f1", 1, None, 5), ("f1", 2, -3, 5), (None, 3, 0, 9)]
    points = [(f"f{rng.randint(0, 2)}", rng.choice([None, rng.randint(1, 9)]), rng.randint(0, 60)) for _ in range(300)] + [("f0", 1, None), ("f0", 1, -1), (None, 2, 1)]
    p, s = spark.createDataFrame(points, "file string, v long, at long"), spark.createDataFrame(spans, "file string, w long, lo long, hi long")
    pairs = intervals.stab(p, s, ["file"], "at", "lo", "hi")
    want = {r["file"]: r[1:] for r in pairs.groupBy("file").agg(F.count("*"), F.sum(F.col("v") * F.col("w")), F.max(F.col("at") - F.col("lo"))).collect()}
    found = intervals.stab_totals(p, s, ["file"], "at", "lo", "hi", "v", "w")
    assert found.columns == ["file", "pairs", "checksum", "deepest"]
    assert len(want) == 3 and {r["file"]: r[1:] for r in found.collect()} == want


def test_blocks_of_spans_are_not_broadcast(spark):
    """Spans look small before they are cut into blocks."""
    p = spark.range(1000).select(F.lit("f").alias("file"), F.lit(1).alias("v"), F.col("id").alias("at"))
    s = spark.range(1000).select(F.lit("f").alias("file"), F.lit(1).alias("w"), F.col("id").alias("lo"), (F.col("id") + 700).alias("hi"))
    for found in (intervals.stab(p, s, ["file"], "at", "lo", "hi"), intervals.stab_totals(p, s, ["file"], "at", "lo", "hi", "v", "w")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_heading_paths(spark):
    text = "# A\n\none\n\n## B\n\ntwo\n\n### C\n\nthree\n\n## D\n\nfour\n\n# E\n\nfive\n\n## B\n\nsix"
    files = spark.createDataFrame([("/f.md", text), ("/g.md", "no heading")], "source_path string, text string")
    tree = store(structure.text_graph(files), "tree")
    at = {w: text.index(w) for w in ("one", "two", "three", "four", "five", "six")}
    chunks = [(w, "/f.md", None, a, None, "chunk", True) for w, a in at.items()]
    assert {r["chunk_id"]: r["heading_path"] for r in intervals.enclosing_headings(spark.createDataFrame([c[:2] + c[3:4] for c in chunks], "chunk_id string, source_path string, start_char int"), tree).collect()} == {"one": ["A"], "two": ["A", "B"], "three": ["A", "B", "C"], "four": ["A", "D"], "five": ["E"], "six": ["E", "B"]}
    rows = [
        ("two", "/f.md", "B", at["two"], None, "chunk", True),
        ("two2", "/f.md", "B", None, None, None, True),  # no place: the last heading of the name
        ("three", "/f.md", "C", None, None, "chunk", True),
        ("old", "/f.md", "B", 0, None, "chunk", False),
        ("unsure", "/f.md", "B", 0, None, "chunk", None),
        ("kept", "/f.md", "B", 0, ["x"], "chunk", True),
        ("bare", "/f.md", None, at["two"], None, "chunk", True),
        ("summary", "/f.md", "B", 0, None, "file_summary", True),
        ("gone", "/h.md", "B", 0, None, "chunk", True),
        ("other", "/f.md", "Z", 10_000, None, "chunk", True),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, source_path string, heading string, start_char int, heading_path array<string>, node_type string, is_current boolean")
    out = intervals.backfill_heading_paths(df, tree)
    assert out.columns == df.columns
    assert {r["chunk_id"]: r["heading_path"] for r in out.collect()} == {"two": ["A", "B"], "two2": ["E", "B"], "three": ["A", "B", "C"], "old": None, "unsure": None, "kept": ["x"], "bare": None, "summary": None, "gone": None, "other": None}
    named = intervals.backfill_heading_paths(df.drop("start_char"), tree).collect()
    assert {r["chunk_id"]: r["heading_path"] for r in named}["two"] == ["E", "B"]


def test_backfill_graph(spark):
    files = spark.createDataFrame([("/a.md", "# A\n\n[[b]]"), ("/b.py", "def f(x):\n    pass"), ("/c.pdf", "x"), ("/d.md", "# D"), ("/e.md", "# E")], "source_path string, text string")
    chunks = spark.createDataFrame([("/a.md", "chunk", True), ("/a.md", "chunk", True), ("/b.py", "chunk", True), ("/c.pdf", "chunk", True), ("/d.md", "chunk", True), ("/e.md", "chunk", False), ("/gone.md", "chunk", True)], "source_path string, node_type string, is_current boolean")
    old = files.where("source_path = '/d.md'")
    nodes, edges = structure.property_graph(structure.file_graph(old), old)
    more_nodes, more_edges = (store(x, "graph") for x in structure.backfill_graph(chunks, nodes, edges, files))
    assert {r["source_path"] for r in more_nodes.where("node_type = 'file'").collect()} == {"/a.md", "/b.py", "/d.md"}
    assert more_nodes.count() == more_nodes.select("node_id").distinct().count() > nodes.count()
    again_nodes, again_edges = structure.backfill_graph(chunks, more_nodes, more_edges, files)
    assert again_nodes.count() == more_nodes.count() and again_edges.count() == more_edges.count()
