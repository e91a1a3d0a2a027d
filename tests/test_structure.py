"""Structure graphs against trees that are built heading by heading."""

import random

from pyspark.sql import functions as F

from lodestone.operators import structure
from lodestone.operators.chunking import heading_of


def by_hand(text):
    """(type, name, parent name or None, depth, start, end) of blank-line blocks, with a stack of open headings."""
    blocks, at = [], 0
    for raw in text.split("\n\n"):
        start = text.index(raw, at)
        at = start + len(raw)
        found = heading_of(raw, True)
        kind = "heading" if found else "list" if all(x.lstrip().startswith("- ") for x in raw.split("\n")) else "paragraph"
        blocks.append([kind, found[0] if found else kind, found[1] if found else None, start, at])
    stack, out = [], []
    for n, (kind, name, level, start, end) in enumerate(blocks):
        if kind == "heading":
            while stack and blocks[stack[-1]][2] >= level:
                stack.pop()
            for later in blocks[n + 1 :]:
                if later[0] == "heading" and later[2] <= level:
                    break
                end = later[4]
        out.append((kind, name, blocks[stack[-1]][3] if stack else None, len(stack) + 1, start, end))
        if kind == "heading":
            stack.append(n)
    return out


def test_text_graph(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(30):
        parts = [rng.choice(("#" * rng.randint(1, 6) + f" H{k}", f"words {k} here", f"- a{k}\n- b{k}", f"**Bold {k}**", f"Section {k}.{k}: plain")) for k in range(rng.randint(1, 14))]
        texts[f"/d/f{i}.md"] = "\n\n".join(parts)
    files = spark.createDataFrame([*texts.items(), ("/d/empty.md", ""), ("/d/none.md", None)], "source_path string, text string")
    tree = structure.text_graph(files).collect()
    starts = {(r["path"], r["node_id"]): r["start_char"] for r in tree}
    roots = {r["path"]: r for r in tree if r["node_type"] == "document"}
    assert set(roots) == {*texts, "/d/empty.md", "/d/none.md"} and all(r["depth"] == 0 and r["parent_id"] is None for r in roots.values())
    for path, text in texts.items():
        got = sorted((r["start_char"], r["node_type"], r["name"], None if r["parent_id"] == roots[path]["node_id"] else starts[path, r["parent_id"]], r["depth"], r["end_char"]) for r in tree if r["path"] == path and r["node_type"] != "document")
        assert got == sorted((s, k, n, p, d, e) for k, n, p, d, s, e in by_hand(text)), text
        for r in tree:
            if r["path"] == path:
                assert r["start_line"] == text.count("\n", 0, r["start_char"]) + 1 and r["end_line"] == text.count("\n", 0, r["end_char"]) + 1

    nodes, edges = structure.property_graph(structure.text_graph(files), files)
    assert nodes.where("node_type = 'file'").count() == len(roots)
    assert edges.where("edge_type = 'contains'").count() == len(tree)
    known = {r["node_id"] for r in nodes.collect()}
    assert all(r["src_id"] in known and r["dst_id"] in known for r in edges.collect())

    cuts = {(r["path"], r["start_char"]) for r in structure.boundary_headings(structure.text_graph(files), 40).collect()}
    for path, text in texts.items():
        blocks = by_hand(text)
        heads = {s: (p, e) for k, _, p, _, s, e in blocks if k == "heading"}

        def chosen(s):
            p = heads[s][0]
            return p is None or chosen(p) and heads[p][1] - p > 40

        assert {s for q, s in cuts if q == path} == {s for s in heads if chosen(s)}
    found = structure.section_texts(structure.text_graph(files), files, "h1").collect()
    assert found and all(r["text"].startswith("#") and len(r["hashes"]) == r["text"].count("\n") + 1 for r in found)


def test_html_graph(spark):
    page = """<html><head><title>t</title><script>x</script></head><body><h1>Top</h1><p>one  two</p>
    <section id="s"><h2>In <b>side</b></h2><ul><li>a<ul><li>deep</li></ul></li><li>b</li></ul><article aria-label="L"><p>art</p></article></section>
    <table><tr><th>k</th><td>v</td></tr><tr><td>w</td></tr></table><noscript>no</noscript><h2>End</h2><section><p>z</p></section><h1>Last</h1></body></html>"""
    tree = structure.html_graph(spark.createDataFrame([("p.html", page), ("q.html", None)], "source_path string, html string")).where("path = 'p.html'").collect()
    names = {r["node_id"]: r["name"] for r in tree}
    got = [(r["node_type"], r["name"], names.get(r["parent_id"]), r["depth"], r["start_line"], r["end_line"]) for r in sorted(tree, key=lambda r: (r["start_char"], -r["end_char"], r["depth"]))]
    assert [x for x in got if x[0] != "document"] == [
        ("heading", "Top", "p.html", 1, 1, 17),
        ("paragraph", "paragraph", "Top", 2, 3, 3),
        ("section", "In side", "p.html", 1, 5, 10),
        ("heading", "In side", "In side", 2, 5, 10),
        ("list", "list", "In side", 3, 7, 8),
        ("section", "L", "In side", 2, 10, 10),
        ("paragraph", "paragraph", "L", 3, 10, 10),
        ("table", "table", "Top", 2, 12, 13),
        ("heading", "End", "Top", 2, 15, 17),
        ("section", "Section", "p.html", 1, 17, 17),
        ("paragraph", "paragraph", "Section", 2, 17, 17),
        ("heading", "Last", "p.html", 1, 19, 19),
    ], got


def test_structure_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("source_path"), "text")
    tree = structure.text_graph(docs)
    assert tree.where("node_type = 'document'").count() == docs.count()
    ids = tree.select("path", "node_id")
    assert tree.where("parent_id IS NOT NULL").join(ids.withColumnRenamed("node_id", "parent_id"), ["path", "parent_id"], "left_anti").count() == 0
