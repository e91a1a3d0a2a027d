"""Structure graphs of files: a tree of headings, paragraphs, lists, tables and sections for every text or HTML page.

A small parser turns each file into its blocks, one row a block in reading order. Everything about the tree is then
window arithmetic over a file's rows: the span of a heading reaches to the block before the next heading of its level or
a higher one, and the open headings above a row are, for each level, the last heading of that level that no later
heading of a higher level has closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_list_block, stable_id
from ..shared import store
from .chunking import paragraphs
from .code_structure import CODE_EXTENSIONS, code_graph, extension
from .graph import extract_links, file_node_id

_BLOCK = "path string, scope int, position int, node_type string, name string, level int, start_line int, end_line int, start_char int, end_char int"
_LEVELS = range(1, 7)


def text_blocks(df: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """One row a blank-line block: heading (with its level), list or paragraph, with lines and characters."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch[path_col], batch[text_col]):
                for n, p in enumerate(paragraphs(text or "", plain=True)):
                    head = p["level"] is not None
                    rows.append((path, None, n, "heading" if head else "paragraph", p["heading"] if head else p["text"], p["level"], p["start_line"], p["end_line"], p["start"], p["end"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    blocks = df.select(path_col, text_col).mapInPandas(cut, _BLOCK)
    kind = F.when(F.col("node_type") == "heading", "heading").when(is_list_block(F.col("name")), "list").otherwise("paragraph")
    return blocks.withColumn("node_type", kind).withColumn("name", F.when(kind == "heading", F.col("name")).otherwise(kind))


class _PageBlocks(HTMLParser):
    """Blocks (kind, level, lines, section) of a page and its sections (parent, tag, label, first and last block)."""

    SKIPPED, SECTIONS, LISTS = {"script", "style", "noscript"}, {"section", "article"}, {"ul", "ol"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int | None, list[str], int | None]] = []
        self.sections: list[list] = []
        self.open: list[int] = []
        self.skipped, self.kind, self.text = 0, None, []
        self.depth, self.lines, self.cells = 0, [], []

    def _section(self) -> int | None:
        return self.open[-1] if self.open else None

    def _piece(self) -> str:
        piece, self.text = " ".join(" ".join(self.text).split()), []
        return piece

    def _finish(self) -> None:
        """The block that is open (heading, paragraph, list or table) ends."""
        if self.kind in ("list", "table"):
            self._item()
            lines = self.lines
        else:
            piece = self._piece()
            lines = [piece] if piece else []
        if self.kind and lines:
            level = int(self.kind[1]) if self.kind[0] == "h" and self.kind[1:].isdigit() else None
            self.blocks.append(("heading" if level else self.kind, level, lines, self._section()))
        self.kind, self.depth, self.lines, self.cells, self.text = None, 0, [], [], []

    def _item(self) -> None:
        piece = self._piece()
        if self.kind == "list" and piece:
            self.lines.append(f"- {piece}")
        if self.kind == "table":
            if piece:
                self.cells.append(piece)
            if self.cells:
                self.lines.append(" | ".join(self.cells))
            self.cells = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag in self.SECTIONS and self.kind is None:
            a = dict(attrs)
            self.sections.append([self._section(), tag, a.get("aria-label") or a.get("id"), len(self.blocks), None])
            self.open.append(len(self.sections) - 1)
        elif self.kind in ("list", "table"):
            self.depth += tag in self.LISTS or tag == "table"
            if tag in ("li", "tr") and self.depth == 1:
                self._item()
            elif tag in ("td", "th") and self.depth == 1 and (piece := self._piece()):
                self.cells.append(piece)
        elif tag in self.LISTS or tag == "table":
            self._finish()
            self.kind, self.depth = "table" if tag == "table" else "list", 1
        elif tag == "p" or tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2:
            self._finish()
            self.kind = "paragraph" if tag == "p" else tag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif self.kind in ("list", "table"):
            if tag in ("td", "th") and self.depth == 1 and (piece := self._piece()):
                self.cells.append(piece)
            self.depth -= tag in self.LISTS or tag == "table"
            if not self.depth:
                self._finish()
        elif tag == self.kind or tag == "p" and self.kind == "paragraph":
            self._finish()
        elif tag in self.SECTIONS and self.open:
            self._finish()
            self.sections[self.open.pop()][4] = len(self.blocks) - 1

    def handle_data(self, data: str) -> None:
        if not self.skipped and self.kind:
            self.text.append(data)


def html_blocks(df: DataFrame, path_col: str = "source_path", html_col: str = "html") -> DataFrame:
    """One row a block of a page, and one a section (node type section; position -1 - its number; end_line and end_char
    those of its last block). ``scope`` is the section that a row stands in. Lines and characters are those of the
    blocks joined by blank lines."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, html in zip(batch[path_col], batch[html_col]):
                page = _PageBlocks()
                page.feed(html or "")
                page.close()
                page._finish()
                line, char, own = 1, 0, []
                for n, (kind, level, lines, scope) in enumerate(page.blocks):
                    size = sum(map(len, lines)) + len(lines) - 1
                    own.append((path, scope, n, kind, lines[0] if level else kind, level, line, line + len(lines) - 1, char, char + size))
                    line, char = line + len(lines) + 1, char + size + 2
                for n, (parent, tag, label, first, last) in enumerate(page.sections):
                    last = len(own) - 1 if last is None else last
                    if first <= last:
                        title = next((b[4] for b in own[first : last + 1] if b[3] == "heading"), None)
                        rows.append((path, parent, -1 - n, "section", title or label or tag.title(), None, own[first][6], own[last][7], own[first][8], own[last][9]))
                rows += own
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return df.select(path_col, html_col).mapInPandas(cut, _BLOCK)


def _any(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs)


def assemble(blocks: DataFrame, files: DataFrame, path_col: str = "source_path", content_col: str = "text", joined: bool = False) -> DataFrame:
    """(path, position, node_id, parent_id, node_type, name, level, depth, spans): the tree of every file's blocks.

    ``files`` (path, content) gives each file's root, the document itself, and the content hash that the ids are made
    of. The root spans the content, or, with ``joined``, its blocks. Headings reach over what stands below them; the parent of a row is the nearest open heading of its section, or
    the section, or the document.
    """
    scope = ["path", "scope"]
    ahead = Window.partitionBy(*scope).orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy(*scope).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    body, sections = blocks.where("node_type != 'section'"), blocks.where("node_type = 'section'")
    heading = F.col("node_type") == "heading"
    rows = body
    for n in _LEVELS:
        rows = rows.withColumn(f"next{n}", F.min(F.when(heading & (F.col("level") <= n), F.struct("position", "level"))).over(ahead)["position"])
        rows = rows.withColumn(f"last{n}", F.max(F.when(heading & (F.col("level") == n), F.col("position"))).over(behind))
    pick = lambda name: reduce(lambda a, n: F.when(F.col("level") == n, F.col(f"{name}{n}")).otherwise(a), _LEVELS, F.lit(None).cast("int"))
    rows = rows.withColumn("until", pick("next"))
    # A heading reaches to the block before ``until``, else to the end of its section, else to that of the file.
    before = body.select("path", (F.col("position") + 1).alias("until"), F.col("end_line").alias("end_line_b"), F.col("end_char").alias("end_char_b"))
    inside = sections.select("path", (-1 - F.col("position")).alias("scope"), F.col("end_line").alias("end_line_s"), F.col("end_char").alias("end_char_s"))
    rows = rows.join(before, ["path", "until"], "left").join(inside, ["path", "scope"], "left")
    file = Window.partitionBy("path")
    for c in ("end_line", "end_char"):
        reach = F.coalesce(f"{c}_b", f"{c}_s", F.max(c).over(file))
        rows = rows.withColumn(f"{c}_r", F.when(heading, F.greatest(F.col(c), reach)).otherwise(F.col(c)))
    rows = rows.drop("end_line", "end_char").withColumnsRenamed({"end_line_r": "end_line", "end_char_r": "end_char"})
    # Open headings: of each level above the row's own the last one, unless a higher one came after it.
    own = F.coalesce("level", F.lit(7))
    alive = [F.when((F.lit(n) < own) & F.col(f"last{n}").isNotNull() & ~_any([F.coalesce(F.col(f"last{m}") > F.col(f"last{n}"), F.lit(False)) for m in range(1, n)] or [F.lit(False)]), F.col(f"last{n}")) for n in _LEVELS]
    rows = rows.withColumn("above", F.array_sort(F.array_compact(F.array(*alive))))
    keep = ["path", "scope", "position", "node_type", "name", "level", "start_line", "end_line", "start_char", "end_char"]
    every = rows.select(*keep, "above").unionByName(sections.select(*keep, F.array().cast("array<int>").alias("above")))

    hashed = files.select(F.col(path_col).alias("path"), F.sha2(F.coalesce(F.col(content_col), F.lit("")), 256).alias("content_hash"), F.length(F.coalesce(F.col(content_col), F.lit(""))).alias("chars"), (F.regexp_count(F.coalesce(F.col(content_col), F.lit("")), F.lit("\n")) + 1).alias("lines"))
    if joined:
        extent = body.groupBy("path").agg(F.max("end_char").alias("chars"), F.max("end_line").alias("lines"))
        hashed = hashed.select("path", "content_hash").join(extent, "path", "left").select("path", "content_hash", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("lines", F.lit(1)).alias("lines"))
    identity = lambda *c: F.sha1(F.concat_ws("|", *c, F.lit("0"), F.lit("")))
    named = every.join(hashed, "path").withColumn("node_id", identity("content_hash", "node_type", "name", *[F.col(c).cast("string") for c in ("start_line", "end_line", "start_char", "end_char")]))
    title = F.element_at(F.split("path", "/"), -1)
    root = hashed.select("path", identity("content_hash", F.lit("document"), title, F.lit("1"), F.col("lines").cast("string"), F.lit("0"), F.col("chars").cast("string")).alias("root_id"), title.alias("title"), "lines", "chars")

    # How deep a section is: its ancestors are a chain of numbers inside one file.
    chain = sections.select("path", (-1 - F.col("position")).alias("number"), F.col("scope").alias("up"))
    chains = chain.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("number", "up"))).alias("ups"))  # the sections of one file
    depth_of = F.aggregate(F.sequence(F.lit(1), F.size(F.coalesce("ups", F.create_map().cast("map<int,int>"))) + 1), F.struct(F.col("scope").alias("at"), F.lit(0).alias("n")), lambda a, _: F.struct(F.try_element_at("ups", a["at"]).alias("at"), (a["n"] + a["at"].isNotNull().cast("int")).alias("n")), lambda a: a["n"])
    placed = named.join(chains, "path", "left").withColumn("depth", (1 + F.size("above") + F.when(F.col("scope").isNull(), 0).otherwise(depth_of)).cast("int"))
    parent_at = F.when(F.size("above") > 0, F.element_at("above", -1)).otherwise(-1 - F.col("scope"))
    ids = placed.select("path", F.col("position").alias("at"), F.col("node_id").alias("parent"))
    tree = placed.withColumn("at", parent_at).join(ids, ["path", "at"], "left").join(root.select("path", "root_id"), "path")
    out = ["path", "position", "node_id", "parent_id", "node_type", "name", "level", "depth", "start_line", "end_line", "start_char", "end_char"]
    tree = tree.withColumn("parent_id", F.coalesce("parent", "root_id")).select(*out)
    roots = root.select("path", F.lit(-(1 << 30)).alias("position"), F.col("root_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("node_type"), F.col("title").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("depth"), F.lit(1).alias("start_line"), F.col("lines").cast("int").alias("end_line"), F.lit(0).alias("start_char"), F.col("chars").cast("int").alias("end_char"))
    return roots.unionByName(tree)


def text_graph(df: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    return assemble(text_blocks(df, path_col, text_col), df, path_col, text_col)


def html_graph(df: DataFrame, path_col: str = "source_path", html_col: str = "html") -> DataFrame:
    """The document's span is that of its blocks joined by blank lines, as all spans of a page; its hash is the source's."""
    return assemble(html_blocks(df, path_col, html_col), df, path_col, html_col, joined=True)


# Which files are pages and which are text.
HTML_EXTENSIONS = (".html", ".htm")
TEXT_EXTENSIONS = (".md", ".txt", ".rst")


def file_graph(df: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """The trees of files by their extensions: code, pages, and text for all others."""
    kind = extension(F.col(path_col))
    code, page = kind.isin(*CODE_EXTENSIONS), kind.isin(*HTML_EXTENSIONS)
    trees = [text_graph(df.where(~(code | page)), path_col, text_col), html_graph(df.where(page), path_col, text_col), code_graph(df.where(code), path_col, text_col)]
    return reduce(lambda a, b: a.unionByName(b.select(*a.columns)), trees)


def property_graph(tree: DataFrame, files: DataFrame, path_col: str = "source_path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files: each file, its structure (contains) and its links (references, cites)."""
    at = lambda c: stable_id(F.col("path"), F.lit("heading"), F.col(c))
    file = files.select(file_node_id(F.col(path_col)).alias("node_id"), F.lit("file").alias("node_type"), F.element_at(F.split(path_col, "/"), -1).alias("label"), F.col(path_col).alias("source_path"))
    inside = tree.select(at("node_id").alias("node_id"), "node_type", F.col("name").alias("label"), F.col("path").alias("source_path"))
    holds = tree.select(F.when(F.col("parent_id").isNull(), file_node_id(F.col("path"))).otherwise(at("parent_id")).alias("src_id"), at("node_id").alias("dst_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    link_nodes, link_edges = extract_links(files, path_col, text_col)
    return file.unionByName(inside).unionByName(link_nodes), holds.unionByName(link_edges)


#: Files that cannot be read as text; a fixed list.
BINARY_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".odt", ".ods", ".odp", ".epub", ".rtf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp",
    ".zip", ".gz", ".tar", ".7z", ".rar", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".exe", ".dll", ".so", ".dylib", ".bin",
)


def backfill_graph(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, path_col: str = "source_path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with those of the files that have current chunks and no node yet; files that are not given or cannot be
    read as text are passed over. A node or edge that is there already stays as it is."""
    wanted = chunks.where(F.col("is_current") & (F.col("node_type") == "chunk")).select(path_col).distinct()
    wanted = wanted.join(nodes.select(F.col("source_path").alias(path_col)).distinct(), path_col, "left_anti").where(~extension(F.col(path_col)).isin(*BINARY_EXTENSIONS))
    # Stored: the trees are read several times, and their plan is long.
    todo = store(files.select(path_col, text_col).join(wanted, path_col, "left_semi"), "unread-files")
    new_nodes, new_edges = property_graph(store(file_graph(todo, path_col, text_col), "trees"), todo, path_col, text_col)
    new_nodes = new_nodes.dropDuplicates(["node_id"]).join(nodes.select("node_id"), "node_id", "left_anti")
    key = ["src_id", "dst_id", "edge_type"]
    new_edges = new_edges.dropDuplicates(key).join(edges.select(*key), key, "left_anti")
    return nodes.unionByName(new_nodes, allowMissingColumns=True), edges.unionByName(new_edges, allowMissingColumns=True)


def section_texts(tree: DataFrame, files: DataFrame, name: str, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """(path, node_id, name, text, hashes): the text under the headings and sections whose name holds the words, and the
    short hashes of its lines."""
    hit = tree.where(F.col("node_type").isin("heading", "section") & F.lower("name").contains(name.lower()))
    j = hit.join(files.select(F.col(path_col).alias("path"), F.col(text_col).alias("whole")), "path")
    text = F.substr("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return j.select("path", "node_id", "name", text.alias("text"), F.transform(F.split(text, "\n"), lambda x: F.substring(F.sha2(x, 256), 1, 8)).alias("hashes"))


def boundary_headings(tree: DataFrame, size: int, max_level: int | None = None) -> DataFrame:
    """(path, start_char): headings at which a file is cut. A heading is one if every heading above it is a boundary
    whose section is longer than ``size``; sections that fit are left whole."""
    heads = tree.where("node_type = 'heading'")
    if max_level is not None:
        heads = heads.where(F.col("level") <= max_level)
    long = (F.col("end_char") - F.col("start_char")) > size
    # Levels fall along a chain, so six steps reach every heading.
    step = heads.join(heads.select("path", F.col("node_id").alias("parent_id"), F.lit(True).alias("under")), ["path", "parent_id"], "left").where("under IS NULL")
    chosen = step.select("path", "node_id", "start_char", "end_char")
    for _ in _LEVELS:
        opened = step.where(long).select("path", F.col("node_id").alias("parent_id"))
        step = heads.join(opened, ["path", "parent_id"], "left_semi")
        chosen = chosen.unionByName(step.select("path", "node_id", "start_char", "end_char"))
    return chosen.select("path", "start_char").distinct()


