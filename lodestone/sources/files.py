"""File scans and parsers: listings, Markdown front matter, HTML to text, folder tags."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Bytes below which a table's rows may be dealt anew after the scan.
SMALL_TABLE = 1 << 28
EXTENSIONS = (".txt", ".md", ".rst", ".pdf", ".docx", ".html", ".htm")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One that is small but has fewer files than there are cores is dealt anew, so that work on its
    rows (texts, vectors) is not left to the few tasks that its files make; larger ones are read as they lie."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_TABLE and len(df.inputFiles()) < cores else df


def scan_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = EXTENSIONS, exclude_dirs: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """binaryFile scan below the roots (content column read only if asked for): path, ext, size, mtime_ns, content, file_hash."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    df = df.withColumn("ext", ext).where(F.col("ext").isin(*extensions))
    if exclude_dirs:
        df = df.where(~F.arrays_overlap(folders, F.array(*map(F.lit, exclude_dirs))))
    base = ["path", "ext", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")]
    return df.select(*base, "content", F.sha2("content", 256).alias("file_hash")) if content else df.select(*base)


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """text: UTF-8, or Latin-1 where that is not valid."""
    return df.withColumn("text", F.when(F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string")).otherwise(F.decode(F.col(content), "ISO-8859-1")))


def front_matter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """meta (map of the flat ``key: value`` lines between two ``---`` at the start) and body (the stripped rest)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\s*(?:\n(.*))?$"
    head = F.regexp_extract(t, pattern, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:\s*\S"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"^[\"']|[\"']$", "")))
    there = t.rlike(pattern)
    meta = F.when(there, F.map_from_entries(F.array_distinct(entries))).otherwise(F.create_map().cast("map<string,string>"))
    return df.withColumn("meta", meta).withColumn("body", F.when(there, strip(F.regexp_extract(t, pattern, 2))).otherwise(t))


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables in order; script, style and noscript are left out."""

    SKIP, KEEP = {"script", "style", "noscript"}, {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.blocks: list[tuple[str, str]] = []
        self.plain: list[str] = []
        self.skip, self.tag, self.text, self.in_title, self.row = 0, None, [], False, None

    def _end(self) -> None:
        body = " ".join("".join(self.text).split())
        if self.tag and body:
            if self.tag in ("td", "th"):
                (self.row if self.row is not None else []).append(body)
            else:
                self.blocks.append((self.tag, body))
        self.tag, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or "").lower() in ("author", "description"):
            self.meta.setdefault(a["name"].lower(), (a.get("content") or "").strip())
        elif tag == "tr":
            self._end()
            self.row = []
        elif tag in self.KEEP:
            self._end()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("tr", "table"):
            self._end()
            if self.row:
                self.blocks.append(("tr", " | ".join(self.row)))
            self.row = None
        elif tag == self.tag:
            self._end()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.meta["title"] = (self.meta.get("title", "") + data).strip()
        elif not self.skip:
            self.plain.append(data)
            if self.tag:
                self.text.append(data)


def html_text(html: str | None) -> tuple[str, dict[str, str]]:
    """(text, meta): headings as # lines, paragraphs, list items and table rows, blank lines between; else the plain text."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p._end()
    shown = {"li": "- ", **{f"h{n}": "#" * n + " " for n in range(1, 7)}}
    body = "\n\n".join(shown.get(tag, "") + text for tag, text in p.blocks)
    return body or " ".join("".join(p.plain).split()), p.meta


def parse_html(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, title, author, description, text) of raw pages."""
    kind = dict(df.dtypes)[id_col]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [html_text(h) for h in batch[html_col]]
            yield pd.DataFrame({id_col: batch[id_col], **{k: [m.get(k) for _, m in found] for k in ("title", "author", "description")}, "text": [t for t, _ in found]})

    return df.select(id_col, html_col).mapInPandas(parse, f"{id_col} {kind}, title string, author string, description string, text string")


def html_title(html) -> object:  # noqa: ANN001
    """The title element's text, as a Column."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def folder_tags(files: DataFrame, tag_files: DataFrame) -> DataFrame:
    """(path, tags): tags of the folders above a file, root first, each once. ``tag_files``: folder, tags."""
    parts = F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))
    each = files.select("path", F.explode(folders).alias("f")).select("path", "f.*").join(tag_files, "folder")
    ordered = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "tags"))).alias("x"))
    return ordered.select("path", F.array_distinct(F.flatten(F.col("x.tags"))).alias("tags"))


def load_eval_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """queries (query_id, text), corpus (doc_id, text), qrels (query_id, doc_id, score) from three JSON files of maps."""

    def flat(name: str, schema: str, *names: str) -> DataFrame:
        raw = spark.read.text(f"{folder}/{name}.json", wholetext=True)
        return raw.select(F.explode(F.from_json("value", schema)).alias(*names))

    qrels = flat("qrels", "map<string,map<string,int>>", "query_id", "m").select("query_id", F.explode("m").alias("doc_id", "score"))
    return {"queries": flat("queries", "map<string,string>", "query_id", "text"), "corpus": flat("corpus", "map<string,string>", "doc_id", "text"), "qrels": qrels}


def tags_of(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return [str(t) for t in (found.get("tags", []) if isinstance(found, dict) else found)]


def file_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size_bytes, mtime_iso, ext) of stated files, content unread; paths that are not there are errors, as is none."""
    wanted = [p.strip() for p in paths if p.strip()]
    if not wanted:
        raise ValueError("at least one path")
    found = spark.read.format("binaryFile").load(wanted)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return found.select("path", F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("mtime_iso"), ext.alias("ext"))
