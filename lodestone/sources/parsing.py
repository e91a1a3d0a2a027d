"""Files of any kind to text: one table of scanned files, each row read by its extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docx import parse_docx
from .files import decode_text, front_matter, parse_html

_PAGES = "array<struct<page_number:int,text:string>>"
#: Formats that are known and not read; their files are error records.
UNREAD = (".pdf",)


def parse_files(scanned: DataFrame) -> DataFrame:
    """(path, ext, text, metadata, pages, error) of scanned files (path, ext, content).

    Word files give Markdown headings, properties and pages; pages of HTML their blocks as Markdown, with title, author and
    description; Markdown its text after the front matter, with that as metadata; any other extension is text, UTF-8 or else
    Latin-1. Metadata without a value are left out. Null contents are empty texts, of a Word file an error.
    """
    kind = F.lower(F.coalesce("ext", F.lit("")))
    rows = scanned.select("path", "ext", "content", kind.alias("kind"))
    out = ["path", "ext", "text", "metadata", "pages", "error"]
    none, nothing = F.lit(None).cast("string").alias("error"), F.lit(None).cast(_PAGES).alias("pages")
    kept = lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & (v != "")).alias("metadata")

    word = parse_docx(rows.where("kind = '.docx'"), keep=("ext",)).select(*out)
    decoded = decode_text(rows.where(~F.col("kind").isin(".docx", *UNREAD)).withColumn("content", F.coalesce("content", F.lit(b"")))).drop("content")
    html = decoded.where(F.col("kind").isin(".html", ".htm"))
    page = parse_html(html.withColumnRenamed("text", "html"), "path").join(html.select("path", "ext"), "path")
    page = page.select("path", "ext", "text", kept(F.create_map(*[x for k in ("title", "author", "description") for x in (F.lit(k), F.col(k))])), nothing, none)
    headed = front_matter(decoded.where("kind = '.md'")).select("path", "ext", F.col("body").alias("text"), kept(F.col("meta")), nothing, none)
    plain = decoded.where(~F.col("kind").isin(".html", ".htm", ".md")).select("path", "ext", "text", F.create_map().cast("map<string,string>").alias("metadata"), nothing, none)
    unread = rows.where(F.col("kind").isin(*UNREAD)).select("path", "ext", F.lit("").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), nothing, F.concat(F.lit("no reader for "), "kind").alias("error"))
    return reduce(DataFrame.unionByName, [word, page, headed, plain, unread])
