"""Registered queries of languages, Word files, remote pages and migrations, over files and tables made from the driver's."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import language, migration
from ..shared import fresh_path, small_batches
from ..sources.docx import parse_docx
from ..sources.parsing import parse_files
from .registry import Tables, query

_ODD = "doc_id % 2 = 1"


@query()
def detected_languages(t: Tables) -> DataFrame:
    """Documents of even ids are labelled, all are told; the labels of the others say how well."""
    profiles = language.fit_profiles(t.documents.where("doc_id % 2 = 0"))
    return language.detect_languages(t.documents, profiles)


@query("SELECT count(*) AS told, true AS good FROM {documents} WHERE doc_id % 2 = 1 AND length(regexp_replace(substr(text, 1, 2000), '^\\s+|\\s+$', '', 'g')) >= 20 AND regexp_matches(substr(text, 1, 2000), '[a-zA-Z][a-zA-Z]')")
def language_accuracy(t: Tables) -> DataFrame:
    """Texts of odd ids that are long enough and have letters, and whether nine in ten are told their own language."""
    long = (F.length(strip(F.substring("text", 1, 2000))) >= 20) & F.substring("text", 1, 2000).rlike("[a-zA-Z]{2}")
    j = detected_languages(t).join(t.documents.where(_ODD).where(long).select("doc_id", "lang"), "doc_id")
    right = F.count(F.when(F.col("language") == F.col("lang"), 1))
    return j.agg(F.count("*").alias("told"), (right >= 0.9 * F.count("*")).alias("good"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _word_file(title: str, author: str, lines: list[str]) -> bytes:
    """A Word file of a heading, paragraphs, and a page break before the second of them."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    para = lambda s, props="", lead="": f'<w:p>{props}<w:r>{lead}<w:t xml:space="preserve">{escape(s)}</w:t></w:r></w:p>'
    body = para(title, '<w:pPr><w:pStyle w:val="H2"/></w:pPr>') + "".join(para(s, lead='<w:br w:type="page"/>' if k == 1 else "") for k, s in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{_W}"><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", f'<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{escape(author)}</dc:creator></p>')
    return out.getvalue()


@query("""WITH turns AS (SELECT conv_id, string_agg(CASE WHEN t <> '' THEN t END, chr(10) ORDER BY turn) AS body, count(*) AS n FROM (SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x1f]+', ' ', 'g') AS t FROM {conversations}) GROUP BY conv_id)
SELECT conv_id, '## Talk ' || conv_id || coalesce(chr(10) || body, '') AS text, 'A' || conv_id AS author, CASE WHEN n > 1 THEN 2 ELSE 0 END AS last_page FROM turns""")
def word_files(t: Tables) -> DataFrame:
    """Every conversation written as a Word file, a paragraph a turn, and read again."""
    talks = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", r"[\x00-\x1f]+", " ").alias("t")))), lambda x: x["t"]).alias("turns"))  # the turns of one talk

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["conv_id"], "content": [_word_file(f"Talk {c}", f"A{c}", list(x)) for c, x in zip(b["conv_id"], b["turns"])]})

    made = talks.mapInPandas(write, f"path {dict(talks.dtypes)['conv_id']}, content binary")
    found = parse_docx(made).where("error IS NULL")
    last = F.coalesce(F.array_max(F.transform("pages", lambda p: p["page_number"])), F.lit(0))
    return found.select(F.col("path").alias("conv_id"), "text", F.col("metadata")["author"].alias("author"), last.alias("last_page"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders}")
def migrated_orders(t: Tables) -> DataFrame:
    """Copied in ranges by a run that stops after two, and by another that goes on."""
    source, path = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), fresh_path(t.spark, "migration")
    migration.Migration(source, path, "o_orderkey", ranges=5).run(most=2)
    again = migration.Migration(source, path, "o_orderkey", ranges=9)  # the ranges of the first run hold
    again.run()
    return again.table()


@query(r"""WITH x AS (SELECT doc_id, text, regexp_replace(text, '[\x00-\x09\x0b-\x1f]+', ' ', 'g') AS clean FROM {documents})
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
    ELSE '## Doc ' || doc_id || coalesce(chr(10) || nullif(array_to_string(list_filter(string_split(clean, chr(10)), lambda s: s <> ''), chr(10)), ''), '') END) AS digest,
  CASE doc_id % 3 WHEN 1 THEN 'T ' || doc_id WHEN 2 THEN 'A' || doc_id END AS named FROM x""")
def parsed_files(t: Tables) -> DataFrame:
    """Whole documents as text, as Markdown under front matter and as Word files of their lines, told apart by extension."""
    d = F.col("doc_id")
    clean = F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]+", " ")
    head = F.concat(F.lit("---\ntitle: T "), d.cast("string"), F.lit("\nnone:\n---\n\n"))
    plain = t.documents.where("doc_id % 3 < 2").select(
        d.cast("string").alias("path"),
        F.when(d % 3 == 0, ".txt").otherwise(".md").alias("ext"),
        F.encode(F.when(d % 3 == 0, F.col("text")).otherwise(F.concat(head, "text")), "UTF-8").alias("content"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in (whole.iloc[lo : lo + 64] for lo in range(0, len(whole), 64)):
                yield pd.DataFrame({"path": b["doc_id"].astype(str), "content": [_word_file(f"Doc {i}", f"A{i}", x.split("\n")) for i, x in zip(b["doc_id"], b["clean"])]})

    small_batches(t.spark)
    word = t.documents.where("doc_id % 3 = 2").select("doc_id", clean.alias("clean")).mapInPandas(write, "path string, content binary")
    # The extension stands outside of what Python writes, so that readers of other kinds don't have Word files written.
    found = parse_files(plain.unionByName(word.withColumn("ext", F.lit(".docx"))))
    named = F.coalesce(F.try_element_at("metadata", F.lit("title")), F.try_element_at("metadata", F.lit("author")))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("digest"), named.alias("named"))
