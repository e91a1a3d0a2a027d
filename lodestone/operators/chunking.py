"""Row generators: fixed windows (JVM only), structure-aware chunks, sections and outlines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOLD_LINE, HTML_HEADING, MARKDOWN_HEADING, SECTION_HEADING, normalize_whitespace, strip


def fixed_chunks(df: DataFrame, id_col: str, text_col: str = "text", size: int = 1800, overlap: int = 200, normalize: bool = True) -> DataFrame:
    """(id, chunk_index, text, start_char, end_char): sliding windows over the text; a step is size - overlap (size, if
    that is not positive). Every window is stripped, its offsets are those after that; empty ones are dropped but count."""
    step = size - overlap if size > overlap else size
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(id_col, (normalize_whitespace(text) if normalize else text).alias("__t")).where("__t != ''")
    n = F.length("__t")
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
    each = base.select(id_col, "__t", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_index"))
    raw = F.substr(F.col("__t"), (F.col("chunk_index") * step + 1).cast("int"), F.lit(size))
    each = each.withColumn("__raw", raw).withColumn("text", strip(F.col("__raw"))).where("text != ''")
    lead = F.length("__raw") - F.length(F.regexp_replace("__raw", r"^\s+", ""))
    start = F.col("chunk_index") * step + lead
    return each.select(id_col, F.col("chunk_index").cast("int"), "text", start.cast("int").alias("start_char"), (start + F.length("text")).cast("int").alias("end_char"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")


def heading_of(block: str, plain: bool = False) -> tuple[str, int] | None:
    """(text, level) if the whole block is one heading."""
    s = block.strip()
    if m := re.match(MARKDOWN_HEADING, s):
        return m[2].strip(), len(m[1])
    if m := re.match(HTML_HEADING, s):
        inner = " ".join(re.sub("<[^>]+>", "", m[2]).split())
        if inner:
            return inner, int(m[1])
    if m := re.match(BOLD_LINE, s):
        return m[1].strip(), 1
    if plain and (m := re.match(SECTION_HEADING, s)):
        return s, min(6, m[1].count(".") + 1)
    return None


def paragraphs(text: str, plain: bool = False) -> list[dict]:
    """Blank-line blocks with offsets, and the heading over each."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, heading, at = [], None, 0
    for block in re.split(r"\n\s*\n", text):
        body = block.strip()
        if not body:
            at += len(block) + 2
            continue
        start = max(text.find(body, at), 0) if text.find(body, at) >= 0 else at
        found = heading_of(body, plain)
        heading = found[0] if found else heading
        out.append({"text": body, "heading": heading, "level": found[1] if found else None, "start": start, "end": start + len(body), "start_line": text.count("\n", 0, start) + 1, "end_line": text.count("\n", 0, start + len(body)) + 1})
        at = start + len(body)
    return out


def structure_chunks_of(text: str, size: int = 1800, overlap: float = 0.25, max_depth: int | None = None) -> list[dict]:
    """Sentences packed up to ``size`` characters inside the sections that boundary headings make.

    A boundary heading (level within ``max_depth``; None: all) ends a chunk and is not text itself; other headings are
    text. A sentence that is too long stays whole. After a chunk that was full, its last sentences come again while
    they fit ``overlap`` (a share of size). end_char is start_char plus the chunk's length.
    """
    spare = int(size * min(1.0, max(0.0, overlap)))
    chunks: list[dict] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    start = None

    def length(xs: list[str]) -> int:
        return sum(map(len, xs)) + max(0, len(xs) - 1)

    def flush() -> None:
        nonlocal held, start
        body = " ".join(held).strip()
        if body:
            chunks.append({"text": body, "heading": path[-1][1] if path else None, "heading_path": [t for _, t in path], "start_char": start or 0, "end_char": (start or 0) + len(body)})
        held, start = [], None

    for p in paragraphs(text):
        if p["level"] is not None and (max_depth is None or p["level"] <= max_depth):
            flush()
            while path and path[-1][0] >= p["level"]:
                path.pop()
            path.append((p["level"], p["heading"]))
            continue
        at = p["start"]
        for sentence in filter(None, map(str.strip, _SENTENCE.split(p["text"]))):
            if held and length(held) + 1 + len(sentence) > size:
                again: list[str] = []
                for s in reversed(held):
                    if sum(len(x) + 1 for x in again) + len(s) + 1 > spare:
                        break
                    again.insert(0, s)
                flush()
                held = again
            if start is None:
                start = at
            held.append(sentence)
            at += len(sentence) + 1
    flush()
    return chunks


def structure_chunks(df: DataFrame, id_col: str, text_col: str = "text", size: int = 1800, overlap: float = 0.25, max_depth: int | None = None) -> DataFrame:
    """(id, chunk_index, text, heading, heading_path, start_char, end_char) of every text; Arrow batches, no shuffle."""
    kind = dict(df.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, c["text"], c["heading"], c["heading_path"], c["start_char"], c["end_char"]) for i, t in zip(batch[id_col], batch[text_col]) if t for n, c in enumerate(structure_chunks_of(t, size, overlap, max_depth))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text", "heading", "heading_path", "start_char", "end_char"])

    return df.select(id_col, text_col).mapInPandas(cut, f"{id_col} {kind}, chunk_index int, text string, heading string, heading_path array<string>, start_char int, end_char int")


def sections(df: DataFrame, file_col: str = "source_path", order_col: str = "chunk_index", heading_col: str = "heading") -> DataFrame:
    """(file, section, heading, text, first_chunk, chunks): consecutive chunks under one heading, joined (gaps and islands)."""
    w = Window.partitionBy(file_col).orderBy(order_col)
    new = ~F.col(heading_col).eqNullSafe(F.lag(heading_col).over(w)) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__new", new.cast("int")).withColumn("section", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy(file_col, "section").agg(F.first(heading_col).alias("heading"), F.array_sort(F.collect_list(F.struct(order_col, "text"))).alias("__c"), F.min(order_col).alias("first_chunk"), F.count("*").alias("chunks"))
    return grouped.select(file_col, "section", "heading", F.array_join(F.col("__c.text"), "\n").alias("text"), "first_chunk", "chunks")


def file_outline(df: DataFrame, file_col: str = "source_path", order_col: str = "chunk_index", heading_col: str = "heading") -> DataFrame:
    """(file, headings): distinct headings in order of first appearance."""
    first = df.where(F.col(heading_col).isNotNull()).groupBy(file_col, heading_col).agg(F.min(order_col).alias("__at"))
    return first.groupBy(file_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", heading_col))), lambda x: x[heading_col]).alias("headings"))


def training_pairs(chunks: DataFrame, least: int = 50, most: int | None = None) -> DataFrame:
    """(heading, passage): current headed chunks of ``least`` characters or more, the passage cut at 500."""
    df = chunks.where(F.coalesce("is_current", F.lit(True)) & (F.length(F.trim("heading")) > 0) & (F.length("text") >= least)).orderBy("source_path", "chunk_index")
    df = df.select("heading", F.substring("text", 1, 500).alias("passage"))
    return df.limit(most) if most else df
