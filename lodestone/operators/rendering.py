"""Context blocks, citations and source formatting of small ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited_numbers, slugify, strip


def _pair(name: str, c: Column) -> Column:
    return F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(f"{name}="), c.cast("string")))


def source_block(rank: Column, path: Column, text: Column, **fields: Column) -> Column:
    locator = F.concat_ws(" ", *[_pair(k, v) for k, v in fields.items()])
    head = F.concat(F.lit("[S"), rank.cast("string"), F.lit("] "), F.coalesce(path, F.lit("unknown")), F.when(locator != "", F.concat(F.lit(" ("), locator, F.lit(")"))).otherwise(F.lit("")))
    return F.concat(head, F.lit("\n"), strip(F.coalesce(text, F.lit(""))), F.lit("\n"))


def context_block(df: DataFrame, fields: tuple[str, ...] = ("source_name", "chunk_index", "ext")) -> DataFrame:
    """(query_id, context): the blocks of each query's candidates in rank order. A query has at most k candidates."""
    block = source_block(F.col("rank"), F.col("source_path"), F.col("text"), **{("name" if f == "source_name" else f): F.col(f) for f in fields})
    made = df.select("query_id", F.struct("rank", block.alias("block")).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return made.select("query_id", F.array_join(F.col("bs.block"), "\n\n").alias("context"))


def citations_in(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, order, cid): candidates that the answer cites, in order of first use; unknown numbers are ignored."""
    cited = answers.select("query_id", F.posexplode(cited_numbers(F.col("answer"))).alias("order", "rank"))
    return cited.join(candidates.select("query_id", "rank", "cid"), ["query_id", "rank"]).select("query_id", "order", "cid")


def entry_type(path: Column) -> Column:
    web = path.startswith("http")
    return F.when(~web & F.lower(path).endswith(".pdf"), "article").otherwise("misc")


def item_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(path.startswith("http"), "webpage").when(p.endswith(".pdf"), "journalArticle").when(p.rlike(r"\.html?$"), "webpage").otherwise("document")


def source_date(ingested_at: Column, mtime_ns: Column) -> Column:
    """When a source was ingested, else modified; null without either."""
    return F.coalesce(ingested_at.cast("timestamp"), F.when(mtime_ns != 0, F.timestamp_micros(F.floor(mtime_ns / 1000).cast("long"))))


def citations(sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, key, title, author, year, source_path, entry_type, item_type) of sources (source_path, source_name, title, author, ingested_at, mtime_ns)."""
    has = lambda c: F.col(c) if c in sources.columns else F.lit(None).cast("string")
    path = F.coalesce("source_path", F.lit("unknown"))
    title = F.coalesce(has("title"), has("source_name"), F.element_at(F.split(path, "/"), -1))
    year = F.year(source_date(has("ingested_at"), has("mtime_ns").cast("long"))).cast("string")
    key = slugify(F.concat(F.coalesce(has("author"), title), F.lit("-"), F.coalesce(year, F.lit("n.d."))), empty="source")
    return sources.select(*keep, key.alias("key"), title.alias("title"), has("author").alias("author"), year.alias("year"), path.alias("source_path"), entry_type(path).alias("entry_type"), item_type(path).alias("item_type"))


def bibtex(title: Column, author: Column, year: Column, path: Column) -> Column:
    line = lambda k, c: F.when(F.length(c) > 0, F.concat(F.lit(f"  {k} = {{"), c, F.lit("}")))
    body = F.concat_ws(",\n", F.concat(F.lit("@"), entry_type(path), F.lit("{"), slugify(F.coalesce(title, path), empty="source")), line("title", title), line("author", author), line("year", year.cast("string")), line("note", path))
    return F.concat(body, F.lit("\n}"))


def zotero(title: Column, author: Column, year: Column, path: Column) -> Column:
    kind = F.when(F.lower(path).rlike("^https?://"), "webpage").otherwise("document")
    creators = F.when(F.length(author) > 0, F.array(F.struct(F.lit("author").alias("creatorType"), author.alias("name"))))
    return F.to_json(F.struct(kind.alias("itemType"), title.alias("title"), creators.alias("creators"), year.cast("string").alias("date"), path.alias("url")))


def excerpt_answer(question: Column, text: Column, path: Column, most: int = 1200) -> Column:
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("Closest passage for: "), question, F.lit("\n\n"), cut, F.lit("\n\n["), path, F.lit("]"))


def remote_candidates(df: DataFrame) -> DataFrame:
    """Remote rows as candidates, best weighted score first: cid remote:provider:i."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("score") * F.coalesce("weight", F.lit(1.0))), "provider", "url")
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("cid", F.concat_ws(":", F.lit("remote"), "provider", F.col("rank").cast("string"))).withColumn("source_path", F.col("url"))


def local_source_note(number: Column, path: Column, chunk_index: Column, distance: Column, text: Column, tags: Column | None = None, wikilinks: bool = False) -> Column:
    """One source of a note, as Markdown: at most 500 characters of text, tags sorted and each once."""
    name = F.element_at(F.split(path, "/"), -1)
    shown = F.concat(F.lit("[["), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("]]")) if wikilinks else name
    cut = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    head = F.format_string("### Source %d: %s\n**Relevance:** %.2f | **Chunk:** %d\n**Path:** `%s`\n\n", number, shown, 1 - distance, chunk_index, path)
    tagged = F.lit("")
    if tags is not None:
        own = F.array_sort(F.array_distinct(tags))
        tagged = F.when(F.size(own) > 0, F.concat(F.lit("**Tags:** "), F.array_join(F.transform(own, lambda t: F.concat(F.lit("#"), t)), " "), F.lit("\n\n"))).otherwise("")
    return F.concat(head, tagged, F.lit("**Content:**\n```\n"), cut, F.lit("\n```\n"))


def remote_source_note(number: Column, title: Column, url: Column, snippet: Column, score: Column) -> Column:
    head = F.format_string("### Remote Source %d: %s\n**Score:** %.2f\n**URL:** %s\n", number, F.coalesce(title, F.lit("Untitled")), F.coalesce(score, F.lit(0.0)), F.coalesce(url, F.lit("")))
    return F.concat(head, F.when(F.length(snippet) > 0, F.concat(F.lit("\n**Summary:**\n> "), snippet, F.lit("\n"))).otherwise(""))


def note_sources(notes: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """(id, position, source_path, source_name, title, author) of the sources that notes list."""
    blocks = notes.select(id_col, F.posexplode(F.split(text_col, r"(?m)^[ \t]*### Source")).alias("position", "b")).where("position > 0")
    line = lambda name: F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^[ \t]*\*\*{name}:\*\*(.*)$", 1)), F.lit(""))
    path = F.nullif(F.regexp_extract("b", r"(?m)^[ \t]*\*\*Path:\*\*[^\n`]*`([^`\n]+)`", 1), F.lit(""))
    found = blocks.select(id_col, "position", path.alias("source_path"), line("Title").alias("title"), line("Author").alias("author")).where("source_path IS NOT NULL")
    return found.withColumn("source_name", F.element_at(F.split("source_path", "/"), -1))
