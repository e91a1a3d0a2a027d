"""Text, identifier and parsing functions as Column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of lexical scoring.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "while", "to", "of", "in", "on", "for", "with", "as", "at", "by", "from",
    "into", "about", "over", "under", "after", "before", "between", "through", "during", "without", "is", "are", "was", "were", "be", "been", "being",
    "do", "does", "did", "done", "doing", "have", "has", "had", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my",
    "your", "his", "their", "our", "this", "that", "these", "those", "there", "here", "not", "no", "yes", "so", "than", "too", "very", "can", "could",
    "should", "would", "may", "might", "must", "will", "just", "what", "how",
)
# The stop words of query keywords.
KEYWORD_STOP_WORDS = (
    "show", "find", "paper", "papers", "document", "documents", "about", "with", "from", "into", "that", "this", "those", "these", "author", "title",
    "doi", "between", "after", "before",
)
_WORD = rf"(?<![a-zA-Z0-9'])(?!(?:{'|'.join(STOP_WORDS)})(?![a-zA-Z0-9']))[a-zA-Z0-9']{{2,}}"
# Patterns of links, references and headings.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
YEAR = r"\b(?:19|20)\d{2}\b"
KEYWORD = r"[A-Za-z][A-Za-z0-9_\-]{2,}"
AUTHOR = r"(?i)(?:author|by)\s*[:=]?\s*([A-Za-z][\w .,'-]{1,120}?)(?=\s+(?:from|between|after|before|doi|title)\b|\s+in\s+\d{4}\b|$)"
TITLE = r"(?i)(?:title\s*[:=]\s*|\"|')([^\"']{3,180})(?:\"|')"
CITED_DOI = r"(?i)\b(?:doi:|https?://doi\.org/)(10\.\d{4,}/\S+)"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
MARKDOWN_LINK = r"\[([^\]]*)\]\(([^)]+)\)"
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
HTML_HEADING = r"(?i)<h([1-6])[^>]*>(.*?)</h\1>"
BOLD_LINE = r"^\*\*(.+)\*\*$"
SECTION_HEADING = r"(?i)^(?:section|chapter|part)\s+(\d+(?:\.\d+)*)\s*[:.)-]?\s+.+$"
LIST_ITEM = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
_TRIM = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def words_of(c: Column) -> Column:
    """Lower-case words between blanks, tabs, line and form feeds, with multiplicity, as in the SQL: a vertical tab is part of
    a word, and letters are lowered one by one (a last sigma as any other, a dotted I to an i)."""
    plain = F.replace(F.replace(c, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i"))
    return F.filter(F.split(F.lower(plain), r"[ \t\n\f\r]+"), lambda x: x != "")


def normalize_whitespace(c: Column) -> Column:
    """CRLF and CR to LF, runs of blanks and tabs to one blank, three or more newlines to two, stripped."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(path: Column, file_hash: Column, index: Column) -> Column:
    return F.concat_ws(":", F.sha2(F.lower(path), 256), file_hash, index.cast("string"))


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def query_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def rerank_key(query: Column, cid: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("\n", query, cid, model), 256)


def tokenize(c: Column) -> Column:
    """Lower-case words of two characters or more without stop words; digits joined over ``.`` and ``-``."""
    joined = F.lower(F.coalesce(c, F.lit("")))
    for _ in range(2):  # once more for the separators that the first pass stepped over (1.2.3)
        joined = F.regexp_replace(joined, r"(\d)[.\-](\d)", "$1$2")
    # One search: words that are no stop word and longer than a character.
    return F.regexp_extract_all(joined, F.lit(_WORD), 0)


def lexical_score(question: Column, passage: Column) -> Column:
    """Share of the question's words in the passage, and 0.1 for each n of 4, 3, 2 with one of its first ten n-grams there.

    Both arguments are token arrays of :func:`tokenize`.
    """
    overlap = F.size(F.array_intersect(question, passage)) / F.greatest(F.lit(1), F.size(F.array_distinct(question)))
    joined = F.array_join(passage, " ")
    bonus = F.lit(0.0)
    for n in (4, 3, 2):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.size(question) - n + 1)))
        bonus = bonus + F.when(_ngram_in(question, joined, starts, n), 0.10).otherwise(0.0)
    return F.when((F.size(question) == 0) | (F.size(passage) == 0), 0.0).otherwise(overlap + bonus)


def _ngram_in(question: Column, joined: Column, starts: Column, n: int) -> Column:
    return (F.size(question) >= n) & F.exists(starts, lambda i: joined.contains(F.array_join(F.slice(question, i, F.lit(n)), " ")))


def slugify(c: Column, most: int | None = None, empty: str = "") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is not None:
        slug = F.regexp_replace(F.substring(slug, 1, most), "-+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for empty text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("long")


def format_time(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_ext(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when((e == "") | e.isNull(), F.lit(None)).when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))


def lenient_bool(c: Column, default: bool = True) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isNull(), F.lit(default)).otherwise(s.isin("1", "true", "yes", "on", "y", "t"))


def heading_prefix(path: Column, depth: int = 2) -> Column:
    return F.array_join(F.slice(path, 1, depth), " > ")


def heading_level(line: Column, plain: bool = False) -> Column:
    """Level of a heading line, else null."""
    s = strip(line)
    level = F.when(s.rlike(MARKDOWN_HEADING), F.length(F.regexp_extract(s, MARKDOWN_HEADING, 1)))
    level = level.when(s.rlike("(?s)^" + HTML_HEADING) & (heading_html(s) != ""), F.try_to_number(F.regexp_extract(s, HTML_HEADING, 1), F.lit("9")).cast("int")).when(s.rlike(BOLD_LINE), F.lit(1))
    if plain:
        dots = F.regexp_count(F.regexp_extract(s, SECTION_HEADING, 1), F.lit(r"\."))
        level = level.when(s.rlike(SECTION_HEADING), F.least(F.lit(6), dots + 1))
    return level.cast("int")


def heading_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(s, HTML_HEADING, 2), "<[^>]+>", ""), r"\s+", " "))


def heading_text(line: Column, plain: bool = False) -> Column:
    s = strip(line)
    out = F.when(s.rlike(MARKDOWN_HEADING), F.trim(F.regexp_extract(s, MARKDOWN_HEADING, 2)))
    out = out.when(s.rlike("(?s)^" + HTML_HEADING) & (heading_html(s) != ""), heading_html(s)).when(s.rlike(BOLD_LINE), F.trim(F.regexp_extract(s, BOLD_LINE, 1)))
    return out.when(s.rlike(SECTION_HEADING), s) if plain else out


def is_list_block(c: Column) -> Column:
    lines = F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: strip(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(LIST_ITEM))


def line_hashes(c: Column, size: int = 8) -> Column:
    return F.transform(F.split(c, "\n"), lambda x: F.substring(F.sha2(x, 256), 1, size))


def query_fields(c: Column) -> Column:
    """Struct of doi, author, title, first_year, last_year, keywords (at most 12, sorted) of a natural-language query."""
    text = strip(F.coalesce(c, F.lit("")))
    none = lambda x: F.when(x != "", x)
    years = F.regexp_extract_all(text, F.lit(f"({YEAR})"), 1)
    stop = F.array(*map(F.lit, KEYWORD_STOP_WORDS))
    lower = F.transform(F.regexp_extract_all(text, F.lit(KEYWORD), 0), F.lower)
    kept = F.filter(F.array_distinct(lower), lambda w: ~F.array_contains(stop, w))
    return F.struct(
        none(F.regexp_extract(text, "(?i)" + DOI, 0)).alias("doi"),
        none(F.trim(F.regexp_extract(text, AUTHOR, 1))).alias("author"),
        none(F.trim(F.regexp_extract(text, TITLE, 1))).alias("title"),
        F.get(years, F.lit(0)).alias("first_year"),
        F.get(years, F.size(years) - 1).alias("last_year"),
        F.slice(F.array_sort(kept), 1, 12).alias("keywords"),
    )


def prompt_tags(c: Column, most: int = 8) -> Column:
    """Distinct lower-case words of three letters or more, without stop words, sorted, at most ``most``."""
    stop = F.array(*map(F.lit, sorted({*STOP_WORDS, *KEYWORD_STOP_WORDS})))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(KEYWORD), 0))
    return F.slice(F.array_sort(F.filter(found, lambda w: ~F.array_contains(stop, w))), 1, most)


def topic_tags(c: Column, most: int = 8) -> Column:
    """The first ``most`` distinct words of four letters or more, in order."""
    found = F.array_distinct(F.filter(tokenize(c), lambda w: F.length(w) >= 4))
    return F.slice(found, 1, most)


def compose_query(query: Column, title: Column, author: Column, doi: Column, year: Column, keywords: Column) -> Column:
    quoted = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name + ':"'), c, F.lit('"')))
    parts = F.concat_ws(" ", quoted("title", title), quoted("author", author), F.when(F.length(doi) > 0, F.concat(F.lit("doi:"), doi)), year.cast("string"), F.array_join(keywords, " "))
    return F.when(F.length(F.trim(query)) > 0, F.trim(query)).otherwise(F.trim(parts))


def page_at(spans: Column, offset: Column) -> Column:
    """Page of the span (start, end, page) that holds an offset, else the last page."""
    inside = F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"]))
    return F.coalesce(F.get(inside, F.lit(0))["page"], F.try_element_at(spans, F.lit(-1))["page"])


def cited_numbers(answer: Column) -> Column:
    """Numbers of the [Sn] marks from 1 on, distinct, in order of first use."""
    found = F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), 1)
    return F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("int"))), lambda n: n >= 1)


def rerank_text(c: Column, most: int = 1200, kept: int = 1150) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit("\n[...truncated...]"))).otherwise(c)


def query_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("/"), F.lit("\\")), r"^\\+|\\+$", "")


def fts_terms(c: Column) -> Column:
    """Terms of a full-text query: special characters out, white space splits, lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r'["*^(){}]', " ")), r"\s+"), lambda x: x != "")


def values_of(c: Column) -> Column:
    """A list kept as JSON text, or a single value, as an array of its values that are not blank; null and blank: none."""
    text = strip(F.coalesce(c, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    listed = text.startswith("[") & parsed.isNotNull()
    kept = lambda xs: F.filter(xs, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(text == "", F.array().cast("array<string>")).when(listed, kept(parsed)).otherwise(F.array(text))


def heading_path_of(c: Column, listed: bool = False) -> Column:
    """A chunk's heading path as an array: of a list (``listed``) the names that are not blank; of JSON text as values_of."""
    if not listed:
        return values_of(c)
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def folded(c: Column) -> Column:
    """Lower case, single blanks, stripped: how inventory values are compared."""
    return F.array_join(words_of(F.coalesce(c, F.lit(""))), " ")


def candidate_relevance(distance: Column) -> Column:
    """1 - distance inside [-1, 1]; 0 without a distance."""
    return F.coalesce(F.greatest(F.least(1 - distance, F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))


def output_tokens(text: Column, max_tokens: Column) -> Column:
    """Tokens of the text if there is one, else the limit, else 0."""
    return F.when(F.length(text) > 0, estimate_tokens(text)).otherwise(F.coalesce(max_tokens, F.lit(0))).cast("long")


def user_content(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nSources:\n"), context, F.lit("\n\nWrite the answer with inline citations."))


def sub_questions(response: Column, most: int) -> Column:
    """Questions of a model's answer: a JSON list, or one inside the text, or its lines of more than 10 characters."""
    text = strip(F.coalesce(response, F.lit("")))
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    parsed = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.when(inner != "", F.from_json(inner, "array<string>")))
    listed = F.filter(F.transform(parsed, strip), lambda x: x != "")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), lambda x: F.regexp_replace(strip(x), r"^[0-9.\-) ]+", ""))
    return F.slice(F.coalesce(listed, F.filter(lines, lambda x: F.length(x) > 10)), 1, most)


def explore_fields(query: Column) -> Column:
    """Struct of path, ext, pattern (a glob), root and full_path that an explore query asks for; null: no condition."""
    words = F.filter(F.split(strip(F.coalesce(query, F.lit(""))), r"\s+"), lambda x: x != "")
    flags = F.array(F.lit("--full-path"), F.lit("full_path"))
    raw = F.array_join(F.filter(words, lambda x: ~F.array_contains(flags, x)), " ")
    named, glob = F.lower(raw).rlike("^(?:ext|type):"), raw.rlike(r"[*?\[]")
    dotted = raw.startswith(".") & ~raw.rlike(r"[/\\]")
    ext = F.when(named, strip(F.regexp_replace(raw, "^[^:]*:", ""))).when(~glob & dotted, raw)
    ext = F.when(F.length(ext) > 0, F.lower(F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))))
    path = F.when((raw != "") & ~named & ~glob & ~dotted, raw)
    return F.struct(
        query_path(path).alias("path"),
        ext.alias("ext"),
        F.when(~named & glob, F.lower(raw)).alias("pattern"),
        F.when(raw == "", F.lit("All files")).otherwise(raw).alias("root"),
        F.arrays_overlap(words, flags).alias("full_path"),
    )


def glob_pattern(c: Column) -> Column:
    """A glob (``*``, ``?``, character sets) as a regular expression for whole names."""
    quoted = F.regexp_replace(c, r"([.\\+^$(){}|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
