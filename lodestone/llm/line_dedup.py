"""Boilerplate lines by site-relative frequency.

Pages are grouped by host; a line that more than ``ratio`` of a host's pages contain is boilerplate there and goes.
Counts are summed per (host, line) before the shuffle, so neither a host with a third of all pages nor a line on all of
them gathers in one task; only the lines' hashes travel, and the few boilerplate hashes of a page come back to it.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->"
_BREAKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|nav|header|footer|title|head|body|html|a)\b[^>]*>"
#: Fixed entities that are read back.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_lines(html: Column) -> Column:
    """Stripped, non-empty lines of a page's text, in order."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    t = F.regexp_replace(F.regexp_replace(t, _BREAKS, "\n"), "<[^>]*>", "")
    for code, char in _ENTITIES:
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def drop_site_lines(pages: DataFrame, ratio: float = 0.5, least_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, n_lines, n_dropped, kept (the other lines, joined by line ends).

    A line goes if more than ``ratio`` of its host's pages contain it (lines compared by 64-bit hash); hosts of fewer
    than ``least_pages`` pages lose none. Null pages have no lines; pages without a host are one host, named "".
    Repeated rows are pages of their own in the counts, and rows of one id get the same lines dropped. Other columns
    are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    seen = rows.select("host", "page_id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    seen = materialize(seen, "lines")  # read twice; the pages' text is taken apart once for it
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(f"n > {ratio} * {least_pages}")
    common = counts.join(totals.where(F.col("pages") >= least_pages), "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")
    per_page = seen.join(common, ["host", "line"]).groupBy("page_id", "host").agg(F.collect_set("line").alias("gone"))  # lines of one page
    per_page = per_page.select(F.col("page_id").alias("__page"), F.col("host").alias("__host"), "gone")
    joined = rows.join(per_page, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("host") == F.col("__host")), "left")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    kept = F.when(F.size(gone) == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(x))))
    out = joined.withColumn("__kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept"))


#: DuckDB SQL of the query on ``pages``.
ORACLE_SQL = r"""
WITH t AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|nav|header|footer|title|head|body|html|a)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM pages),
  r AS (SELECT page_id, host, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10)),
      lambda l: regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda l: l <> '') AS lines FROM t),
  totals AS (SELECT host, count(*) AS pages FROM r GROUP BY host),
  counted AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM r) GROUP BY host, line),
  common AS (SELECT host, list(line) AS gone FROM counted JOIN totals USING (host) WHERE pages >= 3 AND n > 0.5 * pages GROUP BY host),
  k AS (SELECT page_id, host, lines, list_filter(lines, lambda l: NOT coalesce(list_contains(gone, l), false)) AS kept FROM r LEFT JOIN common USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k"""
