"""Quality rules with thresholds learnt per language and source.

Each metric's distribution is kept as a quantile sketch of logarithmic buckets (relative error ``ERROR``): counts per
bucket, which merge by addition. Sketches are taken per language and source over all documents and merged upwards
(per language, over everything). Documents with none of what a metric counts are a number of their own beside the buckets,
so that a metric that is zero nearly everywhere has a threshold of its group too: where the zeros reach past the quantile,
the near end of the least bucket that is not zero. A threshold is a tail quantile of its group's sketch, moved outwards by ``reach`` times
its distance from the median (of the values that are not zero, for upper bounds). Every group's threshold is a weighted mean of its own and its language's, and that of the
language of its own and the whole corpus's; the parent counts as ``prior`` documents, so a group of few documents leans on
its parent and one of many does not, without a step between. Documents are joined with their group's thresholds and judged.

Only DataFrame functions are used. The sketches' sums do not depend on how rows are dealt, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import NOT_SPACE, let, plain_words, private_names, text_or_empty
from .scratch import materialize

ERROR = 0.04
#: Metric: the quantiles beyond which a document is unlike its group (None: no bound on that side).
TAILS = {
    "symbol_share": (None, 0.90),
    "dup_line_share": (None, 0.99),
    "repeat_share": (None, 0.99),
    "word_length": (0.01, 0.99),
}
REACH = 0.5
PRIOR = 100


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that come twice or more, the first time included (windows compared by 64-bit hash)."""

    def covered(grams: Column) -> Column:
        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(let(pairs, positions), length))

    grams = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.slice(grams, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), covered)).cast("long")


def with_metrics(docs: DataFrame, text_col: str = "text", out: str = "metrics") -> DataFrame:
    """``docs`` with a struct ``out`` of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (null text: zeros)."""
    words_col, lines_col = private_names(docs, "words", "lines")
    text = text_or_empty(text_col)
    parts = docs.withColumn(words_col, plain_words(text)).withColumn(lines_col, F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)))
    words, lines = F.col(words_col), F.col(lines_col)
    return parts.withColumn(
        out,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        ),
    ).drop(words_col, lines_col)


def _measure(m: Column, name: str) -> Column:
    share = {
        "symbol_share": m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
        "dup_line_share": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_share": m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)),
        "word_length": m["word_chars"] / F.greatest(m["n_words"], F.lit(1)),
    }
    return share[name]


def _base_failed(m: Column, least_words: int) -> Column:
    return (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def quantile_sketches(measured: DataFrame, keys: list[str], metrics: str, least_words: int) -> DataFrame:
    """(keys, metric, bucket, n) over the documents that pass the base rules; the bucket of zeros is null."""
    m = F.col(metrics)
    step = math.log((1 + ERROR) / (1 - ERROR))
    values = F.array(*[F.struct(F.lit(k).alias("metric"), _measure(m, k).alias("x")) for k in TAILS])
    rows = measured.where(~_base_failed(m, least_words)).select(*keys, F.explode(values).alias("v"))
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.log(F.col("v.x")) / step)).cast("int")
    return rows.groupBy(*keys, F.col("v.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


_BOUNDS = [f"{k}_{side}" for k, ends in TAILS.items() for side, q in zip(("lower", "upper"), ends) if q is not None]


def _thresholds_of(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """One row per group: n and the bounds. Quantiles are the far ends of their buckets, so that values that a sketch
    cannot tell from the quantile are inside."""
    growth = (1 + ERROR) / (1 - ERROR)
    group = Window.partitionBy(*keys, "metric")
    zeros = F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(F.lit(0))).over(group)
    ranked = sketch.withColumn("all", F.sum("n").over(group)).withColumn("zeros", zeros).where("bucket IS NOT NULL")
    ranked = ranked.withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    top, bottom = F.pow(F.lit(growth), F.col("bucket")), F.pow(F.lit(growth), F.col("bucket") - 1)
    least = lambda k, reached, value: F.min(F.when((F.col("metric") == k) & reached, value))
    at = lambda k, q, value: least(k, F.col("zeros") + F.col("upto") >= q * F.col("all"), value)
    columns = []
    for k, (low, high) in TAILS.items():
        if low is not None:
            lowest = F.when(F.max(F.when(F.col("metric") == k, F.col("zeros") >= low * F.col("all"))), F.lit(0.0)).otherwise(at(k, low, bottom))
            columns.append((lowest - reach * (at(k, 0.5, bottom) - lowest)).alias(f"{k}_lower"))
        if high is not None:
            middle = least(k, F.col("upto") >= 0.5 * (F.col("all") - F.col("zeros")), top)
            past = F.max(F.when(F.col("metric") == k, F.col("zeros") >= high * F.col("all")))
            highest = F.when(past, least(k, F.lit(True), bottom)).otherwise(at(k, high, top))
            columns.append((highest + reach * F.greatest(F.lit(0.0), highest - middle)).alias(f"{k}_upper"))
    return ranked.groupBy(*keys).agg(F.max("all").alias("n"), *columns)


def adaptive_thresholds(measured: DataFrame, lang_col: str, source_col: str, metrics: str = "metrics", least_words: int = 50, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """One row per language and source (nulls are groups too) with a document that passes the base rules: lang, source
    and the bounds that hold there. ``measured`` may have any other columns."""
    keyed = measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(metrics).alias("m"))
    sketch = materialize(quantile_sketches(keyed, ["lang", "source"], "m", least_words), "sketches")
    merged = lambda keys: sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = _thresholds_of(merged([]).withColumn("all_of", F.lit(1)), ["all_of"], reach)
    by_lang = _thresholds_of(merged(["lang"]), ["lang"], reach).withColumn("all_of", F.lit(1))
    fine = _thresholds_of(sketch, ["lang", "source"], reach)
    # A group without any value above zero has no bound of its own, and one whose parents have none has none at all.
    lean = lambda parent: [F.coalesce((F.col("n") * F.col(b) + prior * parent[b]) / (F.col("n") + prior), F.col(b), parent[b]).alias(b) for b in _BOUNDS]
    packed = lambda df, *keys: df.select(*keys, F.struct(*_BOUNDS).alias("parent"))
    by_lang = by_lang.join(packed(overall, "all_of"), "all_of").select("lang", *lean(F.col("parent")))
    parents = packed(by_lang, F.col("lang").alias("of"))
    return fine.join(parents, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "source", *lean(F.col("parent")))


def judge(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", metrics: str = "metrics", least_words: int = 50, out: tuple[str, str] = ("base_failed", "kept")) -> DataFrame:
    """``measured`` (read more than once: give a stored table) with two booleans named by ``out``; other columns unchanged."""
    lang, source, bounds = private_names(measured, "lang", "source", "bounds")
    # Stored, its size is known: one row a group is broadcast if it is small, and documents are not shuffled for it.
    found = materialize(adaptive_thresholds(measured, lang_col, source_col, metrics, least_words).coalesce(1), "bounds")
    found = found.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*_BOUNDS).alias(bounds))
    m = F.col(metrics)
    joined = measured.join(found, F.col(lang_col).eqNullSafe(F.col(lang)) & F.col(source_col).eqNullSafe(F.col(source)), "left")
    bad = F.lit(False)
    for b in _BOUNDS:
        k, side = b.rsplit("_", 1)
        x, limit = _measure(m, k), F.col(bounds)[b]
        bad = bad | F.coalesce(x > limit if side == "upper" else x < limit, F.lit(False))
    failed = _base_failed(m, least_words)
    return joined.withColumn(out[0], failed).withColumn(out[1], ~failed & ~bad).drop(lang, source, bounds)


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, metrics, base_failed, kept.

    A document fails the base rules with fewer than ``least_words`` words or with over half of its words inside
    repeated 3-word windows; one that passes is kept if every metric is inside its group's thresholds. Null and empty
    texts have no words and fail. Null languages and sources are groups of their own. Repeated rows are judged alike; an
    empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = materialize(with_metrics(slim).drop("text"), "metrics")
    return judge(measured)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, whatever their names (see apply_quality_rules)."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stored = materialize(with_metrics(slim).drop("text"), "measured")
    return judge(stored).where("kept").select("row.*")
