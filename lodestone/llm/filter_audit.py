"""Interaction audit of corpus filters: what every filter does in every order of application.

A document's failures are a bit mask. Per part of the corpus the documents (all, good, toxic) are counted by mask, and a
subset-zeta transform turns the counts into survivors of every subset of filters: the survivors of a set are the documents
whose mask meets none of its bits. A step of an order is then the difference of two neighbouring subsets, and so are a
filter's own rejections, its redundant ones and its Shapley sum; no order is ever run over documents.

Documents shrink to (id, text digest, part, mask) before anything is shuffled. A repeat is found by the smallest id of its
digest, which is summed up before the shuffle, and by a join on digest and id together, so that a text of any number of
copies is spread over the tasks. What is left for the transform is at most a row for each part and mask.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, plain_words, text_or_empty
from .scratch import materialize

#: Production filters: name (one character) and what makes a text, given with its words, fail.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that rejects texts of which a document with a smaller id has an equal one.
REPEATS = "E"
_COUNTS = ("n", "good", "toxic")


def failure_masks(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, repeats: str | None = REPEATS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, mask (bit k: fails the k-th filter, the repeats filter last). Null texts
    are empty ones and null parts the empty string. A row without an id is never a repeat, nor does it make one."""
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = lambda words: reduce(lambda a, b: a.bitwiseOR(b), [F.when(f(F.col("text"), words), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters.values())], F.lit(0))
    mask = let(plain_words(F.col("text")), fails).alias("mask")
    if repeats is None:
        return slim.select("doc_id", "part", mask)
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest")
    rows = materialize(slim.select("doc_id", "part", mask, digest), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    bit = F.when(repeated, F.lit(1 << len(filters))).otherwise(F.lit(0))
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(bit).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic). A document labelled more than once is good or toxic if any of its labels says so."""
    says = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = masks.join(says, "doc_id", "left").groupBy("part", "mask")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return counted.agg(F.count("*").alias("n"), total("good"), total("toxic"))


def subset_survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, survivors): for every subset of filters, by its mask, a struct of n, good and toxic documents that fail none."""
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    of_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*_COUNTS))))  # of at most 2^n_filters masks
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    start = let(of_mask, lambda m: F.transform(every, lambda s: F.coalesce(F.get(F.map_values(F.map_filter(m, lambda k, _: k == s)), F.lit(0)), none)))

    def spread(bit: int, inner: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """Add to the sets with the bit those without it: afterwards each set holds its subsets' sums in this bit."""
        added = lambda a, s: F.struct(*[(F.get(a, s)[c] + F.when(s.bitwiseAND(F.lit(bit)) != 0, F.get(a, s.bitwiseXOR(F.lit(bit)))[c]).otherwise(F.lit(0))).alias(c) for c in _COUNTS])
        return lambda a: let(F.transform(every, lambda s: added(a, s)), inner)

    # Sums over subsets of masks: the documents whose failures all lie inside a set survive the filters outside it.
    turned = lambda a: F.reverse(a)  # the complement of set s is at 2^n - 1 - s
    zeta = reduce(lambda inner, k: spread(1 << k, inner), range(n_filters), turned)
    return counts.groupBy("part").agg(start.alias("start")).select("part", let(F.col("start"), zeta).alias("survivors"))


def audit_orders(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. The bit of a filter is its place in ``names``."""
    k = len(names)
    bits = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(1 << i))])
    orders = F.lit(["".join(p) for p in itertools.permutations(names)])
    steps = subset_survivors(counts, k).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    letters = F.split("filter_order", "")
    steps = steps.withColumn("bit", F.element_at(bits, F.get(letters, F.col("step") - 1)))
    steps = steps.withColumn("before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, c: a.bitwiseOR(F.element_at(bits, c))))
    at = lambda s, c="n": F.get("survivors", s)[c]
    with_bit = lambda s: s.bitwiseOR(F.col("bit"))
    before, after, full = F.col("before"), with_bit(F.col("before")), F.lit((1 << k) - 1)
    removed = at(before) - at(after)
    # A filter meets a set of n others before it in n! (k - 1 - n)! of the orders.
    weight = F.lit([math.factorial(s.bit_count()) * math.factorial(max(0, k - 1 - s.bit_count())) for s in range(1 << k)])
    shapley = F.aggregate(F.sequence(F.lit(0), full), F.lit(0).cast("long"), lambda a, s: a + F.get(weight, s) * (at(s) - at(with_bit(s))))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at(after).alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(full.bitwiseXOR(F.col("bit"))) - at(full)).alias("unique_fails"),
        (at(before, "good") - at(after, "good")).alias("good_lost"),
        (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, repeats: str | None = REPEATS, part_col: str = "source") -> DataFrame:
    """The audit of ``filters`` and the repeats filter over ``docs`` (see audit_orders), with ``labels`` (doc_id, quality, toxic).

    Repeated rows of one id are documents of their own and fail the repeats filter only if a smaller id has the text.
    Documents without a label are neither good nor toxic. An empty table gives an empty result; other columns are ignored.
    """
    names = "".join(filters) + (repeats or "")
    if len(set(names)) != len(filters) + bool(repeats):
        raise ValueError("filters are named by one character each, all different")
    return audit_orders(mask_counts(failure_masks(docs, filters, repeats, part_col=part_col), labels), names)


ORACLE_SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), failing AS (
    SELECT doc_id, part,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
    FROM texts
), said AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)
), orders AS (
    SELECT [a, b, c, d, e] AS o FROM (
        SELECT a.bit AS a, b.bit AS b, c.bit AS c, d.bit AS d, e.bit AS e
        FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5)
), steps AS (
    SELECT list_aggregate(list_transform(o, lambda x: chr((65 + log2(x))::INT)), 'string_agg', '') AS filter_order, step::INT AS step,
        o[step] AS bit, coalesce(list_sum(o[1:step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) r(step)
), rows AS (
    SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (before | bit) = 0) AS kept,
        sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
        sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit, before
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM rows
"""
