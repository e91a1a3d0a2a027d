"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) have weights that repeat; they share all words, and no source takes
more than ``most_passes`` times its own words, the excess going to the others by weight (water filling).

Order: a source's weight changes over training as w(t) = 1 + tilt (2 t - 1). Its integral F is the share of the
source's words used by time t, so the document that starts at word c of a source that takes T words is read at
t = F^-1(c / T), a square root. Documents are range-sorted by that position.

Cumulative words are prefix sums in two steps (per hash bucket of a source, then inside it), so a source with a
third of all rows is spread over ``buckets`` groups. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import count_words, private_names, text_or_empty
from .scratch import materialize

WEIGHTS = (1.0, 2.0, 3.0)
#: How the weight of a source of each weight class moves: falling, level, rising.
TILTS = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """From (source, source_size), one row a source: also target and tilt."""
    everything = Window.partitionBy()  # one row a source
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values, r: F.element_at(F.array(*map(F.lit, values)), (r % len(values) + 1).cast("int"))
    rows = sizes.withColumn("rank", rank).withColumn("weight", pick(weights, F.col("rank"))).withColumn("tilt", pick(tilts, F.col("rank")))
    rows = rows.withColumn("cap", most_passes * F.col("source_size"))
    # In ascending order of cap / weight the capped sources come first; ``level`` is words per weight if those before are capped.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - capped) / left)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"), "tilt")


def _position(share: Column, tilt: Column) -> Column:
    """F^-1 of F(t) = (1 - tilt) t + tilt t^2."""
    b = 1 - tilt
    return F.when(tilt == 0, share).otherwise((F.sqrt(b * b + 4 * tilt * share) - b) / (2 * F.when(tilt != 0, tilt)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, most_passes: int = MOST_PASSES, buckets: int = 4096) -> DataFrame:
    """``docs`` (read twice) with a struct column ``mix``: size, source_size, target, taken, start.

    size is the words of the text (runs of anything but ASCII white space; null: 0) or ``size_col``. taken counts the
    words that the mix takes, repeats included: a source takes its target, rounded to whole words, in whole passes
    over its documents in hash order and part of one more. start is the word of a pass at which the document starts.
    Null sources are one source; a document of no words takes none; documents of one id and size are dealt in any
    order, with the same counts; rows with a null id are dealt by their size. An empty table gives an empty plan.
    ``docs`` may have columns of any names; if one is called mix already, the plan's column has underscores around it.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else count_words(text_or_empty(text_col))
    key = F.xxhash64(F.col(id_col), F.lit(17))
    # All columns of ``docs`` travel in one struct, so that no name of theirs meets one of the plan's. A null source is
    # told from a source by its first part.
    source_of = lambda name: F.struct(F.col(name).isNull().alias("none"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), source_of(source_col).alias("key_source"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("size")).otherwise(F.col("key")))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)).cast("int"))

    sums = materialize(rows.groupBy("key_source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sizes = sums.groupBy("key_source").agg(F.sum("words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("key_source.none"), F.col("key_source.name")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, tilts, most_passes).select(source_of("source").alias("key_source"), "source_size", "target", "tilt")
    earlier = Window.partitionBy("key_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(targets, "key_source").drop("words")

    inside = Window.partitionBy("key_source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["key_source", "bucket"], "left")
    start = F.col("offset") + F.col("inside")
    whole = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = whole - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    mix = F.struct("size", "source_size", "target", taken.cast("long").alias("taken"), start.alias("start"), "tilt")
    # Two columns of one name would be unreadable: the plan's is called otherwise then.
    name = "mix" if "mix" not in {c.lower() for c in docs.columns} else private_names(docs, "mix")[0]
    return rows.select("doc.*", mix.alias(name))


def first_position(mix: Column) -> Column:
    """When the first pass reads the document, in [0, 1]; null if the mix does not take it."""
    return pass_position(mix, F.lit(0))


def pass_position(mix: Column, number: Column) -> Column:
    share = F.least(F.lit(1.0), (number * mix["source_size"] + mix["start"]) / F.greatest(mix["target"], F.lit(1.0)))
    return F.when(mix["taken"] > 0, _position(share, mix["tilt"]))


def mixed_order(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training sequence: rows of ``docs`` as often as the mix reads them, range-sorted by position, columns unchanged.

    A document is repeated taken / size times, rounded to whole texts. ``docs`` may have columns of any other names;
    nulls, repeats and empty tables are dealt with as in plan_mix.
    """
    planned = plan_mix(docs, id_col=id_col, **options)
    mix = F.col(planned.columns[-1])
    number, at = private_names(planned, "pass", "at")
    times = F.when(mix["size"] > 0, F.round(mix["taken"] / mix["size"])).otherwise(F.lit(0)).cast("int")
    repeated = planned.where(times > 0).withColumn(number, F.explode(F.sequence(F.lit(0), times - 1)))
    return repeated.withColumn(at, pass_position(mix, F.col(number))).orderBy(at, id_col, number).select(*[F.col(f"`{c}`") for c in docs.columns])
