"""Points in spans: which spans of a file hold an offset, as an equality join.

A span is cut into the few aligned blocks (of 1, 2, 4, … offsets) that make it up exactly, at most two of each size; a
point stands in one block of each size. Joined by file and block, a point and a span that holds it meet exactly once,
and pairs that do not belong together never meet. The keys of one large file are spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets are below 2^LEVELS.
LEVELS = 40


def _blocks(start: Column, end: Column, levels: int) -> Column:
    """The aligned blocks of [start, end): (level, block)."""
    each = []
    for k in range(levels):
        size = 1 << k
        left, right = F.floor((start + (size - 1)) / size).cast("long"), F.floor(end / size).cast("long")
        there = left < right
        block = lambda b: F.struct(F.lit(k).alias("level"), b.alias("block"))  # noqa: B023, E731
        each += [F.when(there & (left % 2 == 1), block(left)), F.when(there & (right % 2 == 1), block(right - 1))]
    return F.array_compact(F.array(*each))


def _keyed(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with __b, a row for each block that a point stands in and that a span is made of."""
    # As many block sizes as the longest span asks for: one row reaches the driver.
    longest = spans.agg(F.max(end)).first()[0]
    levels = min(LEVELS, max(1, int(longest or 0).bit_length() + 1))
    cut = spans.where((F.col(start) >= 0) & (F.col(start) < F.col(end))).withColumn("__b", F.explode(_blocks(F.col(start).cast("long"), F.col(end).cast("long"), levels)))
    stands = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at).cast("long"), k).alias("block")) for k in range(levels)])
    return points.where(F.col(at) >= 0).withColumn("__b", F.explode(stands)), cut


def stab(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """All columns of ``points`` and those of ``spans`` but ``by``, for each span [start, end) that holds the point's
    offset. Names other than ``by`` must differ. Points and spans without an offset, or with one below 0, meet nothing."""
    seen, cut = _keyed(points, spans, at, start, end)
    # Sizes are estimated without the blocks of a span, so a broadcast of them would be many times what it seems.
    return seen.join(cut.hint("merge"), [*by, "__b"]).drop("__b")


def stab_totals(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, point_value: str, span_value: str) -> DataFrame:
    """(by, pairs, checksum, deepest): of the pairs of ``stab`` their number, the sum of ``point_value`` times
    ``span_value``, and the greatest distance of a point from its span's start.

    Pairs are not made. Points of one place are one row, and so are the spans of a block, whose sums hold for every point
    in it: rows grow with the places and the blocks, while pairs grow with the product of points and spans."""
    places = points.groupBy(*by, F.col(at).alias("__at")).agg(F.count("*").alias("__n"), F.sum(point_value).alias("__v"))
    seen, cut = _keyed(places, spans, "__at", start, end)
    blocks = cut.groupBy(*by, "__b").agg(F.count("*").alias("__m"), F.sum(span_value).alias("__w"), F.min(start).alias("__from"))
    met = seen.join(blocks.hint("merge"), [*by, "__b"])
    return met.groupBy(*by).agg(F.sum(F.col("__n") * F.col("__m")).alias("pairs"), F.sum(F.col("__v") * F.col("__w")).alias("checksum"), F.max(F.col("__at") - F.col("__from")).alias("deepest"))


def enclosing_headings(chunks: DataFrame, tree: DataFrame, id_col: str = "chunk_id", path_col: str = "source_path", at: str = "start_char") -> DataFrame:
    """(id, heading_path): the names of the headings whose spans hold the chunk's first character, outermost first; chunks
    outside every heading are left out."""
    heads = tree.where("node_type = 'heading'").select(F.col("path").alias(path_col), F.col("start_char").alias("__start"), F.col("end_char").alias("__end"), F.struct("depth", F.col("start_char").alias("from"), "name").alias("__head"))
    found = stab(chunks.select(id_col, path_col, F.col(at).alias("__at")), heads, [path_col], "__at", "__start", "__end")
    # Headings nest at most six deep.
    return found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_set("__head")), lambda x: x["name"]).alias("heading_path"))


def headings_by_name(tree: DataFrame) -> DataFrame:
    """(source_path, heading, heading_path): for every heading of a file its own name under those of the headings above it;
    of equal names in a file, that of the last."""
    heads = tree.where("node_type = 'heading'").select("path", "node_id", "parent_id", "name", "start_line", "start_char", "end_line", "end_char", "depth")
    up = tree.select("path", F.col("node_id").alias("up_id"), F.col("parent_id").alias("up_parent"), F.when(F.col("node_type") == "heading", F.array("name")).otherwise(F.array().cast("array<string>")).alias("up_name"))
    step = heads.withColumn("heading_path", F.array("name")).withColumn("up_id", F.col("parent_id"))
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(max(0, deepest - 1)):
        step = step.join(up, ["path", "up_id"], "left").withColumn("heading_path", F.concat(F.coalesce("up_name", F.array().cast("array<string>")), "heading_path")).withColumn("up_id", F.col("up_parent")).drop("up_parent", "up_name")
    order = Window.partitionBy("path", "name").orderBy(*[F.desc(c) for c in ("start_line", "start_char", "end_line", "end_char", "depth", "node_id")])
    last = step.withColumn("n", F.row_number().over(order)).where("n = 1")
    return last.select(F.col("path").alias("source_path"), F.col("name").alias("heading"), "heading_path")


def backfill_heading_paths(chunks: DataFrame, tree: DataFrame) -> DataFrame:
    """``chunks`` with heading_path filled (``tree`` is read more than once: give a stored table) for current chunks that have a heading and no path: by the place where the chunk
    begins if that is known and inside a heading, else by the heading's name. Others, and other columns, stay."""
    kind = F.coalesce("node_type", F.lit("chunk")) == "chunk"
    need = F.col("heading").isNotNull() & F.col("heading_path").isNull() & kind & F.coalesce("is_current", F.lit(False))
    open_rows = chunks.where(need)
    by_place = enclosing_headings(open_rows, tree).select("chunk_id", F.col("heading_path").alias("__placed")) if "start_char" in chunks.columns else None
    by_name = headings_by_name(tree).select("source_path", "heading", F.col("heading_path").alias("__named"))
    out = chunks.join(by_name, ["source_path", "heading"], "left")
    found = F.col("__named")
    if by_place is not None:
        out = out.join(by_place, "chunk_id", "left")
        found = F.coalesce("__placed", "__named")
    return out.withColumn("heading_path", F.when(need, found).otherwise(F.col("heading_path"))).select(*chunks.columns)
