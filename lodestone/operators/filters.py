"""Metadata predicates. Unknown filter keys raise; null semantics are those of each key."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explore_fields, folded, glob_pattern, lenient_bool, normalize_ext, prompt_tags, query_fields, query_path, strip

EQUAL_KEYS = ("source_path", "source_name", "ext", "is_current", "node_type", "file_hash", "version")


def plain_value(value: Any) -> Any:
    """Unwraps {"$eq": v}; other operators are errors."""
    if isinstance(value, dict):
        if set(value) != {"$eq"}:
            raise ValueError(f"only $eq is supported: {value}")
        return value["$eq"]
    return value


def predicate(filters: dict[str, Any]) -> Column:
    """All conditions of a filter dict as one Column that is never null."""
    parts: list[Column] = []
    for key, raw in filters.items():
        value = plain_value(raw)
        if value is None:
            continue
        if key in EQUAL_KEYS:
            parts.append(F.col(key).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(key) == F.lit(value))
        elif key == "path_contains":
            texts = [value] if isinstance(value, str) else list(value)
            if texts:
                parts.append(reduce(lambda a, b: a | b, [F.lower("source_path").contains(t.lower()) for t in texts]))
        elif key == "ext_allow":
            parts.append(F.col("ext").isin(*value))
        elif key == "ext_deny":
            parts.append(F.col("ext").isNull() | ~F.col("ext").isin(*value))
        elif key == "cluster_id":
            parts.append(F.col("cluster_id").isin(*(value if isinstance(value, (list, tuple, set)) else [value])))
        else:
            raise ValueError(f"unknown filter: {key}")
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def get(chunks: DataFrame, ids: list[str] | None = None, filters: dict | None = None, limit: int | None = None, offset: int = 0, include: list[str] | None = None, order: str = "chunk_id") -> DataFrame:
    """Point or filter scan in a total order with paging and projection."""
    df = chunks.where(predicate(filters or {}))
    if ids is not None:
        df = df.where(F.col("chunk_id").isin(*ids))
    df = df.orderBy(order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*include) if include else df


def filter_candidates(df: DataFrame, path_contains: list[str] | None = None, ext_allow: list[str] | None = None, ext_deny: list[str] | None = None) -> DataFrame:
    """After retrieval: any path substring; a row without extension passes both lists."""
    ext = F.coalesce(F.lower("ext"), F.lit(""))
    keep = F.lit(True)
    if path_contains:
        keep = keep & reduce(lambda a, b: a | b, [F.lower("source_path").contains(t.lower()) for t in path_contains])
    if ext_allow:
        keep = keep & ((ext == "") | ext.isin(*[e.lower() for e in ext_allow]))
    if ext_deny:
        keep = keep & ((ext == "") | ~ext.isin(*[e.lower() for e in ext_deny]))
    return df.where(keep)


def time_range(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Inclusive bounds; rows without a time pass."""
    t = F.col("mtime_ns")
    keep = F.lit(True)
    if start_ns is not None:
        keep = keep & (t >= start_ns)
    if end_ns is not None:
        keep = keep & (t <= end_ns)
    return df.where(t.isNull() | keep)


def search_metadata(df: DataFrame, query: str | None = None, author: str | None = None, ext: str | None = None, limit: int = 20, order: str = "chunk_id") -> DataFrame:
    """Author and extension first, then the limit, then the path substring."""
    if author is not None:
        df = df.where(F.col("author") == author)
    if ext is not None:
        df = df.where(F.col("ext") == ext)
    df = df.orderBy(order).limit(limit)
    return df.where(F.lower("source_path").contains(query.lower())) if query else df


def inventory(df: DataFrame, fields: list[str], rows: int | None = 200, order: str = "chunk_id") -> DataFrame:
    """(field, values): sorted distinct values of each field in the first ``rows`` rows; lists are taken apart."""
    first = df.orderBy(order).limit(rows) if rows else df
    kinds = dict(first.dtypes)
    pairs = [F.struct(F.lit(f).alias("field"), (F.col(f).cast("array<string>") if kinds[f].startswith("array") else F.array(F.col(f).cast("string"))).alias("vs")) for f in fields]
    one = first.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", F.explode("p.vs").alias("v")).where("v IS NOT NULL AND v != ''")
    return one.groupBy("field").agg(F.array_sort(F.collect_set("v")).alias("values"))


def without(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on).distinct(), on, "left_anti")


def untagged(df: DataFrame, batch: int = 100, order: str = "chunk_id") -> DataFrame:
    return df.where(F.col("ai_tags").isNull() | (F.size("ai_tags") == 0)).orderBy(order).limit(batch)


def match_inventory(values: DataFrame, inventory: DataFrame, value_col: str = "value") -> DataFrame:
    """``values`` with ``matched``: the first inventory value (field values) that is equal but for case and blanks."""
    known = inventory.select(F.explode("values").alias("matched")).withColumn("__key", folded(F.col("matched"))).where("__key != ''")
    first = known.groupBy("__key").agg(F.min("matched").alias("matched"))
    return values.withColumn("__key", folded(F.col(value_col))).join(first, "__key", "left").drop("__key")


def metadata_conditions(questions: DataFrame, inventory: DataFrame, question_col: str = "question") -> DataFrame:
    """(query_id, field, value): equality conditions that a question implies, only with values that the inventory
    (field, values) holds: author and first year of the question, its keywords among the tags, and content types and
    titles that stand in it. One value a field, in the order of the question's tags or of the inventory."""
    asked = questions.select("query_id", F.lower(strip(F.coalesce(F.col(question_col), F.lit("")))).alias("text"), query_fields(F.col(question_col)).alias("f"), prompt_tags(F.col(question_col)).alias("tags"))
    as_field = lambda name: lambda x, i: F.struct(F.lit(name).alias("field"), x.alias("value"), i.alias("position"))
    wanted = asked.select(
        "query_id",
        F.explode(
            F.concat(
                F.array(as_field("author")(F.col("f.author"), F.lit(0)), as_field("year")(F.col("f.first_year"), F.lit(0)), as_field("title")(F.col("f.title"), F.lit(0))),
                *[F.transform("tags", as_field(c)) for c in ("ai_tags", "user_tags", "root_tags", "folder_tags")],
            )
        ).alias("w"),
    ).select("query_id", "w.*")
    known = inventory.select("field", F.posexplode("values").alias("order", "canonical")).withColumn("value", folded(F.col("canonical"))).where("value != ''")
    equal = wanted.withColumn("value", folded(F.col("value"))).join(known, ["field", "value"]).select("query_id", "field", "canonical", "position", "order")
    # An inventory is the distinct values of a bounded sample of rows; questions are the stated set.
    held = known.where("field IN ('content_type', 'title')")
    inside = asked.join(F.broadcast(held), F.col("text").contains(F.col("value")) & ((F.col("field") != "title") | F.col("f.title").isNull()))
    both = equal.unionByName(inside.select("query_id", "field", "canonical", F.lit(0).alias("position"), "order"))
    return both.groupBy("query_id", "field").agg(F.min_by("canonical", F.struct("position", "order")).alias("value"))


def normalized_metadata(df: DataFrame) -> DataFrame:
    """Known columns as the store keeps them: a missing cluster is 0, a missing type a chunk, current unless said otherwise."""
    kind = F.when(F.coalesce(F.col("node_type"), F.lit("")) == "", "chunk").otherwise(F.col("node_type"))
    known = {"cluster_id": F.coalesce("cluster_id", F.lit(0)), "is_current": lenient_bool(F.col("is_current")), "node_type": kind, "ext": normalize_ext(F.col("ext"))}
    checked = F.when(F.coalesce(F.col("source_path"), F.lit("")) == "", F.raise_error(F.lit("source_path is required"))).otherwise(F.col("source_path"))
    return df.withColumns({**{k: v for k, v in known.items() if k in df.columns}, "source_path": checked})


def find_files(files: DataFrame, name: str | None = None, content: str | None = None, regex: bool = False, ext: str | None = None, most: int | None = 50, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """Files whose name or text holds the words (or matches the expressions), in path order, at most ``most`` (None: all, in any order)."""
    base = F.element_at(F.split(path_col, "/"), -1)
    test = lambda c, x: c.rlike(x) if regex else F.lower(c).contains(x.lower())
    tests = [test(c, x) for c, x in ((base, name), (F.col(text_col), content)) if x]
    keep = reduce(lambda a, b: a | b, tests, F.lit(not tests))
    if ext is not None:
        keep = keep & (normalize_ext(F.regexp_extract(path_col, r"(\.[^./]+)$", 1)) == normalize_ext(F.lit(ext)))
    found = files.where(F.coalesce(keep, F.lit(False)))
    return found if most is None else found.orderBy(path_col).limit(most)


def explore(files: DataFrame, query: str, path_col: str = "source_path") -> DataFrame:
    """Files that an explore query (path part, ext:, glob) asks for."""
    asked = files.sparkSession.range(1).select(explore_fields(F.lit(query)).alias("q")).first()["q"]
    path = F.lower(F.col(path_col))
    keep = F.lit(True)
    if asked["path"]:
        keep = keep & query_path(F.col(path_col)).contains(asked["path"])
    if asked["ext"]:
        keep = keep & path.endswith(asked["ext"])
    if asked["pattern"]:
        subject = path if asked["full_path"] or "/" in asked["pattern"] else F.element_at(F.split(path, "/"), -1)
        keep = keep & subject.rlike(files.sparkSession.range(1).select(glob_pattern(F.lit(asked["pattern"]))).first()[0])
    return files.where(keep)
