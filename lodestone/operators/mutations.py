"""Table mutations as functions from tables to tables: upserts, versioning, pruning, manifests, graph edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; other rows stay."""
    return old.join(new.select(*([key] if isinstance(key, str) else key)), key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def update_columns(old: DataFrame, new: DataFrame, key: str, replace: tuple[str, ...] = ()) -> DataFrame:
    """Columns of matching rows become coalesce(new, old); those in ``replace`` become the new value even if null."""
    changed = [c for c in new.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__hit"))
    joined = old.join(n, key, "left")
    out = []
    for c in old.columns:
        if c not in changed:
            out.append(F.col(c))
        elif c in replace:
            out.append(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(f"__{c}", c).alias(c))
    return joined.select(*out)


def delete_by_id(df: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def supersede(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of the given source paths are no longer current."""
    hit = chunks.join(paths.select("source_path", F.lit(True).alias("__hit")).distinct(), "source_path", "left")
    return hit.withColumn("is_current", F.when(F.col("__hit"), False).otherwise(F.col("is_current"))).select(*chunks.columns)


def prunable(chunks: DataFrame, max_versions: int | None = None, older_than: Column | None = None) -> DataFrame:
    """Superseded chunks that may go: beyond the newest ``max_versions`` superseded versions of their source, and older
    than the cutoff (no date: kept). Of two given limits both must allow it; with none nothing goes."""
    old = chunks.where(~F.coalesce("is_current", F.lit(True)))
    may = F.lit(max_versions is not None or older_than is not None)
    if max_versions is not None:
        rank = F.dense_rank().over(Window.partitionBy("source_path").orderBy(F.col("version").desc()))
        old = old.withColumn("__rank", rank)
        may = may & (F.col("__rank") > max_versions)
    if older_than is not None:
        may = may & F.coalesce(F.col("ingested_at") < older_than, F.lit(False))
    return old.where(may).select(*chunks.columns)


def prune(chunks: DataFrame, max_versions: int | None = None, older_than: Column | None = None, key: str = "chunk_id") -> DataFrame:
    return delete_by_id(chunks, prunable(chunks, max_versions, older_than), key)


def next_versions(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    top = manifest.groupBy("source_path").agg(F.max("version").alias("top"))
    return paths.join(top, "source_path", "left").select(*paths.columns, (F.coalesce("top", F.lit(0)) + 1).alias("version"))


def manifest_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_path, state): new, changed, unchanged or removed; equal time and size, or else equal hash, is unchanged."""
    m = manifest.select("source_path", *[F.col(c).alias(f"m_{c}") for c in ("mtime_ns", "size", "file_hash")], F.lit(True).alias("known"))
    j = listing.withColumn("listed", F.lit(True)).join(m, "source_path", "full_outer")
    same = ((F.col("mtime_ns") == F.col("m_mtime_ns")) & (F.col("size") == F.col("m_size"))) | (F.col("file_hash") == F.col("m_file_hash"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return j.select("source_path", state.alias("state"))


def delete_graph_sources(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the sources go, and every edge that touches one."""
    gone = nodes.join(paths.select("source_path").distinct(), "source_path", "left_semi").select("node_id").distinct()
    kept = edges.join(gone.withColumnRenamed("node_id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept.select(*edges.columns)


def add_tags(df: DataFrame, tags: Column, column: str = "user_tags") -> DataFrame:
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return df.withColumn(column, F.array_sort(F.array_union(have, F.transform(tags, lambda t: F.lower(F.trim(t))))))


def remove_tags(df: DataFrame, tags: Column, column: str = "user_tags") -> DataFrame:
    return df.withColumn(column, F.array_except(F.coalesce(F.col(column), F.array().cast("array<string>")), F.transform(tags, lambda t: F.lower(F.trim(t)))))


def compact(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rewrite a table into evenly sized files and collect nothing."""
    (df.repartition(files) if files else df.repartition()).write.mode("overwrite").parquet(path)


def delete_all(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the empty table, one row: how many current rows there were)."""
    return df.limit(0), df.agg(F.count_if(F.coalesce("is_current", F.lit(True))).alias("deleted"))


def copy_table(target: DataFrame, source: DataFrame, key: str | list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """``target`` after the rows of ``source`` (of these columns) were copied into it by key."""
    return upsert(target, source.select(*columns) if columns else source, key)
