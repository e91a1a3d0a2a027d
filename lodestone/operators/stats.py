"""Collection statistics and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_stats(chunks: DataFrame, top: int = 10, authors: int = 20) -> dict[str, DataFrame]:
    """totals (one row), by_ext, top_files; group-bys with partial sums over one scan each."""
    per_file = chunks.groupBy("source_path").agg(F.count("*").alias("chunks"))
    shape = per_file.agg(F.count("*").alias("files"), F.round(F.avg("chunks"), 6).alias("avg_chunks"), F.max("chunks").alias("max_chunks"), F.min("chunks").alias("min_chunks"))
    rows = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("is_current", F.lit(True))).alias("current"), F.min("ingested_at").alias("first_ingested"), F.max("ingested_at").alias("last_ingested"))
    return {
        "totals": rows.crossJoin(shape),  # one row each
        "by_ext": chunks.groupBy(F.coalesce("ext", F.lit("")).alias("ext")).agg(F.count("*").alias("chunks"), F.countDistinct("source_path").alias("files")),
        "top_files": per_file.orderBy(F.desc("chunks"), "source_path").limit(top),
        "authors": chunks.where("author IS NOT NULL").select("author").distinct().orderBy("author").limit(authors) if "author" in chunks.columns else None,
    }


def counts(chunks: DataFrame) -> DataFrame:
    """total, current and files."""
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.coalesce("is_current", F.lit(True))).alias("current"), F.countDistinct("source_path").alias("files"))


def stale_counts(chunks: DataFrame) -> DataFrame:
    """What current chunks still lack, in one pass."""
    c = chunks.where(F.coalesce("is_current", F.lit(True)))
    missing = lambda x: F.count_if(F.col(x).isNull()).alias(f"no_{x}")
    return c.agg(*[missing(x) for x in ("simhash", "version", "cluster_id", "heading", "ingested_at")], F.count_if(F.coalesce("node_type", F.lit("")) == "").alias("no_node_type"), F.countDistinct(F.when(F.col("simhash").isNull(), F.col("source_path"))).alias("stale_files"))


def all_tags(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("tag")).distinct()


def usage_by(df: DataFrame, key: str, cost: str = "cost") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), 6).alias("cost"))


def period(ts: Column, unit: str) -> Column:
    """Key of a daily, weekly or monthly sum; the weekly key is the calendar year with the ISO week, as published."""
    if unit == "daily":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "weekly":
        return F.format_string("%d-W%02d", F.year(ts), F.weekofyear(ts))
    if unit == "monthly":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(unit)


def usage_by_period(df: DataFrame, unit: str, ts: str = "ts", cost: str = "cost") -> DataFrame:
    return usage_by(df.withColumn("period", period(F.col(ts), unit)), "period", cost)


def budget_status(spent: Column, budget: Column, warn: float = 0.8) -> Column:
    return F.when(budget.isNull() | (budget <= 0), "ok").when(spent >= budget, "exceeded").when(spent >= warn * budget, "warning").otherwise("ok")


def cost_estimate(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def evidence_per_source(df: DataFrame, order: str = "rank") -> DataFrame:
    """(source_path, evidence, nodes): count and distinct nodes in order of first appearance."""
    first = df.groupBy("source_path", "node_id").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return first.groupBy("source_path").agg(F.sum("n").alias("evidence"), F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]).alias("nodes"))


def is_stale(count_now: Column, count_then: Column, saved_at: Column, as_of: Column, seconds: int = 3600) -> Column:
    return (count_now != count_then) | (as_of.cast("double") - saved_at.cast("double") > seconds)


def count_differences(expected: DataFrame, actual: DataFrame, key: str = "table_name") -> DataFrame:
    j = expected.join(actual.withColumnRenamed("rows", "actual"), key, "full_outer")
    return j.select(key, F.coalesce("rows", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("ok", F.col("expected") == F.col("actual"))


def error_summary(failed: DataFrame, page_errors: DataFrame, most: int = 5) -> DataFrame:
    """(failed_documents, page_errors, sample): counts, and the first paths that failed (column position)."""
    first = failed.orderBy("position").limit(most).agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("source_path", F.lit("unknown")).alias("p")))).alias("x"))
    return failed.agg(F.count("*").alias("failed_documents")).crossJoin(page_errors.agg(F.count("*").alias("page_errors"))).crossJoin(first.select(F.transform("x", lambda v: v["p"]).alias("sample")))  # one row each


def total_usage(df: DataFrame, cost: str = "cost") -> DataFrame:
    return df.agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost"))


def rerank_estimate(candidates: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, input_tokens, output_tokens) of a reranking of each question's first k candidates."""
    text = candidates.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("n"))
    chars = F.length("question") + F.greatest(F.lit(1), F.coalesce("n", F.lit(1))) + F.coalesce("chars", F.lit(0))  # with the line ends between
    tokens = F.when(chars == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(chars / 4))).cast("long")
    return questions.join(text, "query_id", "left").select("query_id", tokens.alias("input_tokens"), F.lit(max(50, 30 * k)).cast("long").alias("output_tokens"))


def export_usage(usage: DataFrame, path: str) -> None:
    """Write the calls as CSV files with a header: timestamp (ISO 8601), provider, model, kind, input_tokens, output_tokens,
    cost (empty if unknown), in the order of time inside each file."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    columns = [stamp, "provider", "model", "kind", "input_tokens", "output_tokens", "cost"]
    usage.sortWithinPartitions("timestamp").select(*columns).write.mode("overwrite").option("header", True).csv(path)
