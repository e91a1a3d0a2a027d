"""Ranking metrics over (query_id, doc_id, rank) and judgements (query_id, doc_id, score)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import children, exists


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("score > 0").select("query_id", "doc_id").distinct()


def per_query(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id, mrr and for each k recall, ndcg (binary gains); queries without judgements score 0."""
    rel = relevant(qrels)
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = results.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    sums = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        inside = (F.col("hit") == 1) & (F.col("rank") <= k)
        sums += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}")]
    q = hits.groupBy("query_id").agg(*sums).join(n_rel, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    out = [F.col("query_id"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        none = F.col("n_rel") == 0
        out += [F.round(F.when(none, 0.0).otherwise(F.col(f"h{k}") / F.greatest("n_rel", F.lit(1))), 6).alias(f"recall_{k}"), F.round(F.when(none, 0.0).otherwise(F.col(f"d{k}") / ideal), 6).alias(f"ndcg_{k}")]
    return q.select(*out)


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "query_id"])


def diversity(results: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("rank") <= k).groupBy("query_id").agg(F.round(F.countDistinct("source") / F.count("*"), 6).alias("diversity"))


def exact_quantiles(df: DataFrame, column: str, at: list[float], accuracy: int = 10_000) -> dict[float, float | None]:
    """Linearly interpolated quantiles, exact, in two passes: a sketch brackets each one between two values, and of the rows
    only those between them (some four in ``accuracy``) are sorted out; the rows below are counted. Nulls do not count."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = x.count()
    if not n:
        return dict.fromkeys(at)
    slack = 2 / accuracy + 2 / n
    ends = [min(1.0, max(0.0, q + s)) for q in at for s in (-slack, slack)]
    marks = x.agg(F.percentile_approx("x", ends, accuracy)).first()[0]
    low_of, high_of = marks[::2], marks[1::2]
    below = x.agg(*[F.count(F.when(F.col("x") < low, 1)).alias(f"b{k}") for k, low in enumerate(low_of)]).first()
    out: dict[float, float | None] = {}
    for k, q in enumerate(at):
        place = q * (n - 1) - below[k]  # the place of the quantile among the rows between its marks
        lower = int(place)
        inside = x.where(F.col("x").between(low_of[k], high_of[k])).groupBy("x").agg(F.count("*").alias("c"))
        upto = inside.withColumn("upto", F.sum("c").over(Window.orderBy("x")))  # the rows of one bracket
        r = upto.agg(F.min(F.when(F.col("upto") > lower, F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > lower + 1, F.col("x"))).alias("b")).first()
        out[q] = r["a"] if place == lower or r["b"] is None else r["a"] + (r["b"] - r["a"]) * (place - lower)
    return out


def latency(df: DataFrame, column: str) -> DataFrame:
    """Mean and linearly interpolated percentiles."""
    found = exact_quantiles(df, column, [0.5, 0.95, 0.99])
    named = [F.lit(None if v is None else round(v, 6)).cast("double").alias(f"p{round(100 * q)}") for q, v in found.items()]
    return df.agg(F.round(F.avg(column), 6).alias("mean")).select("mean", *named)


def compare(current: DataFrame, baseline: DataFrame, key: str = "metric") -> DataFrame:
    j = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), key)
    return j.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 6))


def _baseline(folder: str, name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("names of baselines are letters, digits, dashes and underscores")
    return f"{folder}/{name}"


def save_baseline(run: DataFrame, name: str, folder: str) -> None:
    """Keep an evaluation run under a name; one of the same name is replaced."""
    run.write.mode("overwrite").json(_baseline(folder, name))


def load_baseline(spark: SparkSession, name: str, folder: str) -> DataFrame | None:
    path = _baseline(folder, name)
    return spark.read.json(path) if exists(spark, f"{path}/_SUCCESS") else None


def list_baselines(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in children(spark, folder) if exists(spark, f"{folder}/{n}/_SUCCESS")]
