"""The memory store: candidates, promotion, search under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_expiry(expires_at: Column, pinned: Column, now: Column, cap_days: int) -> Column:
    """Pinned: never; else the earlier of the given expiry and now + cap."""
    limit = now + F.make_dt_interval(F.lit(cap_days))
    return F.when(pinned, F.lit(None)).otherwise(F.least(F.coalesce(expires_at, limit), limit))


def has_all_tags(have: Column, required: Column) -> Column:
    return F.size(F.array_except(F.transform(required, F.lower), F.transform(F.coalesce(have, F.array().cast("array<string>")), F.lower))) == 0


def token_cost(*fields: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(F.struct(*fields))) / 4)).cast("long")


def set_status(candidates: DataFrame, ids: DataFrame, status: str, key: str = "candidate_id") -> DataFrame:
    hit = candidates.join(ids.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    return hit.withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).select(*candidates.columns)


def mark_used(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    hit = memories.join(ids.select("memory_id", F.lit(True).alias("__hit")).distinct(), "memory_id", "left")
    return hit.withColumn("last_used_at", F.when(F.col("__hit"), at).otherwise(F.col("last_used_at"))).select(*memories.columns)


def search(memories: DataFrame, candidates: DataFrame, as_of: Column, scope: str | None = None, memory_type: str | None = None, tags: list[str] | None = None, limit: int = 20, token_budget: int | None = None) -> DataFrame:
    """Promoted, unexpired memories, pinned and recently used first; tags are tested after the first 5 * limit rows, and
    the result is the longest prefix within the token budget (column tokens)."""
    df = memories.join(candidates.where("status = 'promoted'").select("memory_id"), "memory_id").where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    if scope is not None:
        df = df.where(F.col("scope") == scope)
    if memory_type is not None:
        df = df.where(F.col("type") == memory_type)
    order = [F.desc("pinned"), F.desc_nulls_last("last_used_at"), F.col("memory_id")]
    df = df.orderBy(*order).limit(5 * limit)
    if tags:
        df = df.where(has_all_tags(F.col("tags"), F.array(*map(F.lit, tags))))
    df = df.orderBy(*order).limit(limit)
    if token_budget is None:
        return df
    spent = F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # at most ``limit`` rows
    return df.withColumn("spent", spent).where(F.col("spent") <= token_budget)


def budget_prefix(df: DataFrame, by: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their tokens fit the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(tokens).over(w)).where(F.col("spent") <= budget)


def list_candidates(memories: DataFrame, candidates: DataFrame, status: str | None = None, limit: int = 1000) -> DataFrame:
    c = candidates if status is None else candidates.where(F.col("status") == status)
    return c.join(memories, "memory_id").orderBy(F.desc("created_at"), "candidate_id").limit(limit)


def put_candidates(memories: DataFrame, candidates: DataFrame, new: DataFrame, now: Column, caps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(memories, candidates) after new memories (with candidate_id, provenance, rationale) came in: their expiry is
    capped by type (days; pinned: never), and each has a pending candidate."""
    cap = F.lit(None).cast("int")
    for kind, days in caps.items():
        cap = F.when(F.col("type") == kind, F.lit(days)).otherwise(cap)
    limit = now + F.make_dt_interval(cap)
    given = F.col("expires_at").cast("timestamp")
    expiry = F.when(F.col("type") == "pinned", F.lit(None)).when(cap.isNull(), given).otherwise(F.least(F.coalesce(given, limit), limit))
    stored = new.withColumn("expires_at", expiry)
    pending = new.select("candidate_id", "memory_id", F.trim("provenance").alias("provenance"), F.trim("rationale").alias("rationale"), F.lit("pending").alias("status"), now.alias("created_at"))
    return memories.unionByName(stored.select(*memories.columns)), candidates.unionByName(pending.select(*candidates.columns))


def expire(memories: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """Candidates of memories that have expired are marked so; rejected ones stay rejected."""
    gone = memories.where(F.col("expires_at") <= as_of).select("memory_id", F.lit(True).alias("__gone"))
    j = candidates.join(gone, "memory_id", "left")
    return j.withColumn("status", F.when(F.col("__gone") & (F.col("status") != "rejected"), "expired").otherwise(F.col("status"))).select(*candidates.columns)
