"""Fusion, reranking, deduplication and diversity of ranked candidates (query_id, cid, rank, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import minhash_table
from ..functions.text import heading_prefix, lexical_score, tokenize
from ..shared import small_batches


def rrf(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.7, sparse_weight: float = 0.3, constant: int = 60, digits: int = 9) -> DataFrame:
    """(query_id, cid, dense_rank, sparse_rank, fused_score, rank): weight / (constant + rank), absent = one past the list."""
    d = dense.select("query_id", "cid", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "cid", F.col("rank").alias("sparse_rank"))
    n = lambda df, name: df.groupBy("query_id").agg((F.count("*") + 1).alias(name))
    j = d.join(s, ["query_id", "cid"], "full_outer").join(n(d, "nd"), "query_id", "left").join(n(s, "ns"), "query_id", "left")
    score = dense_weight / (constant + F.coalesce("dense_rank", "nd", F.lit(1))) + sparse_weight / (constant + F.coalesce("sparse_rank", "ns", F.lit(1)))
    j = j.withColumn("fused_score", F.round(score, digits)).drop("nd", "ns")
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return j.withColumn("rank", F.row_number().over(w))


def _rerank(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def lexical_rerank(df: DataFrame, query_col: str = "query", text_col: str = "text", prepared: bool = False) -> DataFrame:
    """Sorted by lexical score, ties by the rank before. ``prepared``: columns query_tokens and text_tokens are there already."""
    words = df if prepared else df.withColumn("query_tokens", tokenize(F.col(query_col))).withColumn("text_tokens", tokenize(F.col(text_col)))
    scored = words.withColumn("lexical_score", F.round(lexical_score(F.col("query_tokens"), F.col("text_tokens")), 9)).drop("query_tokens", "text_tokens")
    return _rerank(scored, F.desc("lexical_score"), F.col("rank"))


def text_key(text: Column, most: int | None = None) -> Column:
    """Digest of a text in lower case with single blanks (of that the first ``most`` characters); null for an empty one."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    key = key if most is None else F.substring(key, 1, most)
    return F.when(key != "", F.md5(key))


def drop_repeats(df: DataFrame, text_col: str = "text", most: int | None = None, prepared: bool = False) -> DataFrame:
    """The first of equal texts (see text_key); empty texts go. ``prepared``: the column text_key is there already."""
    keyed = (df if prepared else df.withColumn("text_key", text_key(F.col(text_col), most))).where("text_key IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("query_id", "text_key").orderBy("rank"))
    return _rerank(keyed.withColumn("__n", first).where("__n = 1").drop("__n", "text_key"), F.col("rank"))


def cap(df: DataFrame, group: Column, most: int | None) -> DataFrame:
    """At most ``most`` rows of each group of a query, in rank order; None or less than 1: all."""
    if most is None or most < 1:
        return df
    n = F.row_number().over(Window.partitionBy("query_id", "__g").orderBy("rank"))
    return _rerank(df.withColumn("__g", group).withColumn("__n", n).where(F.col("__n") <= most).drop("__n", "__g"), F.col("rank"))


def cap_per_file(df: DataFrame, most: int | None = 2) -> DataFrame:
    return cap(df, F.coalesce("source_path", F.lit("unknown")), most)


def cap_per_section(df: DataFrame, most: int | None = None, depth: int = 2) -> DataFrame:
    """Rows without headings are one group."""
    return cap(df, F.coalesce(heading_prefix(F.col("heading_path"), depth), F.lit("")), most)


def local_rerank(df: DataFrame, query_col: str = "query", text_col: str = "text", per_file: int = 2, pool: int = 36, prepared: bool = False) -> DataFrame:
    """Without repeats, by lexical score, at most ``per_file`` of a file. ``prepared``: see prepare_texts."""
    return cap_per_file(lexical_rerank(drop_repeats(df, text_col, prepared=prepared), query_col, text_col, prepared).where(F.col("rank") <= pool), per_file)


def prepare_texts(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Chunks with text_key and text_tokens, so that a text that many queries found is taken apart once."""
    return chunks.withColumn("text_key", text_key(F.col(text_col))).withColumn("text_tokens", tokenize(F.col(text_col)))


def temporal_boost(df: DataFrame, as_of_ns: int, days: int = 30, factor: float = 1.5) -> DataFrame:
    """Distances of rows no older than ``days`` are divided by ``factor``; sorted by distance, nulls last."""
    if factor <= 1:
        return df
    recent = F.col("mtime_ns") >= as_of_ns - days * 86_400_000_000_000
    boosted = df.withColumn("distance", F.when(F.coalesce(recent, F.lit(False)), F.col("distance") / factor).otherwise(F.col("distance")))
    return _rerank(boosted, F.asc_nulls_last("distance"), F.col("rank"))


def anchors_first(anchors: DataFrame, df: DataFrame, limit: int) -> DataFrame:
    """Anchors in front, then the rest; each cid once."""
    both = anchors.withColumn("__p", F.lit(0)).unionByName(df.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    once = F.row_number().over(Window.partitionBy("query_id", "cid").orderBy("__p", "rank"))
    both = _rerank(both.withColumn("__n", once).where("__n = 1"), F.col("__p"), F.col("rank"))
    return both.where(F.col("rank") <= limit).drop("__n", "__p")


def union_hops(df: DataFrame, limit: int) -> DataFrame:
    """Candidates of several hops (column hop): each cid once, earlier hops first."""
    once = F.row_number().over(Window.partitionBy("query_id", "cid").orderBy("hop", "rank"))
    return _rerank(df.withColumn("__n", once).where("__n = 1").drop("__n"), F.col("hop"), F.col("rank"), F.col("cid")).where(F.col("rank") <= limit)


def ranking_response(ranking: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """Valid, distinct 0-based indices of a model's ranking in order, then the remaining candidates up to k."""
    at = ranking.select("query_id", F.posexplode("indices").alias("order", "i"))
    first = at.groupBy("query_id", "i").agg(F.min("order").alias("order"))
    j = df.withColumn("i", F.col("rank") - 1).join(first, ["query_id", "i"], "left").drop("i")
    return _rerank(j, F.asc_nulls_last("order"), F.col("rank")).drop("order").where(F.col("rank") <= k)


#: Signatures that a candidate's is compared with at once.
SIGNATURES = 1024


def drop_near_repeats(df: DataFrame, threshold: float = 0.8, permutations: int = 128, text_col: str = "text") -> DataFrame:
    """Greedy in rank order: a candidate stays if it is no near duplicate of any that stayed (one query's pool at a time)."""
    # A text is signed once, however many queries found it. Only keys and signatures make a pool, not the texts.
    small_batches(df.sparkSession)
    signatures = minhash_table(df.select("cid", text_col).dropDuplicates(["cid"]), "cid", permutations, text_col).withColumnRenamed("signature", "__sig")
    keys = df.select("query_id", "cid", "rank")

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank")
        kept, n, keep = np.empty((len(pool), permutations), "<u4"), 0, []
        for sig in (np.frombuffer(x, "<u4") for x in pool["__sig"]):
            stays = not _any_near(kept[:n], sig, threshold)
            keep.append(stays)
            if stays:
                kept[n] = sig
                n += 1
        return pool[np.array(keep, bool)].drop(columns="__sig")

    stay = keys.join(signatures, "cid").select(*keys.columns, "__sig").groupBy("query_id").applyInPandas(pick, keys.schema)
    on = [df[c].eqNullSafe(stay[c]) for c in keys.columns]
    out = df.join(stay, on, "left_semi")
    return _rerank(out, F.col("rank"))


def _any_near(kept: np.ndarray, sig: np.ndarray, threshold: float) -> bool:
    """Whether any of the signatures shares that part of its slots; ``SIGNATURES`` are compared at once."""
    return any((_equal_slots(kept[lo : lo + SIGNATURES], sig) / len(sig) >= threshold).any() for lo in range(0, len(kept), SIGNATURES))


def _equal_slots(kept: np.ndarray, sig: np.ndarray) -> np.ndarray:
    same = kept == sig
    if len(sig) % 8 or len(sig) > 255:
        return same.sum(axis=1)
    # Eight slots are added at once, a byte each; the product's highest byte is the sum of the bytes.
    return same.view(np.uint64).sum(axis=1, dtype=np.uint64) * np.uint64(0x0101010101010101) >> np.uint64(56)


def mmr(df: DataFrame, trade_off: float = 0.7, k: int = 10, query_vector: str = "query_vector", vector_col: str = "embedding") -> DataFrame:
    """Greedy maximal marginal relevance on one query's pool; without vectors the first k. Ties go to the earlier rank."""
    schema = df.schema

    def select(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank").reset_index(drop=True)
        if pool[vector_col].isna().any() or pool[query_vector].isna().any():
            chosen = list(range(min(k, len(pool))))
        else:
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
            v = unit(np.array(pool[vector_col].tolist(), float))
            relevance = v @ unit(np.array(pool[query_vector].iloc[0], float))
            closest, chosen, left = np.zeros(len(v)), [], list(range(len(v)))
            while left and len(chosen) < k:
                score = np.round(trade_off * relevance[left] - (1 - trade_off) * (closest[left] if chosen else 0), 12)
                best = left.pop(int(np.argmax(score)))
                closest = np.maximum(closest, v @ v[best]) if chosen else v @ v[best]
                chosen.append(best)
        out = pool.iloc[chosen].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return df.groupBy("query_id").applyInPandas(select, schema)


def cross_rerank(df: DataFrame, score, cache: DataFrame | None = None, model: str = "model") -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Sorted by ``score(queries, texts) -> scores``; cached scores (cache_key, score) are reused, new ones returned too."""
    from ..functions.text import rerank_key

    keyed = df.withColumn("cache_key", rerank_key(F.col("query"), F.col("cid").cast("string"), F.lit(model)))
    if cache is None:
        cache = keyed.select("cache_key", F.lit(None).cast("double").alias("score")).limit(0)
    cached = keyed.join(cache.select("cache_key", F.col("score").alias("cached")), "cache_key", "left")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pool in batches:
            miss = pool["cached"].isna()
            pool["score"] = pool["cached"]
            if miss.any():
                pool.loc[miss, "score"] = list(score(pool.loc[miss, "query"].tolist(), pool.loc[miss, "text"].tolist()))
            yield pool

    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = cached.mapInPandas(fill, StructType([*cached.schema.fields, StructField("score", DoubleType())]))
    fresh = scored.where("cached IS NULL").select("cache_key", "score").distinct()
    return _rerank(scored.drop("cached", "cache_key"), F.desc("score"), F.col("rank")), fresh


def store_scores(cache: DataFrame, fresh: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The cache with new scores (cache_key, score) put in; a key that is there already gets the new score."""
    new = fresh if as_of is None else fresh.withColumn("created_at", as_of)
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new, allowMissingColumns=True)


def top(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("rank") <= k)


def merge_remote(local: DataFrame, remote: DataFrame, strategy: str = "weighted") -> DataFrame:
    """Local candidates, then remote ones: by weighted score (ties as they came), or as they came."""
    score = F.col("score") * F.coalesce("weight", F.lit(1.0))
    order = [F.desc(score), F.col("rank")] if strategy == "weighted" else [F.col("rank")]
    placed = _rerank(remote, *order)
    both = local.withColumn("__p", F.lit(0)).unionByName(placed.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return _rerank(both, F.col("__p"), F.col("rank")).drop("__p")
