"""Retrieval as one lazy program over (query_id, ...) rows: profiles, post stages, context, with injected models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import filters, fusion, graph, rendering, retrieval

PROFILES = ("dense_only", "hybrid_rrf", "multi_vector", "dense_cross_rerank", "llm_rerank", "hyde_hybrid")


@dataclass
class Config:
    profile: str = "hybrid_rrf"
    k: int = 12
    k_dense: int = 100
    k_sparse: int = 100
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    min_relevance: float = 0.25
    bm25_operator: str = "or"
    per_file: int = 2
    per_section: int | None = None
    dedup_threshold: float | None = 0.8
    dedup_permutations: int = 128
    mmr_trade_off: float | None = None
    temporal_days: int | None = None
    temporal_factor: float = 1.5
    as_of_ns: int | None = None
    clusters: int | None = None
    graph_hops: int | None = None
    filters: dict = field(default_factory=dict)


@dataclass
class Models:
    """Callables over lists of texts; None where a profile does not need one."""

    cross_score: Callable[[list[str], list[str]], list[float]] | None = None
    hypothetical: Callable[[DataFrame], DataFrame] | None = None
    rank: Callable[[DataFrame], DataFrame] | None = None


class Pipeline:
    """chunks: chunk_id, text, source_path, embedding and metadata; queries: query_id, query, embedding."""

    def __init__(self, chunks: DataFrame, config: Config | None = None, models: Models | None = None, centroids: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.chunks, self.config, self.models = chunks, config or Config(), models or Models()
        self.centroids, self.nodes, self.edges = centroids, nodes, edges
        if self.config.profile not in PROFILES:
            raise ValueError(f"profile: one of {PROFILES}")

    def _corpus(self, queries: DataFrame) -> DataFrame:
        c = self.config
        df = self.chunks.where(F.coalesce("is_current", F.lit(True)) & filters.predicate(c.filters))
        if c.clusters and self.centroids is not None:
            near = retrieval.top_clusters(self.centroids, queries, c.clusters).select("cluster_id").distinct()
            df = df.join(near, "cluster_id", "left_semi")
        return df

    def _with_rows(self, ranked: DataFrame, queries: DataFrame) -> DataFrame:
        rows = self.chunks.withColumnRenamed("chunk_id", "cid")
        return ranked.join(rows, "cid").join(queries.select("query_id", "query", F.col("embedding").alias("query_vector")), "query_id")

    def _reranked(self, dense: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, cid, rank) after the local rerank. Texts are taken apart once each, however many queries found
        them, and only their keys and tokens meet the candidates."""
        found = self.chunks.withColumnRenamed("chunk_id", "cid").join(dense.select("cid").distinct(), "cid", "left_semi")
        rows = fusion.prepare_texts(found.select("cid", "source_path", "text")).drop("text")
        asked = queries.select("query_id", tokenize(F.col("query")).alias("query_tokens"))
        return fusion.local_rerank(dense.join(rows, "cid").join(asked, "query_id"), per_file=self.config.per_file, prepared=True).select("query_id", "cid", "rank")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """The profile's ranked list, before the post stages."""
        c, corpus = self.config, self._corpus(queries)
        dense_queries = queries
        if c.profile == "hyde_hybrid" and self.models.hypothetical is not None:
            made = self.models.hypothetical(queries).select("query_id", "embedding").unionByName(queries.select("query_id", "embedding"))
            dense_queries = queries.drop("embedding").join(retrieval.pool(made), "query_id")
        if c.profile == "multi_vector":
            found = retrieval.multi_vector_recall(corpus, queries, c.k_dense)
            return self._with_rows(found.select("query_id", "cid", "rank", "distance"), queries)
        dense = retrieval.knn(corpus, dense_queries, c.k_dense, id_col="chunk_id").select("query_id", "cid", "rank", "distance")
        ranked = self._reranked(dense, queries)
        if c.profile in ("dense_only", "dense_cross_rerank", "llm_rerank"):
            local = self._with_rows(ranked.join(dense.select("query_id", "cid", "distance"), ["query_id", "cid"]), queries)
            if c.profile == "dense_cross_rerank" and self.models.cross_score:
                return fusion.cross_rerank(local, self.models.cross_score)[0]
            if c.profile == "llm_rerank" and self.models.rank:
                return fusion.ranking_response(self.models.rank(local), local, c.k)
            return local
        sparse = retrieval.bm25(corpus, queries, c.k_sparse, id_col="chunk_id", operator=c.bm25_operator)
        fused = fusion.rrf(ranked, sparse, c.dense_weight, c.sparse_weight)
        out = fused.join(dense.select("query_id", "cid", "distance"), ["query_id", "cid"], "left")
        return self._with_rows(out, queries)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, cid, rank, text, ...) after graph expansion, deduplication, recency, diversity and caps."""
        c, df = self.config, self.candidates(queries)
        if c.graph_hops and self.nodes is not None:
            more = graph.expand(df, self.chunks, self.nodes, self.edges, c.graph_hops).select("query_id", "cid", F.col("graph_score"))
            rows = self._with_rows(more.withColumn("rank", F.lit(1 << 20)).drop("graph_score"), queries)
            df = fusion.anchors_first(df, rows, 1 << 20)
        if c.dedup_threshold is not None:
            df = fusion.drop_near_repeats(df, c.dedup_threshold, c.dedup_permutations)
        if c.temporal_days and c.as_of_ns is not None:
            df = fusion.temporal_boost(df, c.as_of_ns, c.temporal_days, c.temporal_factor)
        if c.mmr_trade_off is not None:
            df = fusion.mmr(df, c.mmr_trade_off, c.k)
        return fusion.top(fusion.cap_per_section(df, c.per_section) if c.per_section else df, c.k)

    def context(self, found: DataFrame) -> DataFrame:
        return rendering.context_block(found)

    def answers(self, found: DataFrame, generate: Callable[[str, str], str] | None = None) -> DataFrame:
        """(query_id, answer): generated from the context, or an excerpt below the relevance gate or without a model."""
        gate = retrieval.relevance(found).withColumn("pass", F.col("relevance") >= self.config.min_relevance)
        best = found.where("rank = 1").select("query_id", rendering.excerpt_answer(F.col("query"), F.col("text"), F.col("source_path")).alias("excerpt"))
        ready = gate.join(best, "query_id").join(self.context(found), "query_id").join(found.where("rank = 1").select("query_id", "query"), "query_id")
        if generate is None:
            return ready.select("query_id", F.col("excerpt").alias("answer"))

        def say(batches):  # noqa: ANN001, ANN202
            for b in batches:
                b["answer"] = [generate(q, x) if ok else e for q, x, ok, e in zip(b["query"], b["context"], b["pass"], b["excerpt"])]
                yield b[["query_id", "answer"]]

        return ready.mapInPandas(say, f"query_id {dict(found.dtypes)['query_id']}, answer string")
