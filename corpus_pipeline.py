"""From raw documents to token files: the training-data operators in sequence, each stage on what the last one kept.

Counts as part of ``lodestone.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.curriculum import mixed_order
from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.ngram_join import keep_one_of_each
from lodestone.llm.quality_rules import keep_good
from lodestone.llm.queries import END_ID, VOCABULARY
from lodestone.llm.scratch import discard, fresh_path, stage_scope
from lodestone.llm.token_binary import read_token_shards, write_token_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's thresholds reject go."""
    with stage_scope(spark, sf_dir):
        return keep_good(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    with stage_scope(spark, sf_dir):
        return keep_one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    with stage_scope(spark, sf_dir):
        return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order."""
    with stage_scope(spark, sf_dir):
        return mixed_order(docs)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them for each document doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    with stage_scope(spark, sf_dir):
        return read_token_shards(write_token_shards(docs, fresh_path(spark, "tokens"), public_tokenizers.path(VOCABULARY), END_ID))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_binary", token_binary),
]

#: Suffix automata, connected components and tokenizing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
