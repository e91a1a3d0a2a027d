"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import count_words, text_or_empty
from .curriculum import first_position, plan_mix
from .decontaminate import find_contamination
from .filter_audit import audit_filters
from . import filter_audit, line_dedup, vector_codes
from .license_scan import scan_licenses
from .ngram_join import similar_sets
from .private_data import BASE_KINDS, find_private_data, joined
from .quality_rules import apply_quality_rules
from .scratch import fresh_path, materialize
from .substring_dedup import remove_repeated_passages
from .token_binary import read_token_shards, write_token_shards
from .token_counts import count_tokens
from .vector_codes import compress_vectors
from .word_bpe import decode_ids, encode_texts

#: The vocabulary and the end-of-document id of the production token files.
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: The vocabulary of BPE with word ends.
WORDS = "word_bpe_49k.json"
#: The vocabulary of the unigram token counts.
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private_data(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", count_words(text_or_empty("text")).alias("n_words"))
    planned = plan_mix(materialize(docs, "sizes"), size_col="n_words").withColumn("position", first_position(F.col("mix")))
    return planned.orderBy("position", "doc_id").select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "position")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_site_lines(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "metrics.n_words", "metrics.word_chars", "metrics.n_symbols", "metrics.n_dup_lines", "metrics.n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(_table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_token_shards(_table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), public_tokenizers.path(VOCABULARY), END_ID)
    return read_token_shards(shards)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(WORDS)
    encoded = encode_texts(_table(spark, sf_dir, "documents"), path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode_ids(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_private_data": op2_private_data,
        "op3_curriculum_mix": op3_curriculum_mix,
        "op4_line_dedup": op4_line_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scan": op8_license_scan,
        "op9_ngram_join": op9_ngram_join,
        "op10_token_binary": op10_token_binary,
        "op11_filter_audit": op11_filter_audit,
        "op12_word_bpe": op12_word_bpe,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op13_vector_codes": vector_codes.oracle_sql()}
