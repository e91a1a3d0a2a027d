"""Incremental ingest and feed deduplication with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunking import fixed_chunks
from ..operators.mutations import manifest_diff, next_versions, supersede, upsert


def ingest_batch(listing: DataFrame, manifest: DataFrame, chunks: DataFrame, as_of, size: int = 1800, overlap: int = 200) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(chunks, manifest) after a listing (source_path, mtime_ns, size, file_hash, text): new and changed files are
    chunked under a new version, their earlier chunks superseded, unchanged files left alone."""
    state = manifest_diff(listing.drop("text"), manifest).where("state IN ('new', 'changed')").select("source_path")
    todo = next_versions(manifest, listing.join(state, "source_path", "left_semi"))
    made = fixed_chunks(todo, "source_path", "text", size, overlap).join(todo.drop("text", "size"), "source_path")
    made = made.select(F.concat_ws(":", F.sha2(F.lower("source_path"), 256), "file_hash", F.col("chunk_index").cast("string")).alias("chunk_id"), "source_path", "chunk_index", "text", "version", F.lit(True).alias("is_current"), as_of.alias("ingested_at"))
    after = upsert(supersede(chunks, state), made.select(*chunks.columns), "chunk_id")
    entries = todo.select("source_path", "mtime_ns", "size", "file_hash", "version", as_of.alias("updated_at"))
    return after, upsert(manifest, entries.select(*manifest.columns), "source_path")


def stream_documents(spark: SparkSession, folder: str, schema: StructType, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Each new Parquet file of ``folder`` reaches ``sink(batch, batch_id)`` once; a batch that is run again has the same
    id, so a sink that commits its manifest last stays correct when executors or the driver are lost."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_unseen(items: DataFrame, key: str = "item_id", ts: str = "ts", keep: str = "7 days") -> DataFrame:
    """Items of a feed whose key did not come before within ``keep``; the state is bounded by the watermark."""
    return items.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def stream_usage(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls and cost per provider and window of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "provider").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
