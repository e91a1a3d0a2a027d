"""The data model: chunks and the small state tables around them."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("source_name", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("is_current", T.BooleanType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("simhash", T.LongType()),
        T.StructField("ai_tags", T.ArrayType(T.StringType())),
        T.StructField("user_tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("source_path", T.StringType(), False),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
NODE = T.StructType([T.StructField(n, T.StringType()) for n in ("node_id", "node_type", "label", "source_path")])
EDGE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("src_id", "dst_id", "edge_type")], T.StructField("weight", T.DoubleType())])
