"""Shared scratch space: lineage is cut through tables that every executor can read again."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shared import discard, shared_dir


#: Scratch paths of the stage that runs in this context, and of the last stage of each pipeline.
_now: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)
_before: dict[tuple[str, str], list[str]] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    if (made := _now.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def stage_scope(spark: SparkSession, pipeline: str) -> Iterator[None]:
    """A stage of a pipeline (named, within its session) whose result is stored before the pipeline's next stage begins:
    the stage's scratch tables go then. Other pipelines' tables are not touched."""
    key = (spark.sparkContext.applicationId, pipeline)
    for path in _before.pop(key, []):
        discard(spark, path)
    made: list[str] = []
    token = _now.set(made)
    try:
        yield
    finally:
        _now.reset(token)
        _before.setdefault(key, []).extend(made)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for df in stored:
        discard(df.sparkSession, df._scratch_path)
