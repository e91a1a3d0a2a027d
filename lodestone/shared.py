"""Tables in the folder that all executors and the driver share: stored steps, indexes of registered queries."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may do without the setting: it
    gets a temporary folder. On a cluster that would be a folder of each machine's own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path for a table that goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: later steps start from the table, and lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that holds texts or files; both sides of a Python worker hold a few batches at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, for operators that send texts or files to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def folder(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of a path of any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = folder(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def discard(spark: SparkSession, path: str) -> None:
    try:
        fs, p = folder(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may have ended first; the folder belongs to the cluster's scratch space
        pass
