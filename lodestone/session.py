"""Session construction with the settings every operator relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lodestone", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session: UTC, ANSI left on, AQE on; ``extra`` overrides any setting."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
