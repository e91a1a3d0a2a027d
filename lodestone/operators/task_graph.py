"""Order of tasks that depend on one another: levels by peeling, cycles as errors, groups that run together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import fresh_path, store


def _edges(deps: DataFrame) -> DataFrame:
    return deps.select("task_id", "depends_on").where("task_id IS NOT NULL AND depends_on IS NOT NULL").distinct()


def check_dependencies(tasks: DataFrame, deps: DataFrame) -> None:
    """Dependencies on tasks that are not there are errors."""
    unknown = _edges(deps).join(tasks.select(F.col("task_id").alias("depends_on")), "depends_on", "left_anti").select("task_id", "depends_on").orderBy("task_id", "depends_on").first()
    if unknown is not None:
        raise ValueError(f"task '{unknown['task_id']}' depends on unknown task id '{unknown['depends_on']}'")


def levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task_id, level): 0 without dependencies, else one past the highest level that a task depends on.

    Every round takes the tasks off whose dependencies have all been taken: it writes them, and the edges that are left. There
    are as many rounds as levels. When no task can be taken any more and edges are left, these hold a cycle.
    """
    check_dependencies(tasks, deps)
    spark = tasks.sparkSession
    every, edges = store(tasks.select("task_id").distinct(), "tasks"), store(_edges(deps), "task-edges")
    path, n = fresh_path(spark, "task-levels"), 0
    schema = StructType([every.schema["task_id"], StructField("level", IntegerType())])
    taken = spark.createDataFrame([], schema)
    while True:
        ready = every.join(edges.select("task_id").distinct(), "task_id", "left_anti").join(taken.select("task_id"), "task_id", "left_anti")
        ready.write.parquet(f"{path}/level={n}")
        now = spark.read.schema(every.schema).parquet(f"{path}/level={n}")
        if now.isEmpty():
            break
        edges = store(edges.join(now.select(F.col("task_id").alias("depends_on")), "depends_on", "left_anti").select("task_id", "depends_on"), "task-edges")
        taken, n = spark.read.schema(schema).option("basePath", path).parquet(path), n + 1
    if not edges.isEmpty():
        raise ValueError("task graph contains a dependency cycle")
    return taken


def topological_order(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """``tasks`` (task_id, position, ...) with their level, sorted by level and then by position: every task comes after
    what it depends on, and tasks of one level can run at once."""
    return tasks.join(levels(tasks, deps), "task_id").orderBy("level", "position", "task_id")


def parallel_groups(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(group_id, tasks, depends_on, level): tasks (task_id, position, parallel_group; null or empty: a group of its own)
    put together by group, the groups that a group's tasks depend on, and the group's level; groups and tasks in the order
    of the first position. A cycle among groups is an error."""
    group = F.when(F.coalesce("parallel_group", F.lit("")) != "", F.col("parallel_group")).otherwise(F.concat(F.lit("group_"), F.col("task_id").cast("string")))
    named = store(tasks.select("task_id", "position", group.alias("group_id")), "groups")
    own = named.groupBy("group_id").agg(F.min("position").alias("position"), F.transform(F.array_sort(F.collect_list(F.struct("position", "task_id"))), lambda x: x["task_id"]).alias("tasks"))
    check_dependencies(tasks, deps)
    of = named.select(F.col("task_id").alias("depends_on"), F.col("group_id").alias("other"))
    between = _edges(deps).join(named.select("task_id", "group_id"), "task_id").join(of, "depends_on").where("group_id != other").select("group_id", "other").distinct()
    at = levels(own.select(F.col("group_id").alias("task_id")), between.select(F.col("group_id").alias("task_id"), F.col("other").alias("depends_on")))
    needs = between.join(own.select(F.col("group_id").alias("other"), F.col("position").alias("p")), "other").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "other"))), lambda x: x["other"]).alias("depends_on"))
    out = own.join(needs, "group_id", "left").join(at.withColumnRenamed("task_id", "group_id"), "group_id")
    return out.select("group_id", "tasks", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), "level", "position").orderBy("level", "position", "group_id").drop("position")
