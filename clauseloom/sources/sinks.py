"""Sinks whose replay leaves the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_requirements(requirements: DataFrame, path: str, batch: int) -> None:
    """One batch of finished tasks, whole task results, under its batch number.

    A replay of a batch replaces exactly what it wrote before, and no batch touches another one's rows. Rows keep the
    layout they come in, so a large tenant is as many files as tasks wrote it.
    """
    (
        requirements.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """For every task the rows of the newest batch that holds it."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("tenant_id", "task_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["tenant_id", "task_id", "batch"], "left_semi").drop("batch")


def finished_requirements(requirements: DataFrame, tasks: DataFrame) -> DataFrame:
    """Only requirements whose task has succeeded are visible: results and state appear together."""
    done = tasks.filter("status = 'succeeded'").select("tenant_id", F.col("id").alias("task_id"))
    return requirements.join(done, ["tenant_id", "task_id"], "left_semi")


# --- requirements and task states that appear together --------------------------------------------
#
# Two tables cannot be written at once. Each try of a batch writes its rows into folders of its own, and then one row into a third table, the commits:
# that is one file, which appears whole or not at all. Readers join the commits, so what a try leaves behind without one is never seen, and
# neither is what a second worker writes that believes it still owns the batch.


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, attempt, requirements, tasks)`` of the batches that are published; of several commits of a batch the first by name counts."""
    schema = "batch long, attempt string, requirements long, tasks long"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/commits")
    return rows.groupBy("batch").agg(F.min(F.struct("attempt", "requirements", "tasks")).alias("c")).select("batch", "c.*")


def publish(requirements: DataFrame, tasks: DataFrame, path: str, batch: int) -> bool:
    """Publishes a batch: ``requirements(tenant_id, task_id, ...)`` and the ``tasks(tenant_id, id, ...)`` that they belong to. A batch that is
    published already is left alone, so a replay changes nothing. Whether it was written."""
    spark = requirements.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    counts = []
    for rows, name in ((requirements, "requirements"), (tasks, "tasks")):
        target = f"{path}/{name}/batch={batch}/attempt={attempt}"
        rows.write.mode("errorifexists").parquet(target)
        counts.append(spark.read.schema(rows.schema).parquet(target).count())
    commit = spark.createDataFrame([(batch, attempt, *counts)], "batch long, attempt string, requirements long, tasks long")
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True


def publisher(path: str, tasks_of: Callable[[DataFrame], DataFrame], requirements_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: publishes what the two functions make of a micro-batch under its number."""

    def write(rows: DataFrame, batch: int) -> None:
        publish(requirements_of(rows), tasks_of(rows), path, batch)

    return write


def published(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of ``requirements`` or ``tasks`` of all published batches; per task those of the newest batch that has the task."""
    reader = spark.read.option("basePath", f"{path}/{name}")
    rows = (reader.schema(f"{schema}, batch long, attempt string") if schema else reader).parquet(f"{path}/{name}")
    visible = rows.withColumn("batch", F.col("batch").cast("long")).join(committed(spark, path).select("batch", "attempt"), ["batch", "attempt"], "left_semi")
    key = ["tenant_id", "task_id" if name == "requirements" else "id"]
    # A task's newest batch is told by its states: a result may be empty.
    tasks = spark.read.option("basePath", f"{path}/tasks").parquet(f"{path}/tasks")
    tasks = tasks.withColumn("batch", F.col("batch").cast("long")).join(committed(spark, path).select("batch", "attempt"), ["batch", "attempt"], "left_semi")
    newest = tasks.groupBy("tenant_id", F.col("id").alias(key[1])).agg(F.max("batch").alias("batch"))
    return visible.join(newest, [*key, "batch"], "left_semi").drop("batch", "attempt")
