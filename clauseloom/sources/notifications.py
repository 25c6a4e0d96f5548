"""Task notifications: batch and streaming readers of the JSON payload, with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "eventId string, tenantId string, taskId string"


def parse(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the three required fields and ``malformed``; works on batch and streaming input."""
    fields = F.from_json(payload, PAYLOAD)
    parsed = raw.select(
        "*", fields["eventId"].alias("event_id"), fields["tenantId"].alias("tenant_id"),
        fields["taskId"].alias("task_id"),
    )
    present = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("event_id", "tenant_id", "task_id")]
    return parsed.withColumn("malformed", ~(present[0] & present[1] & present[2]))


def stream(spark: SparkSession, path: str, files_per_batch: int = 20) -> DataFrame:
    """Text files of one JSON payload per line, read in bounded micro-batches."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .withColumnRenamed("value", "payload")
    )
