import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.sources.derived import corpus


@F.arrow_udf(T.LongType())
def batch_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([sum(len(t.as_py()) for t in texts)] * len(texts), pa.int64())


def test_texts_come_in_bounded_batches(spark, sf_dir, tmp_path):
    """Ten thousand rows of whole texts would be one batch otherwise."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.unset(setting)
    try:
        spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/part.parquet").limit(1).write.parquet(f"{tmp_path}/part.parquet")
        rows = corpus(spark, str(tmp_path)).filter("doc_id LIKE 'd-%'").select(batch_bytes("text").alias("held")).collect()
        assert len(rows) == 200 and max(r.held for r in rows) <= 8 << 20
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
