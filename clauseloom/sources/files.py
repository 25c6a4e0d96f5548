"""Stored files: inventory, strict UTF-8 decoding, object keys, upload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content, length, modificationTime)`` of every file under ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


#: What a stored file can be; the codes of rejects.
FILE_MISSING, FILE_UNKNOWN, FILE_TOO_LARGE, FILE_SIZE, FILE_DIGEST = (
    "STORED_FILE_MISSING", "STORED_FILE_UNKNOWN", "STORED_FILE_TOO_LARGE", "STORED_FILE_SIZE_MISMATCH", "STORED_FILE_DIGEST_MISMATCH"
)


def _key_below(spark: SparkSession, path: str) -> Column:
    """A file's path below ``path``, which is its object key."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    return F.substr("path", F.length(F.lit(root)) + 1)


def check_stored(spark: SparkSession, path: str, declared: DataFrame, limit: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """The files under ``path`` against ``declared(object_key, size_bytes, sha256)``: ``(object_key, size_bytes, actual_bytes, sha256, actual_sha256,
    reject_reason)``, one row per declared key and per file that nothing declares.

    Names and sizes come from the listing alone. Contents are read, one file at a time, only where the size is within the limit, which the
    scan is told; a file that is too large, or of another size than declared, is rejected whatever it holds. The engine lists no empty files, so one is
    missing; uploads are never empty.
    """
    key, files = _key_below(spark, path), read_files(spark, path)
    listed = files.select(key.alias("found_key"), F.col("length").alias("actual_bytes"))
    digested = files.filter(F.col("length") <= limit).select(key.alias("digested_key"), F.sha2("content", 256).alias("actual_sha256"))
    both = declared.select("object_key", "size_bytes", "sha256").join(listed, F.col("object_key") == F.col("found_key"), "full")
    both = both.join(digested, F.col("found_key") == F.col("digested_key"), "left")
    reason = (
        F.when(F.col("found_key").isNull(), FILE_MISSING)
        .when(F.col("object_key").isNull(), FILE_UNKNOWN)
        .when(F.col("actual_bytes") > limit, FILE_TOO_LARGE)
        .when(~F.col("size_bytes").eqNullSafe(F.col("actual_bytes")), FILE_SIZE)
        .when(~F.col("sha256").eqNullSafe(F.col("actual_sha256")), FILE_DIGEST)
    )
    return both.select(
        F.coalesce("object_key", "found_key").alias("object_key"), "size_bytes", "actual_bytes", "sha256", "actual_sha256", reason.alias("reject_reason")
    )


def load_stored(spark: SparkSession, path: str, declared: DataFrame, limit: int = fv.MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Contents ``(object_key, content)`` of the declared files that are sound, and the rejects of all others."""
    checked = check_stored(spark, path, declared, limit)
    sound = checked.filter("reject_reason IS NULL").select("object_key")
    contents = read_files(spark, path).filter(F.col("length") <= limit).select(_key_below(spark, path).alias("object_key"), "content")
    return contents.join(sound, "object_key", "left_semi"), checked.filter("reject_reason IS NOT NULL")


def inventory(files: DataFrame, *keys: str) -> DataFrame:
    """Size and SHA-256 of ``content``."""
    return files.select(
        *keys, F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def decode_utf8(files: DataFrame, *keys: str) -> DataFrame:
    """Adds ``text``, or ``reject_reason`` for content that is not strict UTF-8.

    One leading UTF-8 mark is dropped; a UTF-16 mark or a malformed byte rejects the file.
    """
    content = F.col("content")
    utf16_mark = F.substring(content, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    marked = F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))
    body = F.when(marked, F.substring(content, 4, 2**31 - 1)).otherwise(content)
    sound = ~utf16_mark & F.is_valid_utf8(body.cast("string"))
    return files.select(
        *keys, F.when(sound, body.cast("string")).alias("text"),
        F.when(~sound, "INVALID_TEXT_ENCODING").alias("reject_reason"),
    )


def object_prefix() -> Column:
    return F.format_string(
        "tenants/%s/projects/%s/files/%s/", F.col("tenant_id"), F.col("project_id"), F.col("id")
    )


def original_key() -> Column:
    return F.concat(object_prefix(), F.lit("v1/original"))


def key_in_boundary(key: Column) -> Column:
    prefix = object_prefix()
    rest = F.substr(key, F.length(prefix) + 1)
    return F.coalesce(key.startswith(prefix) & rest.rlike(fv.OBJECT_SUFFIX), F.lit(False))


def upload_rows(uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accepted uploads as file, task and outbox rows; uploads outside the initial state as rejects."""
    ok = (F.col("parse_status") == "queued") & (F.col("attempt") == 0)
    accepted = uploads.filter(ok)

    def hashed(kind: str) -> Column:
        key = F.concat_ws(":", F.lit(kind), "tenant_id", F.col("upload_id").cast("string"))
        return F.upper(F.substring(F.md5(key), 1, 26))

    files = accepted.select(
        hashed("file").alias("id"), "tenant_id", "project_id", F.col("name").alias("file_name"), "size_bytes",
        "sha256", F.lit("queued").alias("parse_status"), F.col("uploaded_at").alias("created_at"),
    )
    tasks = accepted.select(
        hashed("task").alias("id"), "tenant_id", "project_id", hashed("file").alias("file_id"),
        F.lit(fv.RULE_TASK_TYPE).alias("type"), F.lit("queued").alias("status"), F.lit(0).alias("progress"),
        F.lit(0).alias("attempt"), F.col("uploaded_at").alias("created_at"),
    )
    outbox = accepted.select(
        hashed("event").alias("id"), "tenant_id", hashed("task").alias("task_id"),
        F.lit(0).alias("publish_attempts"), F.col("uploaded_at").alias("available_at"),
    )
    return files, tasks, outbox, uploads.filter(~ok)
