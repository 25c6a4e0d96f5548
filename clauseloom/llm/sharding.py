"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's hash puts it into one of thousands of virtual slots for good. Bytes are summed per slot, and a small table,
the slot map, says which shard holds each slot. The map alone is edited when shards are added or loads drift, and every
edit is a new version of it, so readers of an old version still find everything.

Version 1 deals slots in turn, before any load is known. An edit for balance keeps in each shard its largest slots up to the fair
share and moves what is beyond, largest first, to the least loaded shards, which leaves shards equal to within a small slot.
Adding a shard moves just enough slots into it and none between the others.

Rows equal in id and text would all lie in one slot; they are numbered and the number goes into the hash, so that any number of equal rows
spreads over all slots.

Only tables of one row per slot (a parameter) are ever ordered or gathered. Records are counted per
slot and part of a slot before they are numbered, so that no task orders more than one part.

Defined results: a null text has size 1 and checksum 0, a null id is hashed like a value; rows of equal texts go where their
ids send them, and repeated rows spread and get numbers of their own; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.llm.common import named
from clauseloom.session import materialize, scratch_path

SLOTS, PARTS = 4096, 16


def virtual_slot(doc_id: Column, text_hash: Column, copy: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_hash, copy), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records(virtual_slot, size)`` → ``(virtual_slot, bytes)`` for every slot, empty ones too."""
    spark = records.sparkSession
    summed = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(summed, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """``loads(virtual_slot, bytes)`` → version 1 of the map, ``(version, virtual_slot, shard, bytes)``: slots in turn."""
    return loads.select(
        F.lit(1).alias("version"), "virtual_slot", F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int").alias("shard"), "bytes"
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version for ``loads(virtual_slot, bytes)``: each shard keeps its largest slots up to the fair share, what is beyond goes, largest
    first, to the least loaded shard, as one fold over the array of slots that move."""
    now = slot_map.select("version", "virtual_slot", "shard").join(loads, "virtual_slot")
    fair = F.sum("bytes").over(W.partitionBy("version")) / shards
    through = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    judged = now.withColumn("kept", (through <= fair) | (through == F.col("bytes")) | (F.col("bytes") == 0))
    slot = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "shard", "kept")
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.filter("slots", lambda x: (x["shard"] == s) & x["kept"]), F.lit(0).cast("long"), lambda n, x: n + x["bytes"]
    ))
    empty = F.struct(F.col("held").alias("loads"), F.array().cast("array<int>").alias("owners"))

    def give(state: Column, at: Column) -> Column:
        owner = F.when(at["kept"], at["shard"]).otherwise((F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"))
        more = F.when(at["kept"], 0).otherwise(at["bytes"])
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == owner, x + more).otherwise(x)).alias("loads"),
            F.concat(state["owners"], F.array(owner)).alias("owners"),
        )

    ordered = judged.groupBy("version").agg(F.sort_array(F.collect_list(slot)).alias("slots")).withColumn("held", held)
    dealt = ordered.select("version", "slots", F.aggregate("slots", empty, give)["owners"].alias("owners"))
    pairs = dealt.select("version", F.inline(F.arrays_zip("slots", "owners")))
    return pairs.select((F.col("version") + 1).alias("version"), "slots.virtual_slot", F.col("owners").alias("shard"), "slots.bytes")


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map of ``shards`` shards with one more: every shard keeps slots, the smallest first, up to its new fair
    share of the bytes, and what is beyond moves into the new shard."""
    fair = F.sum("bytes").over(W.partitionBy("version")) / (shards + 1)
    through = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    moved = F.when(F.col("through") > F.col("fair"), F.lit(shards)).otherwise(F.col("shard"))
    return slot_map.withColumn("fair", fair).withColumn("through", through).select(
        (F.col("version") + 1).alias("version"), "virtual_slot", moved.cast("int").alias("shard"), "bytes"
    )


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Writes a version into a folder of its own; one that is there already is an error."""
    slot_map.filter(F.col("version") == version).drop("version").write.mode("errorifexists").parquet(_folder(path, version))


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(_folder(path, version)).withColumn("version", F.lit(version))


def last_version(spark: SparkSession, path: str) -> int:
    """The newest version whose writing has ended, 0 where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS"))
    return max([int(f.getPath().getParent().getName().split("=")[1]) for f in found or []], default=0)


def records_of(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, copy, virtual_slot, part)``; texts stay behind. Equal rows are counted before any exchange, and numbered."""
    body = F.coalesce(named(text), F.lit(""))
    slim = docs.select(
        named(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(named(text)).alias("text_hash"),
    )
    counted = slim.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count("*").alias("n"))
    # In two steps, so that no task writes out all copies of one row.
    step = F.lit(PARTS * PARTS).cast("long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
    once = runs.filter("n = 1").withColumn("copy", F.col("from"))
    more = runs.filter("n > 1").repartition(parts).withColumn("copy", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + step) - 1)))
    mixed = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", "copy"), 32)
    return once.unionByName(more).select(
        "doc_id", "size", "text_crc32", "copy", virtual_slot(F.col("doc_id"), F.col("text_hash"), F.col("copy"), slots).alias("virtual_slot"),
        F.pmod(mixed, F.lit(PARTS)).cast("int").alias("part"),
    )


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the record's number in its shard, gapless from 0."""
    group = ["virtual_slot", "part"]
    counts = records.groupBy(*group).count().join(slot_map.select("virtual_slot", "shard"), "virtual_slot")
    before = W.partitionBy("shard").orderBy(*group).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy(*group).orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    return records.withColumn("number", number).join(starts, group).withColumn("slot", F.col("start") + F.col("number")).drop(
        "start", "number", "copy"
    )


def shard_documents(
    docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, size, text_crc32, virtual_slot, part, shard, slot)``, shards near equal in
    bytes. ``map_path``: where the versions of the map are stored (otherwise a folder of this call in the session's shared folder). A map that is
    there is edited for the present loads and number of shards; where the edit moves nothing, its newest version stays."""
    spark, path = docs.sparkSession, map_path or scratch_path(docs.sparkSession, "slot-maps")
    records = materialize(records_of(docs, slots, doc_id, text), "sharding")
    loads = materialize(slot_loads(records, slots), "slot-loads")
    version = last_version(spark, path)
    if not version:
        version = 1
        save_map(first_map(loads, shards), path, version)
    now = load_map(spark, path, version)
    edited = materialize(rebalance(now, loads, shards), "slot-map")
    moved = edited.join(now.select("virtual_slot", F.col("shard").alias("was")), "virtual_slot").filter("shard <> was")
    if not moved.isEmpty():
        version += 1
        save_map(edited, path, version)
    return assign(records, load_map(spark, path, version))
