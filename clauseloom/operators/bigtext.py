"""Text documents of any size: a scan in two passes over chunks of lines.

A document that does not fit a row arrives as rows of lines ``(doc_id, chunk, place, line)``: chunks in order, and places in order within a chunk. A chunk is a
split of the file, or a bounded run of lines, and is what one task holds at a time; a document may have any number of them.

1. Every chunk yields a summary: its lines, blocks and UTF-16 units, and for each heading level the last heading. That is all that a
   stack of open headings can ever see of it, since a heading closes those of its own level or deeper; merging summaries is
   taking the later heading of each level, which is associative. A running maximum over one row per chunk (and level) gives
   each chunk where it starts and which headings are open there.
2. Lines meet their chunk's start once, in order, as a stream: a task keeps the open headings and three counts.

The result is that of ``blocks.sectioned_blocks`` and ``locators.positions_at``, which hold a document in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from clauseloom.functions.signals import txt_heading
from clauseloom.functions.text import nfc, utf16_length
from clauseloom.session import materialize

LINES_A_CHUNK = 65_536
#: Positions are looked up in bins of so many units.
BIN_UNITS = 1 << 20


def file_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The canonical lines of every text file under ``path``: a document per file, a chunk per split of it.

    The reader ends lines at LF, CR LF and CR and drops a mark of the encoding, as the canonical form does; NFC never reaches
    over a line's end. Rows of a split are numbered as they are read.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("place"), nfc(F.col("value")).alias("line"),
    )


def split_lines(docs: DataFrame, lines_a_chunk: int = LINES_A_CHUNK) -> DataFrame:
    """The lines of ``docs(doc_id, text)`` with canonical texts, in the form of ``file_lines``."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return rows.select("doc_id", F.floor(F.col("at") / lines_a_chunk).alias("chunk"), F.col("at").cast("long").alias("place"), "line")


def _measured(lines: DataFrame) -> DataFrame:
    heading = lines.withColumn("heading", txt_heading(F.col("line")))
    return heading.select("doc_id", "chunk", "place", "line", utf16_length(F.col("line")).alias("units"), "heading.level", "heading.title")


def chunk_starts(measured: DataFrame) -> DataFrame:
    """``(doc_id, chunk, lines, blocks, units, own_units, open)``: counts before each chunk, its own units, and the headings open at its start."""
    sums = measured.groupBy("doc_id", "chunk").agg(
        F.count("*").alias("own_lines"), F.count_if(F.col("units") > 0).alias("own_blocks"), F.sum(F.col("units") + 1).alias("own_units")
    )
    # One row per chunk from here on, and one per chunk and heading level.
    sums = materialize(sums, "chunk-sums")
    last = measured.filter("level IS NOT NULL").groupBy("doc_id", "chunk", "level").agg(F.max(F.struct("chunk", "place", "title")).alias("at"))
    last = materialize(last, "chunk-headings")
    before = W.partitionBy("doc_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = sums.select(
        "doc_id", "chunk", "own_units", *[F.coalesce(F.sum(f"own_{c}").over(before), F.lit(0)).cast("long").alias(c) for c in ("lines", "blocks", "units")]
    )
    earlier = W.partitionBy("doc_id", "level").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    every = sums.select("doc_id", "chunk").join(last.select("doc_id", "level").distinct(), "doc_id").join(last, ["doc_id", "chunk", "level"], "left")
    seen = every.withColumn("at", F.max("at").over(earlier)).filter("at IS NOT NULL")
    stacks = seen.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("level", "at"))).alias("seen"))
    # Open is what no later heading of a lesser level has closed.
    open_ = F.filter("seen", lambda e: ~F.exists("seen", lambda o: (o["level"] < e["level"]) & (o["at"] > e["at"])))
    titles = stacks.select("doc_id", "chunk", F.transform(open_, lambda e: F.struct(e["level"].alias("level"), e["at"]["title"].alias("title"))).alias("open"))
    return counts.join(titles, ["doc_id", "chunk"], "left")


def _placed(kind: pa.DataType):
    """Rows of chunks in order, each led by its start → lines with number, block number, offset and open titles."""
    names = ["doc_id", "chunk", "block_no", "line_no", "line", "text_start", "units", "level", "title", "section_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = blocks = units = 0
        stack: list[tuple[int, str]] = []
        for batch in batches:
            head = np.array(batch.column("head"))
            own = np.array(batch.column("units").fill_null(0))
            numbers, block_numbers, starts = (np.zeros(len(head), np.int64) for _ in range(3))
            marked = np.array(batch.column("level").is_valid())
            levels, titles = batch.column("level"), batch.column("title")
            which, paths = np.zeros(len(head), np.int64), []
            edges = [0, *np.flatnonzero(head).tolist(), len(head)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first < last and head[first]:
                    lines, blocks, units = (batch.column(c)[first].as_py() for c in ("lines", "blocks", "before"))
                    stack = [(o["level"], o["title"]) for o in batch.column("open")[first].as_py() or []]
                    first += 1
                if first >= last:
                    continue
                span = slice(first, last)
                numbers[span] = lines + np.arange(1, last - first + 1)
                block_numbers[span] = blocks + np.cumsum(own[span] > 0)
                ends = units + np.cumsum(own[span] + 1)
                starts[span] = ends - own[span] - 1
                lines, blocks, units = int(numbers[last - 1]), int(block_numbers[last - 1]), int(ends[-1])
                paths.append([t for _, t in stack])
                which[span] = len(paths) - 1
                for at in (first + np.flatnonzero(marked[span])).tolist():
                    level = levels[at].as_py()
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, titles[at].as_py()))
                    paths.append([t for _, t in stack])
                    which[at:last] = len(paths) - 1
            body = pa.array(np.flatnonzero(~head))
            if len(body):
                shared = pa.array(paths, pa.list_(pa.string())).take(pa.array(which).take(body))
                columns = [
                    batch.column("doc_id").take(body), batch.column("chunk").take(body), pa.array(block_numbers).take(body), pa.array(numbers).take(body),
                    batch.column("line").take(body), pa.array(starts).take(body), pa.array(own).take(body), levels.take(body), titles.take(body), shared,
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def placed_lines(lines: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Every line with ``block_no`` (of the last block up to it), ``line_no``, ``text_start``, ``units``, ``level``, ``title``, ``section_path``."""
    measured = _measured(lines)
    starts = materialize(chunk_starts(measured), "chunk-starts") if starts is None else starts
    kind = lines.schema["doc_id"].dataType
    stack = T.ArrayType(T.StructType().add("level", "integer").add("title", "string"))
    none = F.lit(None)
    heads = starts.select(
        "doc_id", "chunk", F.lit(True).alias("head"), none.cast("long").alias("place"), none.cast("string").alias("line"), none.cast("long").alias("own"),
        none.cast("int").alias("level"), none.cast("string").alias("title"), "lines", "blocks", F.col("units").alias("before"), F.col("open").cast(stack).alias("open"),
    )
    body = measured.select(
        "doc_id", "chunk", F.lit(False).alias("head"), "place", "line", F.col("units").alias("own"), "level", "title",
        *[none.cast("long").alias(c) for c in ("lines", "blocks", "before")], none.cast(stack).alias("open"),
    )
    ordered = heads.unionByName(body).withColumnRenamed("own", "units").repartition("doc_id", "chunk")
    ordered = ordered.sortWithinPartitions("doc_id", "chunk", F.desc("head"), "place")
    shape = f"doc_id {kind.simpleString()}, chunk long, block_no long, line_no long, line string, text_start long, units long, level int, title string, section_path array<string>"
    return ordered.mapInArrow(_placed(to_arrow_type(kind)), shape)


def sectioned_blocks(lines: DataFrame) -> DataFrame:
    """One row per non-empty line: the columns of ``blocks.sectioned_blocks``."""
    return placed_lines(lines).filter("units > 0").select(
        "doc_id", "block_no", "line_no", "line", "text_start", (F.col("text_start") + F.col("units")).alias("text_end"),
        F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), "level", "title", "section_path",
    )


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BIN_UNITS), F.floor(last / BIN_UNITS)))


def positions_at(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets(doc_id, offset)`` → 1-based line and 0-based UTF-16 column; offsets outside the document have none.

    An offset meets its chunk by bins of the text, and within the chunk the latest line start is carried forward, so no task
    holds more than a chunk and its offsets.
    """
    starts = materialize(chunk_starts(_measured(lines)), "chunk-starts")
    spans = starts.select("doc_id", "chunk", F.col("units").alias("from"), (F.col("units") + F.col("own_units") - 1).alias("to"))
    spans = spans.withColumn("bin", _bins(F.col("from"), F.col("to")))
    asked = offsets.select("doc_id", "offset", F.floor(F.col("offset") / BIN_UNITS).alias("bin")).join(spans, ["doc_id", "bin"])
    asked = asked.filter("offset BETWEEN `from` AND `to`").select(
        "doc_id", "chunk", F.col("offset").alias("at"), F.lit(1).alias("is_offset"), F.lit(None).cast("long").alias("line_no")
    )
    begun = placed_lines(lines, starts).select("doc_id", "chunk", F.col("text_start").alias("at"), F.lit(0).alias("is_offset"), "line_no")
    upto = W.partitionBy("doc_id", "chunk").orderBy("at", "is_offset").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("is_offset") == 0, F.struct("line_no", "at")), ignorenulls=True).over(upto)
    carried = begun.unionByName(asked).withColumn("s", latest).filter("is_offset = 1")
    return carried.select("doc_id", F.col("at").alias("offset"), F.col("s.line_no").alias("line"), (F.col("at") - F.col("s.at")).alias("column"))
