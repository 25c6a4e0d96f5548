"""A stated set of query vectors against all vectors, block by block.

Vectors are packed into blocks of bounded size, an index is made of each block once, and queries are packed likewise.
A pair of a block and a group of queries is one row of an equi-join on (dimension, group, bucket), where blocks
are dealt over buckets and query groups are repeated in each, so no join key gathers more than a share of the
blocks. Each task keeps the best k so far of the query groups it has met, so later blocks prune better, and one
row per query and rank leaves a task. A last window per query merges them.

A query is a distinct (id, vector): equal query rows are asked once, and rows of one id with different vectors have k hits
each, whose ranks each start at 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.llm.common import named
from clauseloom.session import materialize

#: Sizes of blocks and groups of queries, most buckets, query groups a task keeps at a time: memory bounds, not limits.
VECTORS_A_BLOCK, QUERIES_A_GROUP, BUCKETS, GROUPS_HELD = 2048, 4096, 64, 16

#: From the matrix of a block to the columns of its index, and from (index, query matrix) to a searcher.
Build = Callable[[np.ndarray, np.ndarray], dict[str, bytes]]
Search = Callable[[dict[str, bytes], np.ndarray, np.ndarray, "Best"], None]


class Best:
    """The k best (score, id) of each query of a group; less is better, and of equal scores the smaller id."""

    def __init__(self, queries: int, k: int, dtype: type):
        self.k = k
        self.scores = [np.empty(0, dtype)] * queries
        self.ids = [np.empty(0, np.int64)] * queries

    def worst(self, query: int) -> float:
        """What a further candidate must not exceed to matter."""
        return self.scores[query][-1] if len(self.scores[query]) == self.k else np.inf

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores])
        ids = np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def usable(vectors: DataFrame, vec_id: str, vector: str, nonzero: bool) -> DataFrame:
    """``(id, vec, dim)`` without null ids and without vectors that are null, empty, or hold null or non-finite
    components (and, if ``nonzero``, without zero vectors)."""
    rows = vectors.select(named(vec_id).cast("long").alias("id"), named(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & finite)
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return rows.select("id", "vec", F.size("vec").alias("dim"))


def _packed(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """``(dim, name, ids, vecs)``: rows dealt by hash into blocks of about ``per_block``."""
    blocks = max(1, -(-rows.count() // per_block))
    at = F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")
    item = F.struct("id", "vec")
    grouped = rows.withColumn(name, at).groupBy("dim", name).agg(F.collect_list(item).alias("items"))
    return grouped.select("dim", name, F.col("items.id").alias("ids"), F.flatten("items.vec").alias("vecs"))


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    dim = batch.column("dim")[row].as_py()
    ids = np.asarray(batch.column("ids")[row].values, np.int64)
    return ids, np.asarray(batch.column("vecs")[row].values, np.float64).reshape(-1, dim)


def index(vectors: DataFrame, build: Build, columns: list[str]) -> DataFrame:
    """``usable`` vectors → ``(dim, block, ids, vecs, columns...)``, written to the shared folder."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, matrix = _arrays(batch, row)
                made = build(ids, matrix)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([matrix.shape[1]], pa.int32()), "block": pa.array([batch.column("block")[row].as_py()], pa.int32()),
                    **{name: pa.array([made[name]], pa.binary()) for name in columns},
                })

    schema = "dim int, block int, " + ", ".join(f"`{name}` binary" for name in columns)
    return materialize(_packed(vectors, VECTORS_A_BLOCK, "block").mapInArrow(make, schema), "vector-index")


def search(indexed: DataFrame, queries: DataFrame, find: Search, columns: list[str], k: int, exact: type) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best of every distinct query; ``find`` adds the candidates of a block."""
    groups = materialize(_packed(queries.distinct(), QUERIES_A_GROUP, "grp"), "query-groups")
    count = groups.agg(F.max("grp")).first()[0]
    if count is None:
        return indexed.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {exact.__name__}")
    buckets = min(BUCKETS, 1 + (indexed.agg(F.max("block")).first()[0] or 0))
    bucket = F.pmod("block", F.lit(buckets))
    left = indexed.withColumn("bucket", bucket).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(count))))
    right = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    # The planner's estimate does not see the repetition, so it must not choose to broadcast this side.
    paired = left.join(right.hint("merge"), ["dim", "grp", "bucket"])
    dtype = np.int64 if exact is int else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, Best]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for ids, keys, best in held.values():
                counts = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(ids, counts), pa.int64()),
                    "query_key": pa.array(np.repeat(keys, counts), pa.int64()),
                    "vec_id": pa.array(np.concatenate(best.ids), pa.int64()),
                    "score": pa.array(np.concatenate(best.scores)),
                })

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("dim")[row].as_py(), batch.column("grp")[row].as_py()
                ids, matrix = _arrays(batch, row)
                if key not in held:
                    if len(held) >= GROUPS_HELD:
                        yield from out()
                        held.clear()
                    keys = np.array([xxhash.xxh64_intdigest(vector.tobytes()) for vector in matrix], np.uint64).view(np.int64)
                    held[key] = ids, keys, Best(len(ids), k, dtype)
                find({c: batch.column(c)[row].as_py() for c in columns}, ids, matrix, held[key][2])
        yield from out()

    kind = "long" if exact is int else "double"
    near = paired.mapInArrow(run, f"query_id long, query_key long, vec_id long, score {kind}")
    order = W.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
