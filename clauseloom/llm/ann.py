"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Every vector is taken relative to the mean of all vectors, scaled to unit length and rotated by a random orthogonal matrix;
its code is one bit a dimension, the signs. With two scalars, its distance to the mean and the inner product f of
the unit vector with its own code, the inner product with any query is estimated from the bits alone, and the error
is at most ``confidence`` · sqrt((1 - f²) / f² / (d - 1)) times the query's length, with a probability that does not
depend on the data. Of each block only vectors whose lower bound of the distance reaches the k-th best known upper
bound or exact distance are reranked by their exact distance.

Every vector is indexed, and the codes are a function of vector and mean, so nothing is fitted on a sample.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take
no part; equal query rows are one query, rows of one id with different vectors a query each; a query never finds rows of its own id; repeated vectors tie and go by the smaller id; vectors are compared
with those of their own dimension; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.blocks import Best, index, search, usable

COLUMNS = ["ids_", "exact", "codes", "norms", "cosines"]


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        flat = np.asarray(batch.column("vec").flatten(), np.float64)
        starts = np.cumsum(dims) - dims
        for dim in np.unique(dims):
            rows = flat[starts[dims == dim][:, None] + np.arange(dim)]
            total[dim] = total.get(dim, 0) + np.append(rows.sum(axis=0), len(rows))
    for dim, sums in total.items():
        yield pa.RecordBatch.from_pydict({
            "dim": np.full(len(sums), dim, np.int32), "cell": np.arange(len(sums), dtype=np.int32), "total": sums,
        })


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of all vectors of each dimension: one partial sum a partition, d numbers for the driver."""
    rows = vectors.select("dim", "vec").mapInArrow(_sums, "dim int, cell int, total double")
    found: dict[int, np.ndarray] = {}
    for dim, cell, total in rows.groupBy("dim", "cell").agg(F.sum("total")).collect():
        found.setdefault(dim, np.zeros(dim + 1))[cell] = total
    return {dim: sums[:-1] / sums[-1] for dim, sums in found.items()}


def encode(matrix: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distances to the mean, and inner products of unit vectors with their codes."""
    dim = matrix.shape[1]
    centred = matrix - mean
    norms = np.sqrt((centred**2).sum(axis=1))
    rotated = centred @ rotation(dim) / np.maximum(norms, 1e-300)[:, None]
    return np.packbits(rotated >= 0, axis=1), norms, np.abs(rotated).sum(axis=1) / np.sqrt(dim)


def bounds(
    codes: np.ndarray, norms: np.ndarray, cosines: np.ndarray, query: np.ndarray, confidence: float
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distances of a query (centred and rotated) to coded vectors."""
    dim = len(query)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    return _bounds(signs @ query.astype(np.float32), norms, cosines, query, confidence)


def _bounds(dots, norms, cosines, query, confidence):
    dim, length = len(query), float(np.sqrt(query @ query))
    cosines = np.maximum(cosines, 1e-9)
    estimate = dots / np.sqrt(dim) / cosines
    # The last term covers rounding of the single precision product.
    error = length * (confidence * np.sqrt(np.maximum(0, 1 - cosines**2) / max(1, dim - 1)) / cosines + 1e-5)
    base = norms**2 + length**2
    return base - 2 * norms * (estimate + error), base - 2 * norms * (estimate - error)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, confidence: float = 2.5,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each distinct row of ``queries`` its k nearest rows of ``vectors`` by Euclidean
    distance, which is ``score``."""
    rows, asked = usable(vectors, vec_id, vector, True), usable(queries, vec_id, vector, True)
    centre = means(rows)

    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, bytes]:
        codes, norms, cosines = encode(matrix, centre[matrix.shape[1]])
        return dict(zip(COLUMNS, (x.tobytes() for x in (ids, matrix, codes, norms, cosines)), strict=True))

    def find(block: dict[str, bytes], query_ids: np.ndarray, asked: np.ndarray, best: Best) -> None:
        dim = asked.shape[1]
        ids = np.frombuffer(block["ids_"], np.int64)
        matrix = np.frombuffer(block["exact"], np.float64).reshape(-1, dim)
        norms, cosines = np.frombuffer(block["norms"]), np.frombuffer(block["cosines"])
        signs = np.unpackbits(np.frombuffer(block["codes"], np.uint8).reshape(len(ids), -1), axis=1, count=dim)
        signs = signs.astype(np.float32) * 2 - 1
        for first in range(0, len(query_ids), 256):
            turned = (asked[first : first + 256] - centre[dim]) @ rotation(dim)
            dots = signs @ turned.T.astype(np.float32)
            for at in range(len(turned)):
                q = first + at
                low, high = _bounds(dots[:, at], norms, cosines, turned[at], confidence)
                other = ids != query_ids[q]
                limit = best.worst(q) ** 2
                if other.sum() > k:
                    limit = min(limit, np.partition(high[other], k - 1)[k - 1])
                near = np.flatnonzero(other & (low <= limit * (1 + 1e-9)))
                away = matrix[near] - asked[q]
                best.add(q, np.sqrt((away * away).sum(axis=1)), ids[near])

    return search(index(rows, build, COLUMNS), asked, find, COLUMNS, k, float)
