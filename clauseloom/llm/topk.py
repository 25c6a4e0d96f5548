"""Exact top-k inner products by MaxScore over inverted lists.

Components become whole numbers. A term is a dimension with a sign; its posting list holds the vectors whose component has
that sign. For a query, the term of each dimension is the one that adds to the score, so that a term's bound is
its weight times the largest component in the list, and components of the other sign can only take away.

Every block of vectors is one shard. Terms are sorted by bound: those whose bounds add up to less than the k-th
best score so far are non-essential, as no vector in none of the other lists can reach it. Essential lists are
traversed and their sums kept per vector; vectors that stay competitive with all non-essential bounds are probed in the
other terms, from the largest bound down, and dropped once out of reach; what is left gets its full score.
The best of all shards are merged. Scores are whole numbers, and ties at the bound are kept, so results are exact.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
equal query rows are one query, rows of one id with different vectors a query each; a query never finds rows of its own id; ties go by the smaller id; with fewer than k candidates all are
returned. Scores are exact while sums stay below 2^53.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.blocks import Best, index, search, usable

COLUMNS = ["ids_", "whole", "postings", "impacts", "starts", "tops"]
FEW = 256


def build_shard(ids: np.ndarray, whole: np.ndarray) -> dict[str, bytes]:
    """Postings of term 2·dimension + (component below 0): vector numbers and absolute components, list after list."""
    numbers, impacts, starts, tops = [], [], [0], []
    for column in whole.T:
        for part in (np.flatnonzero(column > 0), np.flatnonzero(column < 0)):
            numbers.append(part)
            impacts.append(np.abs(column[part]))
            starts.append(starts[-1] + len(part))
            tops.append(int(impacts[-1].max()) if len(part) else 0)
    values = (
        ids, whole, np.concatenate(numbers).astype(np.int32), np.concatenate(impacts).astype(np.int64),
        np.array(starts, np.int64), np.array(tops, np.int64),
    )
    return dict(zip(COLUMNS, (x.tobytes() for x in values), strict=True))


def open_shard(block: dict[str, bytes]) -> tuple[np.ndarray, ...]:
    """Ids, whole components, posting lists and bounds. Every vector has a component in every dimension, so a list holds
    about half of a shard; opened, it is dense: the impact of each vector, 0 where it is not in the list."""
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int64)
    ids, whole, numbers, impacts, starts, tops = (np.frombuffer(block[c], kind) for c, kind in zip(COLUMNS, kinds, strict=True))
    lists = np.zeros((len(tops), len(ids)))
    lists[np.repeat(np.arange(len(tops)), np.diff(starts)), numbers] = impacts
    return ids, whole.reshape(len(ids), -1), lists, tops


def search_shard(shard: tuple[np.ndarray, ...], query_id: int, query: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Numbers of the vectors of a shard that may be among the k best, given that scores below ``floor`` are not."""
    ids, whole, lists, tops = shard
    dims = np.flatnonzero(query)
    terms, weights = 2 * dims + (query[dims] < 0), np.abs(query[dims])
    bounds = weights * tops[terms]
    order = np.argsort(bounds, kind="stable")
    terms, weights, bounds = terms[order], weights[order].astype(np.float64), bounds[order]
    sums = np.cumsum(bounds)
    if floor == -np.inf and len(terms):
        # A first floor: the k-th best full score among vectors with the largest impacts of the heaviest term.
        first = np.argsort(-lists[terms[-1]], kind="stable")[: 8 * k]
        first = first[ids[first] != query_id]
        if len(first) >= k:
            floor = np.sort(whole[first] @ query)[-k]
    split = int(np.searchsorted(sums, floor, side="left"))
    rest = int(sums[split - 1]) if split else 0
    reached = weights[split:] @ lists[terms[split:]]
    near = np.flatnonzero(reached + rest >= floor)
    partial = reached[near]
    # A full score is cheaper than further probes once few are left.
    while split and len(near) > FEW:
        split -= 1
        rest -= int(bounds[split])
        partial = partial + weights[split] * lists[terms[split], near]
        keep = partial + rest >= floor
        near, partial = near[keep], partial[keep]
    return near


def whole_numbers(matrix: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(matrix * scale).astype(np.int64)


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each distinct row of ``queries`` the k rows of ``vectors`` of largest inner product
    of floor(scale · component)."""

    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, bytes]:
        return build_shard(ids, whole_numbers(matrix, scale))

    def find(block: dict[str, bytes], query_ids: np.ndarray, asked: np.ndarray, best: Best) -> None:
        shard = open_shard(block)
        wanted = whole_numbers(asked, scale)
        for q, query_id in enumerate(query_ids):
            near = search_shard(shard, query_id, wanted[q], k, -best.worst(q))
            near = near[shard[0][near] != query_id]
            # Less is better in ``best``: scores change sign there.
            best.add(q, -(shard[1][near] @ wanted[q]), shard[0][near])

    indexed = index(usable(vectors, vec_id, vector, False), build, COLUMNS)
    found = search(indexed, usable(queries, vec_id, vector, False), find, COLUMNS, k, int)
    return found.withColumn("score", -F.col("score"))
