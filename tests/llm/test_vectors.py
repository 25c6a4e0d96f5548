import math

import numpy as np
import pytest

from clauseloom.llm import ann, topk
from clauseloom.llm.common import read


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def arrays(vectors):
    rows = vectors.collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def ranked(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return found


def test_nearest_against_all_pairs(embeddings):
    ids, matrix = arrays(embeddings)
    got, hits, wanted = ranked(ann.nearest(embeddings, embeddings.filter("vec_id % 20 = 0")).collect()), 0, 0
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    for query, rows in got.items():
        away = np.sqrt(((matrix - matrix[ids == query]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, away)) if ids[i] != query][:10]
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(score - away[ids == vec][0]) < 1e-12 for _, vec, score in rows)
        hits += len({v for _, v, _ in rows} & set(ids[order].tolist()))
        wanted += 10
    assert hits / wanted >= 0.9


def test_bounds_hold_the_true_distance():
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(4000, 48)) + 3
    mean = matrix.mean(axis=0)
    codes, norms, cosines = ann.encode(matrix, mean)
    query = rng.normal(size=48) + 3
    low, high = ann.bounds(codes, norms, cosines, (query - mean) @ ann.rotation(48), 2.5)
    true = ((matrix - query) ** 2).sum(axis=1)
    assert codes.shape == (4000, 6)
    assert ((low <= true) & (true <= high)).mean() > 0.98


def test_products_against_all_pairs(embeddings):
    ids, matrix = arrays(embeddings)
    whole = np.floor(256 * matrix).astype(np.int64)
    got = ranked(topk.top_products(embeddings, embeddings.filter("vec_id % 20 = 0")).collect())
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    for query, rows in got.items():
        scores = whole @ whole[ids == query][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:5]
        assert rows == [(k + 1, int(ids[i]), int(scores[i])) for k, i in enumerate(order)]


@pytest.mark.parametrize("shift", [0.0, 1.0, -1.0])
def test_shards_keep_all_of_the_best(shift):
    """Positive and negative scores, ties at the floor, more vectors than the probes stop at."""
    rng = np.random.default_rng(3)
    whole = rng.integers(-6, 7, (3000, 12)) + int(4 * shift)
    ids = np.arange(3000)
    shard = topk.open_shard(topk.build_shard(ids, whole))
    for query in list(rng.integers(-5, 6, (20, 12))) + [np.zeros(12, np.int64), -np.abs(whole[0])]:
        scores = whole @ query
        best = np.lexsort((ids, -scores))[:5]
        for floor in (-np.inf, float(scores[best[-1]])):
            near = topk.search_shard(shard, -1, query, 5, floor)
            assert set(best) <= set(near)


def odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [], "x"),
        (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [None, 1.0], "x"), (9, [0.0, 0.0], None), (None, [1.0, 1.0], "x"),
        (100, [1.0, 0.5], "x"), (100, [1.0, 0.5], "x"), (200, [1.0, 2.0, 3.0], "x"), (201, [1.0, 2.0, 2.0], "x"),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_odd_vectors(spark):
    vectors = odd_vectors(spark)
    near = ranked(ann.nearest(vectors, vectors.filter("vec_id in (0, 3, 4, 6, 9, 200)"), k=3).collect())
    assert set(near) == {0, 3, 200}
    assert [v for _, v, _ in near[0]] == [1, 2, 100] and near[0][0][2] == 0.0
    assert [v for _, v, _ in near[200]] == [201]
    top = ranked(topk.top_products(vectors, vectors.filter("vec_id in (0, 3, 9, 200)"), k=3).collect())
    assert top[0] == [(1, 1, 65536), (2, 2, 65536), (3, 100, 65536)]
    assert [s for *_, s in top[9]] == [0, 0, 0] and [v for _, v, _ in top[9]] == [0, 1, 2]
    nothing = vectors.limit(0)
    assert ann.nearest(nothing, nothing).count() == 0 and topk.top_products(vectors, nothing).count() == 0
