import zlib

import numpy as np
from pyspark.sql import functions as F

from clauseloom.llm import quality
from clauseloom.llm.common import read


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    labels = read(spark, path, "labels")
    rows = quality.quality_scores(read(spark, path, "documents"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents, sf_dir):
    labels = read(spark, sf_dir, "labels")
    flipped = labels.withColumn(
        "quality", F.when(quality.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a = {r.doc_id: r.score for r in quality.quality_scores(documents, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_scores(documents, flipped).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_scores_are_the_plain_formula():
    rng = np.random.default_rng(0)
    means = (rng.normal(size=quality.WIDTH), rng.normal(size=quality.WIDTH))
    halves = [rng.normal(size=(quality.WIDTH, 60)) for _ in range(2)]
    covariances = [h @ h.T / 60 + np.eye(quality.WIDTH) for h in halves]
    model = quality.Discriminant(
        means, tuple(np.linalg.inv(np.linalg.cholesky(c)) for c in covariances),
        tuple(float(np.linalg.slogdet(c)[1]) for c in covariances), 0.5, 0.25,
    )
    x = rng.normal(size=(50, quality.WIDTH))
    log = [
        -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1]
        for m, c in zip(means, covariances, strict=True)
    ]
    expected = 1 / (1 + np.exp(-(0.5 * np.clip(log[1] - log[0], -200, 200) + 0.25)))
    assert np.allclose(model.score(x), expected, atol=1e-9)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 1), (8, 0), (8, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert quality.quality_scores(empty, labels).count() == 0
    unlabelled = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    one = quality.quality_scores(odd, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in one} == {1}


def test_statistics_are_finite():
    for text in ("", " ", "\n\n\n", "a", "é" * 100, "x" * 100_000, "A b! " * 1000):
        values = quality.text_statistics(text)
        assert len(values) == quality.WIDTH and np.isfinite(values).all()
