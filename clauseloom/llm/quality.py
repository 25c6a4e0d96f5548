"""Document quality by a regularised quadratic discriminant.

Every text becomes a vector of transformed statistics (lengths, shares of characters, repetition). For each
class of the labelled rows the mean and covariance of these vectors come from sums that Spark adds up; the
covariance shrinks towards a mix of the pooled covariance and its diagonal. A score compares two Mahalanobis
distances: each class keeps the inverse Cholesky factor of its covariance and its log determinant,
so a batch of texts costs one small matrix product a class. The difference of log densities is mapped to 0..1
by a logistic curve whose slope and offset are fitted, on the same training rows, to a histogram of the
differences, because densities of correlated statistics are more extreme than the odds they stand for.

Everything the driver receives has a fixed size: d² sums and a histogram a class. No row is sampled.

Defined results: a null text reads as empty and gets the score of an empty text; a null or unlabelled id is
scored like any other; repeated rows score alike; with one class (or none) labelled every score is that
class's value (0.5 without labels). Labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import fresh, named, tidy
from clauseloom.session import materialize

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it on as with by for was be are this at from or an not which "
    b"der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    b"le la les de des et un une du en que qui dans pour sur est au par il elle avec "
    b"el los las y del se por con para una su al lo como no es".split()
)
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"!", b"|", b"#$%&*", b"<>{}[]=\\/_@+~^`")
_OF_BYTE = np.zeros(256, np.int64)
for _number, _chars in enumerate(_CLASSES, 1):
    _OF_BYTE[np.frombuffer(_chars, np.uint8)] = _number
_OF_BYTE[128:] = len(_CLASSES) + 1
#: Features of one text.
WIDTH = 22
#: Histogram of log density differences for the logistic curve.
BINS, REACH = 4000, 200.0


def text_statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; all finite, also for an empty text."""
    data = text.encode()
    size = len(data)
    kinds = np.bincount(_OF_BYTE[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 2)
    shares = np.sqrt(kinds[1:] / max(1, size))
    words = data.split()
    n = len(words)
    distinct = set(words)
    lens = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = data.split(b"\n")
    kept = set(lines)
    kept_bytes = sum(map(len, kept))
    function_words = sum(map(FUNCTION_WORDS.__contains__, words))
    return [
        np.log1p(size), np.log1p(n), *shares,
        np.log1p(lens.mean()), np.log1p(lens.std()), np.log1p(lens.max()),
        np.log1p(len(distinct)) / np.log1p(max(1, n)), np.sqrt(function_words / max(1, n)),
        np.sqrt(1 - len(kept) / len(lines)), np.sqrt(max(0.0, 1 - (kept_bytes + len(kept) - 1) / max(1, size))),
        np.log1p(size / len(lines)), np.log1p(data.count(b". ") + data.count(b".\n")) / np.log1p(max(1, n)),
        np.sqrt(data.count(b"\n") / max(1, n)),
        np.sqrt(sum(map(eq, words, words[1:])) / max(1, n)), np.sqrt(sum(map(eq, words, words[2:])) / max(1, n)),
    ]


def statistics(text: Column) -> Column:
    """Statistics of a text column as an array of doubles."""

    @F.arrow_udf("array<double>")
    @tidy
    def of_texts(texts: pa.Array) -> pa.Array:
        flat = [x for t in texts for x in text_statistics(t.as_py() or "")]
        return pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, WIDTH), pa.int32()), pa.array(flat, pa.float64()))

    return of_texts(text)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor and log determinant; then the logistic curve."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        if not self.means:
            return np.zeros(len(x))
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            logs.append(-0.5 * ((((x - mean) @ factor.T) ** 2).sum(axis=1) + log_det))
        return np.clip(logs[1] - logs[0], -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: per class the count, sums and sums of products, one value a row."""
    total = {}
    for batch in batches:
        x, label = _matrix(batch.column("stats")), np.asarray(batch.column("label"))
        x = np.hstack([np.ones((len(x), 1)), x])
        for value in np.unique(label):
            own = x[label == value]
            total[value] = total.get(value, 0) + own.T @ own
    for value, sums in total.items():
        flat = sums.ravel()
        yield pa.RecordBatch.from_pydict({
            "label": np.full(len(flat), value, np.int32), "cell": np.arange(len(flat), dtype=np.int32), "total": flat,
        })


def _logistic(counts: np.ndarray, centres: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that fits class shares per bin, by damped Newton steps."""
    zeros, ones = counts
    n0, n1 = zeros.sum(), ones.sum()
    # Targets a little inside 0 and 1 keep the curve finite when the classes do not overlap.
    hits = ones * (n1 + 1) / (n1 + 2) + zeros / (n0 + 2)
    n, w = zeros + ones, np.array([0.1, np.log((n1 + 1) / (n0 + 1))])
    design = np.stack([centres, np.ones_like(centres)], axis=1)

    def loss(w):
        z = design @ w
        return (n * np.logaddexp(0, z) - hits * z).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (n * p - hits)
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(rows: DataFrame, shrink: float = 0.1) -> Discriminant:
    """``rows(stats, label)`` with labels 0 and 1 → the discriminant. ``shrink`` is the part of each class
    covariance that is replaced by half the pooled covariance and half its diagonal."""
    spark_sums = rows.select("stats", F.col("label").cast("int").alias("label")).mapInArrow(
        _moments, "label int, cell int, total double"
    ).groupBy("label", "cell").agg(F.sum("total").alias("total")).collect()
    width = WIDTH + 1
    sums = {}
    for label, cell, total in spark_sums:
        sums.setdefault(label, np.zeros(width * width))[cell] = total
    sums = {k: v.reshape(width, width) for k, v in sums.items()}
    if set(sums) != {0, 1}:
        # One class or none: a constant.
        return Discriminant((), (), (), 0.0, {0: -40.0, 1: 40.0}.get(next(iter(sums), -1), 0.0))
    means, covariances, counts = [], [], []
    for label in (0, 1):
        n = sums[label][0, 0]
        mean = sums[label][0, 1:] / n
        means.append(mean)
        counts.append(n)
        covariances.append(sums[label][1:, 1:] / n - np.outer(mean, mean))
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / sum(counts)
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    factors, log_dets = [], []
    for covariance, n in zip(covariances, counts, strict=True):
        # A class of few rows leans on the pooled covariance.
        part = max(shrink, WIDTH / (WIDTH + n))
        cholesky = np.linalg.cholesky((1 - part) * covariance + part * target + 1e-6 * np.eye(WIDTH))
        factors.append(np.linalg.inv(cholesky))
        log_dets.append(float(2 * np.log(np.diag(cholesky)).sum()))
    model = Discriminant(tuple(means), tuple(factors), tuple(log_dets))

    @F.arrow_udf("int")
    def bin_of(stats: pa.Array) -> pa.Array:
        share = (model.difference(_matrix(stats)) + REACH) / (2 * REACH)
        return pa.array(np.minimum((share * BINS).astype(np.int32), BINS - 1))

    histogram = np.zeros((2, BINS))
    for label, at, n in rows.groupBy(F.col("label").cast("int"), bin_of("stats")).count().collect():
        histogram[label, at] = n
    slope, offset = _logistic(histogram, (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH)
    return Discriminant(model.means, model.factors, model.log_dets, slope, offset)


def score(stats: Column, model: Discriminant) -> Column:
    """0 to 1, higher where class 1 is likelier."""

    @F.arrow_udf("double")
    def of_stats(lists: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(lists)))

    return of_stats(stats)


def remainder(doc_id: Column, parts: int = 5) -> Column:
    """Fold of a row by its id; a null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def _training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``rows(doc_id, stats)`` outside fold 0 with their label; each distinct label once."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").distinct()
    return rows.filter(remainder(F.col("doc_id")) != 0).join(known, "doc_id").select("stats", "label")


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs``; learned from
    ``labels(doc_id, quality)`` outside fold 0."""
    rows = materialize(docs.select(named(doc_id).alias("doc_id"), statistics(named(text)).alias("stats")), "quality")
    model = fit(materialize(_training(rows, labels), "quality-training"))
    scored = rows.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score(F.col("stats"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` scored at ``threshold`` or more. Statistics are made twice, once for the rows outside fold 0, of which the labelled ones are
    fitted, and once where the text is, so that no text is shuffled."""
    stats, = fresh(docs, "stats")
    rows = docs.select(named(doc_id).alias("doc_id"), statistics(named(text)).alias("stats"))
    model = fit(materialize(_training(rows, labels), "quality-training"))
    scored = docs.withColumn(stats, score(statistics(named(text)), model))
    return scored.filter(F.col(stats) >= threshold).drop(stats)
