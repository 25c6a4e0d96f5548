"""Which terms set a source apart from its language, and how far sources are from each other, by count cells.

A text's terms are its runs of ASCII letters (lower-cased) and of characters beyond ASCII. Each language keeps the terms that occur in at
least ``least_docs`` of its documents, V of them. A group (language and source) and a language give every kept term the share
``p = 1 + floor(10^9 (count + 1) / (N + V))``, N being the sum of their counts, and the divergence of p from q is
``f = floor((p - q)^2 / q)``. All of it is exact whole-number arithmetic.

f depends on two counts alone, so it is evaluated per *cell* of terms with equal counts, never per term:

* ``term``: the terms of a group are counted by (count in the group, count in the language); f is evaluated per cell, cells of equal
  values are merged, and values are ranked by how many terms lie above them. Only cells that reach the report's first
  ranks are expanded into terms, in UTF-8 order.
* ``pair``: terms are counted by their whole vector of counts over sources, and f is evaluated per vector and pair of its sources. With
  f00 etc. for absent terms, f summed over all V terms is ``V f00 + sum(fx0 - f00) + sum(f0y - f00) + sum(fxy - fx0 - f0y + f00)``, over the
  terms of the one, of the other, and of both: terms that neither source has are never looked at.

Texts stay where they are: a task counts words in a bounded table and sends on (language, source, term, count, documents), so a
source with a third of all rows is spread over all tasks. A term's vector has at most one entry a source of its language, as has the
report itself.

Defined results: null text, language and source are ''; a group without kept terms has N = 0 and takes part; a language without kept
terms (V = 0) has pair values of 0 and no terms; repeated rows count as documents of their own; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.llm.common import named
from clauseloom.session import materialize

#: How many terms a task holds before it sends them on, and how many bytes of a text it cuts into words at once.
HELD, RUN = 200_000, 1 << 20

_LETTERS = bytes(b if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
TABLE = _LETTERS.lower()


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order and in runs of bounded size, as UTF-8."""
    data = text.encode().translate(TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + RUN)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def held() -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, docs) in counts.items():
            keys = list(terms)
            for at in range(0, len(keys), HELD):
                some = keys[at : at + HELD]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()),
                    "term": pa.array(some, pa.binary()).cast(pa.string()), "n": pa.array([terms[k] for k in some], pa.int64()),
                    "docs": pa.array([docs[k] for k in some], pa.int64()),
                })
        counts.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            terms, docs = counts[lang.as_py(), source.as_py()]
            size -= len(terms)
            own: set[bytes] = set()
            for run in terms_of(text.as_py()):
                terms.update(run)
                own.update(run)
            docs.update(own)
            size += len(terms)
            if size > HELD:
                yield from held()
                size = 0
    yield from held()


def term_vectors(docs: DataFrame, least_docs: int) -> DataFrame:
    """``docs(lang, source, text)`` → ``(lang, term, n, held)``: kept terms, their counts in the language and, in order of sources, the
    ``(source, n)`` of the groups that have them."""
    partial = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # One exchange serves both groupings; tasks have counted already.
    counts = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held")
    )
    return vectors.filter(F.col("docs") >= least_docs).select("lang", "term", "n", "held")


def _share(count: Column | int, total: Column, kinds: Column) -> Column:
    """p, or q, of a term: exact, as a long."""
    count = F.lit(count) if isinstance(count, int) else count
    scaled = (count.cast("decimal(20,0)") + 1) * F.lit(10**9).cast("decimal(10,0)")
    # No term, no share: the divisor only keeps the expression defined.
    return F.call_function("div", scaled, F.greatest(total + kinds, F.lit(1)).cast("decimal(20,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, kinds)``: one row per group that occurs."""
    own = vectors.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = vectors.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kinds"))
    every = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return every.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "kinds")])


def source_pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, other, value)``: the divergence of each source from each other one of its language.

    Shares are worked out once per entry of a vector; what is done per pair is long arithmetic, summed before any exchange. No sum comes
    near a long's bound: shares of one source add up to 10^9 + V, so f over all terms is at most (10^9 + 1) (10^9 + V).
    """
    total, kinds = F.col("total"), F.col("kinds")
    zeros = groups.select("lang", "source", "total", "kinds", _share(0, total, kinds).alias("zero"))
    zeros = materialize(zeros, "divergence-zeros")
    other = zeros.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    pairs = zeros.select("lang", "source", "zero", "kinds").join(other, "lang").filter("source <> other")
    pairs = materialize(pairs, "divergence-pairs")
    x, y, zero, other_zero = (F.col(c) for c in ("x", "y", "zero", "other_zero"))
    absent = _divergence(zero, other_zero)

    counts = vectors.select("lang", F.inline("held")).groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    counts = counts.join(zeros.drop("zero"), ["lang", "source"]).select("lang", "source", "m", _share(F.col("n"), total, kinds).alias("p"))
    counts = materialize(counts, "divergence-counts")
    mine = counts.withColumnRenamed("p", "x").join(pairs, ["lang", "source"])
    theirs = counts.select("lang", F.col("source").alias("other"), "m", F.col("p").alias("y")).join(pairs, ["lang", "other"])

    # At most one entry a source, as in the vectors.
    sizes = zeros.groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "zero")))).alias("sizes"), F.first("kinds").alias("kinds")
    )
    cells = vectors.groupBy("lang", "held").agg(F.count("*").alias("m")).join(sizes, "lang")
    shares = F.transform("held", lambda e: F.struct(
        e["source"].alias("source"), _share(e["n"], F.col("sizes")[e["source"]]["total"], kinds).alias("p"), F.col("sizes")[e["source"]]["zero"].alias("zero"),
    ))
    cells = materialize(cells.select("lang", "m", shares.alias("shares")), "divergence-vectors")
    both = cells.select("lang", "m", "shares", F.explode("shares").alias("a")).select("lang", "m", "a", F.explode("shares").alias("b"))
    both = both.filter("a.source <> b.source").select(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"), "m", F.col("a.p").alias("x"), F.col("b.p").alias("y"),
        F.col("a.zero").alias("zero"), F.col("b.zero").alias("other_zero"),
    )

    def summed(rows: DataFrame, m: Column, value: Column) -> DataFrame:
        return rows.groupBy("lang", "source", "other").agg(F.sum(m * value).alias("value"))

    parts = [
        summed(pairs, kinds, absent),
        summed(mine, F.col("m"), _divergence(x, other_zero) - absent),
        summed(theirs, F.col("m"), _divergence(zero, y) - absent),
        summed(both, F.col("m"), _divergence(x, y) - _divergence(x, other_zero) - _divergence(zero, y) + absent),
    ]
    return reduce(DataFrame.union, parts).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def leading_terms(vectors: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """``(lang, source, term, value, rank)``: the terms that a source has more often than its language, up to ``ranks``."""
    entries = vectors.select("lang", "term", F.col("n").alias("y"), F.inline("held")).withColumnRenamed("n", "x")
    p, q = _share(F.col("x"), F.col("total"), F.col("kinds")), _share(F.col("y"), F.col("lang_total"), F.col("kinds"))
    cells = entries.groupBy("lang", "source", "x", "y").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    cells = cells.select("lang", "source", "x", "y", "m", p.alias("p"), q.alias("q")).filter("p > q")
    cells = materialize(cells.select("lang", "source", "x", "y", "m", _divergence(F.col("p"), F.col("q")).alias("value")), "divergence-cells")
    group = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # A value has at least one term, so so many values are enough.
    values = values.withColumn("at", F.row_number().over(group)).filter(F.col("at") <= ranks)
    before = F.coalesce(F.sum("m").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < ranks).select("lang", "source", "value", "before")
    reached = materialize(cells.join(values, ["lang", "source", "value"]).drop("m"), "divergence-reached")
    within = F.row_number().over(W.partitionBy("lang", "source", "value").orderBy("term"))
    expanded = entries.join(reached, ["lang", "source", "x", "y"]).withColumn("within", within).filter(F.col("within") <= ranks)
    return expanded.select("lang", "source", "term", "value", (F.col("before") + F.col("within")).cast("int").alias("rank")).filter(F.col("rank") <= ranks)


def audit(
    docs: DataFrame, least_docs: int = 3, ranks: int = 200, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: per group, all other sources of its language (``pair``) and its leading terms
    (``term``), each ranked from 1 by value, ties by UTF-8."""
    plain = docs.select(*[F.coalesce(named(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    vectors = materialize(term_vectors(plain, least_docs), "divergence-terms")
    groups = materialize(group_sizes(plain, vectors), "divergence-groups")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = source_pairs(vectors, groups).withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).withColumnRenamed("other", "item").select(*columns).union(
        leading_terms(vectors, groups, ranks).withColumn("part", F.lit("term")).withColumnRenamed("term", "item").select(*columns)
    )
