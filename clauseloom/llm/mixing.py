"""Mixing sources to target weights by Pareto order sampling.

Words are shared out over sources by weight, no source beyond ``cap`` times its size (the excess is shared
again by weight). A source's target is so many certain copies of each of its documents, and for the rest a
sample without replacement of fixed size in words: every document has a random number U and an inclusion
probability π, documents are ranked by the odds U/(1-U) over the odds π/(1-π), and the least are taken
until the rest of the target is reached. π is the fraction of the source that is left to take; an ``odds``
column multiplies a document's inclusion odds, for samples of unequal probability within a source.

The cut in each source's order is found by two histograms of ranks, each of a fixed number of buckets a source and
summed before any shuffle; only rows of the one bucket that the cut falls into (of 16 million) are ordered
row by row. A source with a third of all rows is thus spread over all tasks, and texts are never shuffled.
U is a hash of seed, id and text: a rerun, or a lost executor, draws the same numbers.

Defined results: a null text has size 0; a null source is a source, last in order; documents of size 0 take no words;
rows equal in id and text share one draw and are taken or left together; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.llm.common import WORD, fresh, named
from clauseloom.session import materialize

BUCKETS = 4096


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """U of 52 random bits, inside 0 and 1."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def rank(u: Column, share: Column, odds: Column) -> Column:
    """Random odds over inclusion odds, brought to 0..1 without changing their order."""
    ratio = u / (1 - u) / (share / (1 - share) * odds)
    return F.when(share > 0, ratio / (1 + ratio)).otherwise(F.lit(1.0))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """``sizes(source, size)`` → ``(source, source_size, target, copies, part)``: one row per source.

    Sources in code-point order (null last) take ``weights`` in turn. Targets ``min(cap · size, λ · weight)``
    add up to ``share`` of all words; λ follows from the sources in order of size per weight.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # One row per source from here on: few enough for one ordered window.
    numbered = totals.withColumn("n", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    full = numbered.withColumn("weight", turn.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = W.orderBy(F.col("most") / F.col("weight"), "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = full.withColumn("level", level).withColumn("open", F.col("most") / F.col("weight") > F.col("level"))
    # Of the sources below their cap the first one has the level of all of them.
    common = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("open"), F.col("weight") * common).otherwise(F.col("most").cast("double"))
    per_word = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levels.withColumn("target", target).select(
        "n", "source", "source_size", "target", F.floor(per_word).alias("copies"), (per_word - F.floor(per_word)).alias("part")
    )


def _cuts(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """``ranked(n, size, at, u)`` → ``(n, cut_at, cut_u)``: the last rank that each source takes (null: none)."""
    rest = targets.select("n", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))
    coarse = F.least(F.floor(F.col("at") * BUCKETS), F.lit(BUCKETS - 1))
    fine = F.least(F.floor(F.col("at") * BUCKETS * BUCKETS), F.lit(BUCKETS * BUCKETS - 1))
    up_to = W.partitionBy("n").orderBy("bucket")

    def crossing(sums: DataFrame, bounds: DataFrame, name: str) -> DataFrame:
        """The bucket of each source in which the sum of sizes passes what is left, and what is left before it."""
        running = sums.join(bounds, "n").withColumn("through", F.sum("sum").over(up_to))
        return running.filter("through > rest").groupBy("n").agg(
            F.min("bucket").alias(name), F.min_by(F.col("rest") - (F.col("through") - F.col("sum")), "bucket").alias("rest")
        )

    first = ranked.groupBy("n", coarse.alias("bucket")).agg(F.sum("size").alias("sum"))
    outer = materialize(crossing(first, rest, "outer"), "mix-cut")
    inside = ranked.join(outer.select("n", "outer"), "n").filter(coarse == F.col("outer"))
    second = inside.groupBy("n", fine.alias("bucket")).agg(F.sum("size").alias("sum"))
    inner = materialize(crossing(second, outer.select("n", "rest"), "inner"), "mix-cut")
    last = ranked.join(inner, "n").filter(fine == F.col("inner"))
    # Rows of equal rank are one step of the running sum (the frame is by value).
    sums = last.groupBy("n", "rest", "at", "u").agg(F.sum("size").alias("sum"))
    through = F.sum("sum").over(W.partitionBy("n").orderBy("at", "u"))
    near = (F.col("through") <= F.col("rest")) | (
        (F.col("through") - F.col("sum") < F.col("rest")) & (F.col("through") - F.col("rest") < F.col("rest") - F.col("through") + F.col("sum"))
    )
    chosen = sums.withColumn("through", through).groupBy("n").agg(F.max(F.when(near, F.struct("at", "u"))).alias("cut"))
    # Sources whose sums never pass the rest take all; otherwise all below the bucket, and up to the cut in it.
    return rest.join(inner.select("n", "inner"), "n", "left").join(chosen, "n", "left").select(
        "n", F.when(F.col("inner").isNull(), F.struct(F.lit(2.0).alias("at"), F.lit(0.0).alias("u")))
        .otherwise(F.coalesce("cut", F.struct((F.col("inner") / (BUCKETS * BUCKETS)).alias("at"), F.lit(-1.0).alias("u")))).alias("cut")
    )


def _plan(rows: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``rows(source, size, u, odds)`` → per source target, certain copies, part and cut."""
    targets = materialize(source_targets(rows, weights, share, cap), "mix-targets")
    ranked = rows.join(targets.select(F.col("source").alias("of"), "n", "part"), F.col("source").eqNullSafe(F.col("of"))).select(
        "n", "size", rank(F.col("u"), F.col("part"), F.col("odds")).alias("at"), "u"
    )
    cuts = _cuts(ranked.filter("part > 0"), targets.filter("part > 0"))
    return materialize(targets.join(cuts, "n", "left"), "mix-plan")


def _times(plan: DataFrame, u: Column, odds: Column) -> Column:
    """Copies of a row: the certain ones and one more for ranks up to the cut."""
    at = rank(u, plan["part"], odds)
    more = F.coalesce(F.struct(at.alias("at"), u.alias("u")) <= plan["cut"], F.lit(False)) & (plan["part"] > 0)
    return plan["copies"] + more.cast("long")


def mix_counts(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 1,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", odds: str | None = None,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row per row of ``docs``."""
    rows = materialize(
        docs.select(
            named(doc_id).alias("doc_id"), named(source).alias("source"), size_in_words(named(text)).alias("size"),
            draw(named(doc_id), named(text), seed).alias("u"), (named(odds) if odds else F.lit(1.0)).alias("odds"),
        ), "mix",
    )
    plan = _plan(rows, weights, share, cap)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
    return joined.select(
        "doc_id", "size", "source_size", "target", (_times(plan, F.col("u"), F.col("odds")) * F.col("size")).alias("taken")
    )


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 1,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", odds: str | None = None,
) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; texts meet only the table of sources."""
    worth = named(odds) if odds else F.lit(1.0)
    u = draw(named(doc_id), named(text), seed)
    rows = materialize(
        docs.select(named(source).alias("source"), size_in_words(named(text)).alias("size"), u.alias("u"), worth.alias("odds")), "mix"
    )
    plan = _plan(rows, weights, share, cap)
    names = fresh(docs, *plan.columns, "copy")
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip(plan.columns, names, strict=False)])
    at = dict(zip(("n", "source", "source_size", "target", "copies", "part", "cut"), names, strict=False))
    joined = docs.join(plan, named(source).eqNullSafe(plan[at["source"]]))
    times = F.col(at["copies"]) + (
        F.coalesce(F.struct(rank(u, F.col(at["part"]), worth).alias("at"), u.alias("u")) <= F.col(at["cut"]), F.lit(False)) & (F.col(at["part"]) > 0)
    ).cast("long")
    copies = joined.withColumn(names[-1], F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select(*[named(c) for c in docs.columns])
