"""Near-duplicates by SimHash fingerprints and a pivot distance table.

The fingerprint of a text is the bitwise majority over the hashes of its word shingles. Two texts are linked
when their fingerprints differ in at most ``radius`` bits, and a class is everything reachable over links.

Links are found over distinct fingerprints, through Hamming distances to reference fingerprints:

* The table holds the distances to *axis* references (the zero fingerprint and one per bit) and to
  *spread* references (pseudo-random words).
* Distances to spread references all lie near half the word length, so no join on them prunes much. The axis
  distances do better: the difference to the zero reference tells one coordinate of the fingerprint.
  Two fingerprints within r bits agree on all coordinates of at least one of r + 1 groups of axis references,
  and, of what is left, again on at least one of r + 1 groups. Those two groups together are one join key
  of 28 coordinates; each fingerprint has (r + 1)² keys, and no pair within r is missed.
* A pair that meets is discarded when any spread coordinate differs by more than r (by the triangle
  inequality it can't be within r), and the survivors are verified by their exact distance. All this is the
  join's condition, which also takes a pair only under its first common key, so each link comes out once.

Copies share a fingerprint, and distinct fingerprints alone are joined: a group of copies of any size is
one row there.

Defined results: a null or empty text (no words) has fingerprint zero and links like any other; repeated rows
stay repeated; a null id takes part but is never the class id unless the class has no other; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import fresh, named
from clauseloom.llm.components import components
from clauseloom.session import materialize

BITS, SEED = 64, 42


def text_fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: lower-cased A-Z, words between ASCII white space, XXH64 of UTF-8."""
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else (words,)
    digest, join = xxhash.xxh64_digest, b" ".join
    counts, total, held = np.zeros(BITS, np.int64), 0, []

    def add() -> None:
        nonlocal total
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8)).reshape(-1, BITS)
        # 255 rows at a time fit in a byte each, which keeps the additions narrow.
        edges = np.arange(0, len(bits), 255)
        counts[:] += np.add.reduceat(bits, edges, axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += len(bits)
        held.clear()

    for gram in grams:
        held.append(digest(join(gram), SEED))
        if len(held) == 100_000:
            add()
    if held:
        add()
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Signed fingerprint of a text column."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t.as_py() or "", shingle) for t in texts], pa.int64())

    return fingerprints(text)


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _distance(value: Column, reference: int) -> Column:
    return F.bit_count(value.bitwiseXOR(F.lit(_signed(reference)).cast("long")))


def spread_references(count: int) -> list[int]:
    """Reference fingerprints by rule: the hash of their number."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED) for i in range(count)]


def key_groups(radius: int) -> list[tuple[int, ...]]:
    """Groups of axis references; every pair within ``radius`` agrees on all of at least one."""
    parts, groups = radius + 1, []
    outer = [range(BITS * i // parts, BITS * (i + 1) // parts) for i in range(parts)]
    for block in outer:
        rest = [bit for bit in range(BITS) if bit not in block]
        for i in range(parts):
            groups.append((*block, *rest[len(rest) * i // parts : len(rest) * (i + 1) // parts]))
    return groups


def distance_table(fingerprints: DataFrame, radius: int, spread: int = 16) -> DataFrame:
    """``(fp)`` → ``(fp, key, near, far)``: one row per key; ``near`` and ``far`` hold the distances to the
    spread references, a byte each."""
    zero = _distance(F.col("fp"), 0)
    # One row becomes many here, so the few partitions of a small table would be too few; without a key, the exchange
    # is neither merged with the one below nor coalesced.
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    axis = fingerprints.repartition(parts).select("fp", *[
        ((zero - _distance(F.col("fp"), 1 << bit) + 1) / 2).cast("long").alias(f"axis{bit}") for bit in range(BITS)
    ])
    packed = [
        reduce(Column.bitwiseOR, [F.shiftleft(_distance(F.col("fp"), r).cast("long"), 8 * i) for i, r in enumerate(half)])
        for half in (spread_references(spread)[: spread // 2], spread_references(spread)[spread // 2 :])
    ]
    keys = F.array(*[
        reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"axis{bit}"), i) for i, bit in enumerate(group)])
        for group in key_groups(radius)
    ])
    return axis.select("fp", packed[0].alias("near"), packed[1].alias("far"), F.posexplode(keys).alias("grp", "key"))


def links(fingerprints: DataFrame, radius: int = 3, spread: int = 16) -> DataFrame:
    """Distinct ``fp`` → ``(u, v)``: every pair that differs in ``radius`` bits or fewer, once."""
    table = distance_table(fingerprints, radius, spread)
    a, b = (table.select(*[F.col(c).alias(f"{c}_{s}") for c in table.columns]) for s in "ab")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    coordinates = [
        F.abs(F.shiftrightunsigned(f"{half}_a", 8 * i).bitwiseAND(255) - F.shiftrightunsigned(f"{half}_b", 8 * i).bitwiseAND(255))
        for half in ("near", "far") for i in range(spread // 2)
    ]
    masks = [_signed(sum(1 << bit for bit in group)) for group in key_groups(radius)]
    first = reduce(
        lambda rest, at: F.when(differ.bitwiseAND(F.lit(masks[at]).cast("long")) == 0, at).otherwise(rest),
        reversed(range(len(masks))), F.lit(len(masks)),
    )
    met = (F.col("grp_a") == F.col("grp_b")) & (F.col("key_a") == F.col("key_b")) & (F.col("fp_a") < F.col("fp_b"))
    near = (F.greatest(*coordinates) <= radius) & (F.bit_count(differ) <= radius) & (first == F.col("grp_a"))
    # A row became many on both sides, which size estimates do not see: neither side is to be broadcast.
    return a.join(b.hint("merge"), met & near).select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))


def _classes(least: DataFrame, radius: int) -> DataFrame:
    """``least(fp, ...)``: one row per distinct fingerprint → it with ``root``, the class's least fingerprint."""
    roots = components(links(least.select("fp"), radius), "simhash-links")
    return least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )


def near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``docs``."""
    marked = materialize(
        docs.select(named(doc_id).alias("doc_id"), fingerprint(named(text), shingle).alias("fp")), "simhash"
    )
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(_classes(least, radius), "simhash-classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def ranked(marked: DataFrame) -> DataFrame:
    """``marked(doc_id, row, fp, ...)`` → ``(fp, first)``: the first row of each ``fp``, and how many rows are equal to it."""
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    rows = marked.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n"))
    return rows.groupBy("fp").agg(F.min(F.struct(*[rank[k].alias(k) for k in ("absent", "doc_id", "row")], "n")).alias("first"))


def keep_first(docs: DataFrame, classes: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with the first row of each root of ``classes(root, first)``."""
    fp, row, n = fresh(docs, "fp", "row_hash", "row_count")
    whole = F.xxhash64(*[named(c) for c in docs.columns])
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias(fp), F.col("first.row").alias(row), F.col("first.n").alias(n)
    )
    same = named(doc_id).eqNullSafe(kept[fp]) & (whole == kept[row])
    stay = docs.join(kept, same).select(*[named(c) for c in docs.columns], row, n, fp)
    once = stay.filter(F.col(n) == 1)
    repeated = stay.filter(F.col(n) > 1).dropDuplicates([row, fp])
    return once.unionByName(repeated).select(*[named(c) for c in docs.columns])


def drop_near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (nulls last), then of the smallest hash of
    the whole row; of rows equal in every column one stays."""
    whole = F.xxhash64(*[named(c) for c in docs.columns])
    marked = materialize(
        docs.select(named(doc_id).alias("doc_id"), whole.alias("row"), fingerprint(named(text), shingle).alias("fp")),
        "simhash",
    )
    return keep_first(docs, materialize(_classes(ranked(marked), radius), "simhash-classes"), doc_id)
