"""Near-duplicates by the similarity of their shingle sets: all links at or above a ratio, none below.

The set of a text holds the hashes of its word shingles. Two texts are linked when the Jaccard similarity of their sets
is at least ``ratio`` (a numerator and a denominator), and a class is everything reachable over links.

* First op1's pivot distance table (``simhash.links``) meets the fingerprints of the sets: of the pairs within ``RADIUS`` bits, each
  set is tried with the least one that it met. Few pairs of similarity t lie so near, so this is no whole answer, and the rest follows.
* Sets are sorted by one order of all shingles. Of two sets of similarity t or more, the first n - ceil(t n) + 1 shingles of
  each (n its size) have one in common, so pairs meet under the shingles of these prefixes and none is missed. Any order
  will do; common shingles are put last, so that a line of many texts is hardly ever in a prefix.
* A pair that meets is discarded by its sizes or by its parity bits (each bit tells whether an odd number of shingles fell
  there; sets differ in at least as many shingles as bits), 256 of them. A set without any partner left goes no further: a semi-join
  finds the others, at most a row for each entry. What is left is tried once more by 2,048 bits, since 256 tell nothing of sets of
  600 shingles and more.
* Of these the texts are read once, and their sets written. For some rounds the members of each prefix shingle meet a few of
  them, and each set is tried with the one with which it shares most shingles: a large group of near copies becomes one class without
  its pairs being tried; pairs that longer parity excludes are not verified. Then every pair that still lies in two classes is tried, unless two or more parity bits a shingle exclude it.
  All that can be told by bits is the joins' condition. Links are verified by the exact similarity of the sets.

Copies, and texts of equal sets, are one row in all this. Shuffle files of a step are removed as soon as its result is written.

Defined results: fewer words than a shingle are one shingle; null and empty texts (no words) are alike; repeated
rows are one class; an empty table gives no rows. Only the id and text columns are read, and the whole row's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import simhash
from clauseloom.llm.common import named, tidy
from clauseloom.llm.components import components
from clauseloom.llm.simhash import BITS, SEED, keep_first, ranked
from clauseloom.session import materialize, shuffles_removed

#: Cells in which shingles are counted for their order, the share of a task's texts that makes a cell common there, and how
#: many of the most common are told to all tasks. They decide on speed alone: every order finds all pairs.
CELL_BITS, COMMON_SHARE, COMMON_LEAST, COMMON_CELLS = 20, 256, 16, 65_536
WORDS, WIDE = 4, 32  # parity words of 64 bits that every entry takes along, and those of the second test
SHAPE = ["n", *[f"b{i}" for i in range(WORDS)]]
WIDE_SHAPE = ["n", *[f"b{i}" for i in range(WIDE)]]
#: Bits within which the pivot table's pairs lie.
RADIUS = 3
#: Rounds in which members of a prefix shingle meet so many of them; they decide on speed alone.
#: They end early when fewer than a ``GAIN``-th of the pairs tried are links.
ROUNDS, HUBS, GAIN = 4, 4, 32


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes (unsigned): lower-cased A-Z, words between ASCII white space, XXH64 of UTF-8."""
    words = text.encode().lower().split()
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else (words,)
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.unique(np.frombuffer(b"".join([digest(join(gram), SEED) for gram in grams]), ">u8").astype(np.uint64))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def common_cells(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the most common shingles, sorted, and how many texts hold them (a lower bound)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                np.add.at(counts, _cells(shingle_set(value.as_py() or "", shingle)), 1)
            texts += batch.num_rows
        common = np.flatnonzero(counts >= max(COMMON_LEAST, texts // COMMON_SHARE))
        yield pa.RecordBatch.from_pydict({"cell": common, "n": counts[common]})

    found = docs.select(named(text).alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in found.orderBy(F.desc("n"), "cell").limit(COMMON_CELLS).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefix_length(n: int, ratio: tuple[int, int]) -> int:
    return n + -(ratio[0] * n) // ratio[1] + 1


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, signed: a bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[at : at + 100_000].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def parity_words(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity bits of a set, a power of two of them, ``bits`` or more."""
    size = max(64 * WORDS, 1 << (bits - 1).bit_length())
    odd = (np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(">i8").astype(np.int64)


def signature(text: Column, ratio: tuple[int, int], shingle: int, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """``fp`` (a hash of the set), its size ``n``, SimHash ``sim``, parity words ``wide``, and its ``prefix`` (32 bits a shingle:
    others that share them are discarded later)."""
    cells, counts = common

    def one(value: str) -> tuple:
        hashes = shingle_set(value, shingle)
        at = _cells(hashes)
        weight = np.zeros(len(hashes), np.int64)
        if len(cells):
            spot = np.minimum(np.searchsorted(cells, at), len(cells) - 1)
            weight = np.where(cells[spot] == at, counts[spot], 0)
        # Stable over sorted hashes: of equal weights, the smaller hash is first.
        first = hashes[np.argsort(weight, kind="stable")[: prefix_length(len(hashes), ratio)]]
        wide = parity_words(hashes, 64 * WIDE)
        fp = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
        keys = np.unique((first & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)
        return fp - (1 << 64) if fp >> 63 else fp, len(hashes), fingerprint(hashes), wide, keys

    names = ["fp", "n", "sim", "wide", "prefix"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    @F.arrow_udf("struct<fp:bigint,n:int,sim:bigint,wide:array<bigint>,prefix:array<int>>")
    @tidy
    def signatures(texts: pa.Array) -> pa.Array:
        made = [one(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

    return signatures(text)


def whole_set(text: Column, shingle: int) -> Column:
    """``hashes`` of a text's set, and its ``parity`` of two bits a shingle or more, of short texts four."""

    @F.arrow_udf("struct<hashes:array<bigint>,parity:array<bigint>>")
    @tidy
    def sets(texts: pa.Array) -> pa.Array:
        made = [shingle_set(t.as_py() or "", shingle) for t in texts]
        kind = pa.list_(pa.int64())
        parity = [parity_words(m, max(min(4 * len(m), 2048), 2 * len(m))) for m in made]
        return pa.StructArray.from_arrays([pa.array([m.view(np.int64) for m in made], kind), pa.array(parity, kind)], ["hashes", "parity"])

    return sets(text)


def similar(u: Column, v: Column, ratio: tuple[int, int]) -> Column:
    """Whether two arrays of distinct hashes have that similarity."""
    part, whole = ratio
    common = F.size(F.array_intersect(u, v)).cast("long")
    return whole * common >= part * (F.size(u).cast("long") + F.size(v).cast("long") - common)


def shape(words: int) -> list[Column]:
    """``n`` and that many parity words, of the ``wide`` ones folded: a shorter parity is the exclusive or of the parts of a longer one."""
    return [F.col("n"), *[
        reduce(Column.bitwiseXOR, [F.col("wide")[at] for at in range(i, WIDE, words)]).alias(f"b{i}") for i in range(words)
    ]]


def _sizes_possible(ratio: tuple[int, int]) -> Column:
    n_u, n_v = F.col("n_u").cast("long"), F.col("n_v").cast("long")
    return ratio[0] * F.greatest(n_u, n_v) <= ratio[1] * F.least(n_u, n_v)


def _possible(ratio: tuple[int, int], words: int = WORDS) -> Column:
    """Whether the shapes ``_u`` and ``_v`` leave a similarity of ``ratio`` possible."""
    part, whole = ratio
    n_u, n_v = F.col("n_u").cast("long"), F.col("n_v").cast("long")
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"b{i}_u").bitwiseXOR(F.col(f"b{i}_v"))) for i in range(words)])
    return _sizes_possible(ratio) & ((whole + part) * bits <= (whole - part) * (n_u + n_v))


def _still_possible(ratio: tuple[int, int]) -> Column:
    """The same by all parity bits; of sizes that ``_possible`` lets through, one is folded once at most."""
    part, whole = ratio
    size = F.least(F.size("parity_u"), F.size("parity_v"))

    def folded(x: Column) -> Column:
        half = F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > size, half).otherwise(x)

    differ = F.zip_with(folded(F.col("parity_u")), folded(F.col("parity_v")), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    bits = F.aggregate(differ, F.lit(0), lambda n, x: n + x).cast("long")
    return (whole + part) * bits <= (whole - part) * (F.col("n_u").cast("long") + F.col("n_v").cast("long"))


def pivot_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes(fp, sim)`` → ``(u, v)``: each set with the least of those that the pivot table finds within ``radius`` bits of it."""
    # Sets of one fingerprint are one row of the table.
    heads = materialize(nodes.groupBy("sim").agg(F.min("fp").alias("head")), "similar-prints")
    near = simhash.links(heads.select(F.col("sim").alias("fp")), radius)
    apart = near.join(heads.select(F.col("sim").alias("u"), F.col("head").alias("head_u")), "u").join(
        heads.select(F.col("sim").alias("v"), F.col("head").alias("head_v")), "v"
    )
    least = apart.select(F.least("head_u", "head_v").alias("u"), F.greatest("head_u", "head_v").alias("v")).groupBy("v").agg(F.min("u").alias("u"))
    alike = nodes.select("fp", "sim").join(heads, "sim").filter("fp <> head")
    return least.select("u", "v").union(alike.select(F.col("head").alias("u"), F.col("fp").alias("v")))


def links(nodes: DataFrame, texts: DataFrame, ratio: tuple[int, int], shingle: int) -> DataFrame:
    """``nodes(fp, doc, row, n, sim, wide, prefix)`` and ``texts(text_doc, text_row, text)`` → ``(u, v)``: pairs of similarity
    ``ratio`` or more, enough of them for the classes."""
    # A row becomes many: without a key, the exchange is not coalesced.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = nodes.select("fp", *shape(WORDS))
    entries = nodes.select("fp", *shape(WORDS), "prefix").repartition(parts).select("fp", *SHAPE, F.explode("prefix").alias("key"))
    # A set has a key once, so counting is enough.
    several = entries.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1").select("key")
    shared = materialize(entries.join(several, "key"), "similar-keys")

    def with_partner(rows: DataFrame, columns: list[str], words: int) -> DataFrame:
        """The sets of ``rows(key, fp, ...)`` that have a possible partner under a key."""
        a, b = (rows.select("key", F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "uv")
        meets = (a["key"] == b["key"]) & (F.col("u") != F.col("v")) & _possible(ratio, words)
        return materialize(a.join(b.hint("merge"), meets, "left_semi").select(F.col("u").alias("fp")).distinct(), "similar-alive")

    near = with_partner(shared, SHAPE, WORDS)
    # Before they are shuffled, the wider words meet only sets that the first test left.
    wide = nodes.select("fp", "n", "wide").join(near, "fp").select("fp", *shape(WIDE))
    alive = with_partner(shared.select("key", "fp").join(wide.hint("merge"), "fp"), WIDE_SHAPE, WIDE)

    key = ["text_row", "absent", "present"]
    picked = nodes.select(
        F.col("row").alias("text_row"), F.col("doc").isNull().alias("absent"), F.coalesce("doc", F.lit(0)).alias("present"), "fp", "n"
    ).join(alive, "fp")
    found_texts = texts.select("text_row", F.col("text_doc").isNull().alias("absent"), F.coalesce("text_doc", F.lit(0)).alias("present"), "text")
    # Rows may be equal in every column: any of them will do, and they lie together already.
    held = found_texts.join(picked.hint("merge"), key).dropDuplicates(key)
    sets = materialize(held.select("fp", "n", whole_set(F.col("text"), shingle).alias("made")).select("fp", "n", "made.*"), "similar-sets")

    def of_pairs(pairs: DataFrame, *columns: str) -> DataFrame:
        """``pairs(u, v)`` with columns of both sets."""
        u, v = (sets.select(F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "uv")
        return pairs.join(u, "u").join(v, "v")

    def verified(pairs: DataFrame) -> DataFrame:
        possible = of_pairs(pairs, "n", "parity").filter(_sizes_possible(ratio) & _still_possible(ratio)).select("u", "v")
        both = of_pairs(materialize(possible, "similar-pairs"), "hashes")
        return materialize(both.filter(similar(F.col("hashes_u"), F.col("hashes_v"), ratio)).select("u", "v"), "similar-found")

    entries = materialize(shared.select("key", "fp").join(alive, "fp"), "similar-entries")

    def meeting(found: DataFrame) -> DataFrame:
        """Entries under keys with sets of different classes."""
        roots = materialize(components(found, "similar-stars"), "similar-roots").withColumnRenamed("node", "fp")
        rooted = entries.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
        spread = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        return materialize(rooted.join(spread.select("key"), "key"), "similar-apart")

    found = verified(pivot_pairs(nodes))
    apart = meeting(found)
    for turn in range(ROUNDS):
        orders = [F.xxhash64("fp", F.lit(turn * HUBS + k)) for k in range(HUBS)]
        hubs = apart.groupBy("key").agg(*[F.min(F.struct(o.alias("order"), "fp", "root")).alias(f"h{k}") for k, o in enumerate(orders)])
        hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*[
            F.struct(F.col(f"h{k}.fp").alias("fp"), F.col(f"h{k}.root").alias("root")) for k in range(HUBS)
        ]))).alias("hub"))
        met = apart.join(hubs, "key").filter("root <> hub.root").groupBy(F.col("fp").alias("v"), F.col("hub.fp").alias("u")).agg(F.count("*").alias("keys"))
        best = met.groupBy("v").agg(F.max(F.struct("keys", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")
        best = materialize(best, "similar-best")
        more = verified(best)
        gained = more.count()
        if not gained:
            break
        found = materialize(found.union(more), "similar-links")
        apart = meeting(found)
        if apart.isEmpty():
            return found
        if gained * GAIN < best.count():
            break
    shaped = materialize(apart.join(shapes, "fp"), "similar-shaped")

    def sides(rows: DataFrame, *more: str) -> list[DataFrame]:
        columns = ("root", *SHAPE, *more)
        return [rows.select("key", F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "uv"]

    # Only sets that still may have a partner in another class take their longer parity along.
    a, b = sides(shaped)
    meets = (a["key"] == b["key"]) & (F.col("root_u") != F.col("root_v")) & _possible(ratio)
    left = materialize(a.join(b.hint("merge"), meets, "left_semi").select("key", F.col("u").alias("fp")), "similar-left")
    a, b = sides(shaped.join(left, ["key", "fp"]).join(sets.select("fp", "parity"), "fp"), "parity")
    apart_still = (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v"))
    pairs = a.join(b.hint("merge"), apart_still & _possible(ratio) & _still_possible(ratio)).select("u", "v").distinct()
    return found.union(verified(pairs))


def drop_similar(
    docs: DataFrame, ratio: tuple[int, int] = (4, 5), shingle: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (nulls last), then of the smallest hash of
    the whole row; of rows equal in every column one stays."""
    with shuffles_removed(docs.sparkSession):
        classes = _classes(docs, ratio, shingle, doc_id, text)
    return keep_first(docs, classes, doc_id)


def _classes(docs: DataFrame, ratio: tuple[int, int], shingle: int, doc_id: str, text: str) -> DataFrame:
    """``(fp, root, first)``: every set with its class and the first row that has it."""
    sign = signature(named(text), ratio, shingle, common_cells(docs, text, shingle))
    whole = F.xxhash64(*[named(c) for c in docs.columns])
    marked = materialize(
        docs.select(named(doc_id).alias("doc_id"), whole.alias("row"), sign.alias("sign")).select("doc_id", "row", "sign.*"), "similar"
    )
    shapes = marked.groupBy("fp").agg(*[F.any_value(c).alias(c) for c in ("n", "sim", "wide", "prefix")])
    nodes = materialize(ranked(marked).join(shapes, "fp"), "similar-nodes")
    picked = nodes.select("fp", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row"), "n", "sim", "wide", "prefix")
    # Names of its own, so that no further column of the documents can clash.
    texts = docs.select(named(doc_id).alias("text_doc"), whole.alias("text_row"), named(text).alias("text"))
    roots = components(links(picked, texts, ratio, shingle), "similar-links").withColumnRenamed("node", "fp")
    classes = nodes.select("fp", "first").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(classes, "similar-classes")
