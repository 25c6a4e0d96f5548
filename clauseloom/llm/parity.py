"""N-gram Jaccard join by parity sketches: every link at or above a ratio, and the classes that links make.

A document's set holds the hashes of its distinct word shingles. Two sets of sizes a and b are linked when their Jaccard similarity is at least
``part / whole``, which is the same as a symmetric difference d with ``(whole + part) d <= (whole - part) (a + b)``.

* *Size bands.* Bands grow by ``whole / part``, so partners lie in one band or in neighbours. A band bounds d for all its pairs by some D.
* *Parity sketch.* For its band (and for the one below, where it may be the larger partner) a set is dealt by hash to D + 1 parts of 64 bits each, and a bit
  tells whether an odd number of shingles fell on it. The Hamming distance of two sketches is at most d.
* *Pigeonhole.* Of D + 1 parts at least one has no differing shingle, so its word is equal: sets meet under the words of their parts, and no
  pair is missed. More is true: with the parts in a ring, one of them is such that it and the l - 1 parts after it differ in at most l - 1 bits, for
  every l. So the part after an equal part differs in one bit at most, and agrees in one of its halves.
* Pairs that meet are discarded by their sizes and by the Hamming distance of whole sketches; survivors are verified on their texts.
* Only links between classes matter. First members of a key meet one member of it, and each is verified against the one with
  which it shares most keys, for some rounds, each with other members: a large group of near copies becomes one class without its
  pairs being tried. Then every pair that still lies in two classes is tried, under keys that a half of the next part makes finer, so that texts
  which share a passage, or parts with hardly any odd bit, do not meet for that alone; and only where the parts after it allow a link.

Sets are compared by 64-bit hashes of their shingles, told apart by 128 bits, and numbered by a written table. Copies, and texts of equal sets, are one
row in all this. Pairs of one class are not enumerated (a group of n near copies has n² / 2 of them), so no number of links is given.

Defined results: fewer words than a shingle are one shingle; null texts and texts without words have an empty set, link with nothing and are
classes of their own; repeated rows are one class; a null id takes part but is never the class id unless the class has no other; an empty table gives
no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import named, tidy
from clauseloom.llm.components import components
from clauseloom.session import materialize

SEED, RUN, REMEMBERED = 42, 1 << 20, 200_000
#: A part with at most so many odd bits is in many sets; it is a key of the last step only.
WEAK_BITS = 2
#: Parts after an equal one whose differences are added up.
RING = 4
#: Rounds in which members of a key meet one of them; they decide on speed alone.
ROUNDS = 2
ODD_A, ODD_B, ODD_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256)).lower()


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD_B
    x = (x ^ (x >> np.uint64(27))) * ODD_C
    return x ^ (x >> np.uint64(31))


def _word_runs(text: str) -> Iterator[np.ndarray]:
    """Hashes of the words in order (lower-cased A-Z, between ASCII white space), in runs of bounded size."""
    data, start = text.encode().translate(_SPACED), 0
    while start < len(data):
        end = data.find(b" ", start + RUN)
        end = len(data) if end < 0 else end
        words = data[start:end].split()
        yield np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        start = end


def shingle_set(text: str, shingle: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = np.concatenate([np.zeros(0, np.uint64), *_word_runs(text)])
    width = min(shingle, len(words))
    if not width:
        return words
    made = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        made = _mixed(made * ODD_A + words[k : len(words) - width + 1 + k])
    return np.unique(made)


def size_bands(ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each band, and its number of parts: one more than the largest difference of a linked pair whose smaller set is in it."""
    part, whole = ratio
    least, parts, size = [], [], 1
    while size < 1 << 40:
        last = size * whole // part
        least.append(size)
        parts.append((whole - part) * (last + last * whole // part) // (whole + part) + 1)
        size = last + 1
    return np.array(least, np.int64), np.array(parts, np.int64)


def sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The words of a sorted set's parts."""
    # By the upper half of a hash, so sorted shingles are in order of parts.
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    folded = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (hashes & np.uint64(63)))])
    return folded[starts[1:]] ^ folded[starts[:-1]]


SIGNATURE = "struct<hi:bigint,lo:bigint,n:int,band:int,own:array<bigint>,up:array<bigint>>"


def signature(text: Column, ratio: tuple[int, int], shingle: int) -> Column:
    """The set's hash (``hi``, ``lo``), size, band, and its sketch for its own band and for the one below (``up``)."""
    least, parts = size_bands(ratio)
    names = [f.split(":")[0] for f in SIGNATURE[7:-1].split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2]
    none = np.zeros(0, np.int64)

    def one(value: str) -> tuple:
        hashes = shingle_set(value, shingle)
        band = int(np.searchsorted(least, len(hashes), side="right")) - 1
        # In bands of one part linked sets are equal.
        made = [sketch(hashes, int(parts[x])).view(np.int64) if x >= 0 and parts[x] > 1 else none for x in (band, band - 1)]
        both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), SEED), ">i8")
        return int(both[0]), int(both[1]), len(hashes), band, *made

    @F.arrow_udf(SIGNATURE)
    @tidy
    def signatures(texts: pa.Array) -> pa.Array:
        made = [one(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

    return signatures(text)


def linked(u: Column, v: Column, ratio: tuple[int, int], shingle: int) -> Column:
    """Whether two texts have that similarity."""
    part, whole = ratio

    @F.arrow_udf("boolean")
    @tidy
    def verified(us: pa.Array, vs: pa.Array) -> pa.Array:
        out, last, held = [], None, None
        for a, b in zip(us, vs, strict=True):
            a = a.as_py() or ""
            if a != last:
                last, held = a, shingle_set(a, shingle)
            other = shingle_set(b.as_py() or "", shingle)
            common = len(np.intersect1d(held, other, assume_unique=True))
            out.append(whole * common >= part * (len(held) + len(other) - common))
        return pa.array(out, pa.bool_())

    return verified(u, v)


def _entries(nodes: DataFrame, weak: bool) -> DataFrame:
    """``(key, node, low)``: the parts of a set; ``low`` where the part is of its own band. Parts with few odd bits, or the others."""
    made = []
    for low, words in ((True, "own"), (False, "up")):
        level = F.col("band") if low else F.col("band") - 1
        # A row becomes many: without a key, the exchange is not coalesced.
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = nodes.filter(F.size(words) > 0).select("node", level.alias("level"), words).repartition(tasks)
        rows = rows.select("node", "level", F.posexplode(words).alias("i", "word")).filter((F.bit_count("word") <= WEAK_BITS) == weak)
        made.append(rows.select(F.xxhash64("level", "i", "word").alias("key"), "node", F.lit(low).alias("low")))
    return made[0].union(made[1])


def _shared(entries: DataFrame, label: str) -> DataFrame:
    """Entries under keys of several sets. A set has a key once, so counting them is enough."""
    several = entries.groupBy("key").count().filter(F.col("count") > 1).select("key")
    return materialize(entries.join(several, "key"), label)


def _meeting(entries: DataFrame, label: str) -> DataFrame:
    """Entries under keys with sets of different classes, one of them of the key's own band (any other pair has another key, too)."""
    spread = entries.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.bool_or("low").alias("any_low"))
    return materialize(entries.join(spread.filter("any_low AND least < most").select("key"), "key"), label)


def _next_parts(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries under finer keys: the part's key and a half of the part after it, twice; ``w1``... are the words of the parts after it, ``sketch`` is
    all of them."""
    words = F.when(F.col("low"), F.col("own")).otherwise(F.col("up"))
    joined = entries.join(nodes.select("node", "n", "band", "own", "up"), "node")
    level = F.when(F.col("low"), F.col("band")).otherwise(F.col("band") - 1)
    keys = F.transform(words, lambda word, i: F.xxhash64(level, i, word))
    joined = joined.withColumn("i", F.array_position(keys, F.col("key")).cast("int") - 1)
    after = [F.get(words, (F.col("i") + k) % F.size(words)).alias(f"w{k}") for k in range(1, RING + 1)]
    rows = joined.select("key", "node", "root", "low", "n", words.alias("sketch"), *after)
    half = F.when(F.col("half") == 0, F.col("w1").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(F.shiftrightunsigned("w1", 32))
    rows = rows.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumn("key", F.xxhash64("key", "half", half)).drop("half")


def _allowed() -> Column:
    """Whether the parts after an equal one leave a link possible, from this part on."""
    total, fits = F.lit(0), F.lit(True)
    for k in range(1, RING + 1):
        total = total + F.bit_count(F.col(f"w{k}_u").bitwiseXOR(F.col(f"w{k}_v")))
        fits = fits & (total <= k)
    return fits


def _close(ratio: tuple[int, int]) -> Column:
    """Whether the sizes ``n_u``, ``n_v`` and the sketches of one level leave a link possible."""
    part, whole = ratio
    differ = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x).cast("long")
    n_u, n_v = F.col("n_u").cast("long"), F.col("n_v").cast("long")
    return (part * F.greatest(n_u, n_v) <= whole * F.least(n_u, n_v)) & ((whole + part) * differ <= (whole - part) * (n_u + n_v))


def _possible(pairs: DataFrame, nodes: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs whose sizes and sketches leave a link possible."""
    for side in "uv":
        shapes = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "band", "own", "up")])
        pairs = pairs.join(shapes, side)
    level = F.least("band_u", "band_v")
    sketches = {f"sketch_{s}": F.when(F.col(f"band_{s}") == level, F.col(f"own_{s}")).otherwise(F.col(f"up_{s}")) for s in "uv"}
    return pairs.filter(F.abs(F.col("band_u") - F.col("band_v")) <= 1).withColumns(sketches).filter(_close(ratio)).select("u", "v")


def links(nodes: DataFrame, texts: DataFrame, ratio: tuple[int, int], shingle: int) -> DataFrame:
    """``nodes(node, n, band, own, up, doc, th)`` and ``texts(text_doc, text_th, text)`` → ``(u, v)``: linked pairs, enough of
    them for the classes."""
    shared = _shared(_entries(nodes, weak=False), "parity-keys")
    few = materialize(nodes.join(shared.select("node").distinct(), "node"), "parity-few")

    def texts_of(wanted: DataFrame) -> DataFrame:
        held = texts.join(wanted.select("node", "doc", "th"), F.col("text_doc").eqNullSafe(F.col("doc")) & (F.col("text_th") == F.col("th")))
        return materialize(held.groupBy("node").agg(F.any_value("text").alias("text")), "parity-texts")

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        both = pairs.join(held.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v").join(
            held.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u"
        )
        return materialize(both.filter(linked(F.col("text_u"), F.col("text_v"), ratio, shingle)).select("u", "v"), "parity-found")

    def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
        roots = components(found, "parity-stars").withColumnRenamed("node", "of").withColumnRenamed("root", "least_root")
        roots = materialize(roots, "parity-roots")
        return rows.join(roots, F.col("node") == F.col("of"), "left").select("key", "node", "low", F.coalesce("least_root", "node").alias("root"))

    held = texts_of(few)
    found, apart = None, shared.withColumn("root", F.col("node"))
    for turn in range(ROUNDS):
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
        hubs = apart.groupBy("key").agg(F.min(F.when(F.col("low"), F.struct(order.alias("order"), "node", "root"))).alias("hub"))
        met = apart.join(hubs, "key").filter("root <> hub.root").select(F.col("node").alias("v"), F.col("hub.node").alias("u"))
        met = met.groupBy("v", "u").agg(F.count("*").alias("keys")).groupBy("v").agg(F.max(F.struct("keys", "u")).alias("best"))
        pairs = materialize(_possible(met.select(F.col("best.u").alias("u"), "v"), few, ratio), "parity-pairs")
        more = verified(pairs, held)
        found = more if found is None else materialize(found.union(more), "parity-links")
        apart = _meeting(rooted(shared, found), "parity-apart")
        if apart.isEmpty():
            break
    weak = _meeting(rooted(_shared(_entries(nodes, weak=True), "parity-weak"), found), "parity-apart")
    finer = _meeting(_next_parts(apart.unionByName(weak), nodes), "parity-finer")
    a, b = (finer.select("key", *[F.col(c).alias(f"{c}_{s}") for c in finer.columns if c != "key"]) for s in "uv")
    # The first of a pair is of the key's own band; of two such sets, the lesser.
    pair = (a["key"] == b["key"]) & F.col("low_u") & (F.col("root_u") != F.col("root_v")) & (~F.col("low_v") | (F.col("node_u") < F.col("node_v")))
    # All that can be told without texts is the join's condition, so that sets which only look alike come out of it as no pair.
    met = a.join(b.hint("merge"), pair & _allowed() & _close(ratio)).select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()
    pairs = materialize(met, "parity-pairs")
    if pairs.isEmpty():
        return found
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(few.select("node"), "node", "left_anti")
    return found.union(verified(pairs, held.union(texts_of(nodes.join(wanted, "node")))))


def jaccard_classes(
    docs: DataFrame, ratio: tuple[int, int] = (9, 10), shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``."""
    columns = [named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("th"), signature(named(text), ratio, shingle).alias("sign")]
    marked = materialize(docs.select(*columns).select("doc_id", "th", "sign.*"), "parity")
    shape = ("n", "band", "own", "up")
    made = marked.filter("n > 0").groupBy("hi", "lo").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")).alias("first"), F.any_value(F.struct(*shape)).alias("shape")
    )
    # Numbered once, in a written table: a later run of a lost task cannot number otherwise.
    nodes = materialize(made.select(
        F.monotonically_increasing_id().alias("node"), "hi", "lo", F.col("first.doc_id").alias("doc"), F.col("first.th").alias("th"), "shape.*"
    ), "parity-nodes")
    texts = docs.select(named(doc_id).alias("text_doc"), F.xxhash64(named(text)).alias("text_th"), named(text).alias("text"))
    roots = components(links(nodes, texts, ratio, shingle), "parity-classes").withColumnRenamed("node", "of")
    classes = nodes.join(roots, F.col("node") == F.col("of"), "left").select("hi", "lo", "doc", F.coalesce("root", "node").alias("root"))
    ids = classes.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_set = materialize(classes.join(ids, "root").select("hi", "lo", "component_id"), "parity-ids")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = marked.select("doc_id", "hi", "lo", F.col("n").cast("long").alias("n_shingles"))
    return rows.join(by_set, ["hi", "lo"], "left").select("doc_id", "n_shingles", own.alias("component_id"))
