"""Lexicons as tables: thousands of rules ``(rule_id, signal, pattern)`` over every sentence.

Trying each pattern on each sentence costs rules times sentences. Nearly every pattern contains words that a match cannot do without, so
an Aho-Corasick automaton over one such set of literals per rule names, in one pass over a sentence, the few rules that may match; those
alone are verified, by the engine's own ``rlike``. Rules without a literal are tried on every sentence.

A small lexicon's size is checked before the automaton is built from it, once, and sent to the
executors as a broadcast value. Sentences are as many as the corpus has: they pass through in their order, and only
candidates are joined with the patterns. A lexicon of any size (``tag_by_join``) stays a table: literals and the parts of a sentence meet by
their hashes, and a bit table of bounded size keeps parts that are no literal from being joined.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.batches import tidy
from clauseloom.session import materialize

#: Bytes of all patterns of a lexicon; beyond it no automaton is made of it.
LARGEST = 64 << 20
#: Bytes of patterns up to which ``tag_all`` takes the automaton, which every Python worker holds.
SMALL = 4 << 20
#: Longest part of a literal that is looked up, bits of the table of literals a literal, its largest size (as a power of 2) and probes.
WIDEST, BITS_EACH, MOST_BITS, PROBES = 16, 32, 28, 3
#: Widths at which a place of a text is given up where no literal begins like it.
GATES = (4, 8)

# What the pattern language of the engine has and the parser lacks. Only literals are read from the result, so that a
# class may stand for another one.
_TRANSLATED = (
    (re.compile(r"\\x\{([0-9A-Fa-f]+)\}"), lambda m: re.escape(chr(int(m[1], 16)))), (re.compile(r"\\[pP](\{\^?\w+\}|\w)"), lambda m: r"\w"),
    (re.compile(r"\\[zZG]"), lambda m: r"\Z"), (re.compile(r"\\h"), lambda m: r"\s"), (re.compile(r"\\R"), lambda m: r"\s"),
)
_FOLDED = {"İ": "i"}


@lru_cache(100_000)
def _fold_char(char: str) -> str:
    """One character for another: what is equal to it without regard to case has the same."""
    upper = char.upper()
    lower = (upper if len(upper) == 1 else char).lower()
    return _FOLDED.get(char) or (lower if len(lower) == 1 else char)


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_fold_char, text))


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets the one whose shortest literal is longer, where every further literal counts like two characters less; then the smaller one.

    Without that, rules that differ in a short number only would all be looked up by the words that they share.
    """
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)) - 2 * (len(s) - 1), -len(s)))


def _required(items) -> frozenset[str] | None:
    best, run = None, ""

    def ended() -> None:
        nonlocal best, run
        best, run = _better(best, frozenset([run]) if run else None), ""

    for kind, value in items:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if kind is op.IN and len(value) == 1 and value[0][0] is op.LITERAL:
            run += chr(value[0][1])
            continue
        ended()
        if kind is op.SUBPATTERN:
            best = _better(best, _required(value[-1]))
        elif kind in (op.ATOMIC_GROUP, ):
            best = _better(best, _required(value))
        elif kind is op.BRANCH:
            every = [_required(branch) for branch in value[1]]
            best = _better(best, frozenset().union(*every) if all(every) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            best = _better(best, _required(value[2]))
        elif kind is op.ASSERT and value[0] == 1:
            best = _better(best, _required(value[1]))
    ended()
    return best


@lru_cache(10_000)
def _shape_literals(pattern: str) -> frozenset[str]:
    for find, by in _TRANSLATED:
        pattern = find.sub(by, pattern)
    try:
        return frozenset(map(fold, _required(parser.parse(pattern)) or ()))
    except (re.error, OverflowError, RecursionError):
        return frozenset()


# Words behind a space, of which each character stands for itself wherever such a word may be in a pattern, and what stands for them in its shape.
_WORD, _HELD = re.compile(r"(?<=[^\\] )[0-9A-Za-z]{1,1000}(?=[ ()|$]|\Z)"), 0xF0000


def required_literals(pattern: str) -> frozenset[str]:
    """Literals, folded, one of which is in every text that the pattern matches; none where that cannot be told.

    Rules of a lexicon differ in few words: a shape is parsed once, with a private character for each of these words' own.
    """
    words = "" if "\\N" in pattern else "".join(_WORD.findall(pattern))
    if not 0 < len(words) < 0xFFFE or any(_HELD <= ord(c) for c in pattern):
        return _shape_literals(pattern)
    count = 0

    def held(word: re.Match) -> str:
        nonlocal count
        first, count = _HELD + count, count + word.end() - word.start()
        return "".join(map(chr, range(first, _HELD + count)))

    literals = _shape_literals(_WORD.sub(held, pattern))
    own = {_HELD + i: char for i, char in enumerate(words.lower())}
    return frozenset(literal.translate(own) for literal in literals)


@lru_cache(2)
def _automaton(literals: tuple[tuple[str, int], ...]):
    owners: dict[str, list[int]] = {}
    for literal, number in literals:
        owners.setdefault(literal, []).append(number)
    made = ahocorasick.Automaton()
    for literal, numbers in owners.items():
        made.add_word(literal, tuple(numbers))
    made.make_automaton()
    return made


def _finder(shared, always: list[int]):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def possible(texts: pa.Array) -> pa.Array:
        automaton = _automaton(shared.value) if shared.value else None
        numbers, counts = [], []
        for value in texts:
            text = value.as_py()
            own = set() if text is None else set(always)
            if automaton is not None and text:
                for _, found in automaton.iter(fold(text)):
                    own.update(found)
            numbers += sorted(own)
            counts.append(len(own))
        offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers, pa.int32()))

    return possible


def pattern_bytes(rules: DataFrame) -> int:
    return rules.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first().bytes


class Lexicon:
    """A table of rules ready to be matched. ``rules(rule_id, signal, pattern)``; rules without a pattern never match."""

    def __init__(self, rules: DataFrame):
        spark = rules.sparkSession
        patterns = rules.filter("pattern IS NOT NULL")
        size = pattern_bytes(rules)
        if size > LARGEST:
            raise ValueError(f"a lexicon of {size} bytes; at most {LARGEST} are sent to every executor")
        rows = patterns.select("rule_id", "signal", "pattern").distinct().collect()
        rows.sort(key=lambda r: (str(r.rule_id), r.signal or "", r.pattern))
        literals, always = [], []
        for number, row in enumerate(rows):
            found = required_literals(row.pattern)
            literals += [(literal, number) for literal in found]
            if not found:
                always.append(number)
        self.unconditional = len(always)
        self._possible = _finder(spark.sparkContext.broadcast(tuple(literals)), always)
        kind = rules.schema["rule_id"].dataType.simpleString()
        self.rules = spark.createDataFrame(
            [(n, r.rule_id, r.signal, r.pattern) for n, r in enumerate(rows)], f"rule_number int, rule_id {kind}, signal string, rule_pattern string"
        )

    def possible(self, text: Column) -> Column:
        """Numbers of the rules that may match."""
        return self._possible(text)

    def tag(self, rows: DataFrame, text: str, *keys: str) -> DataFrame:
        """``(keys, rule_id, signal)``: one row per row of ``rows`` and rule that matches its text."""
        candidates = rows.select(*keys, F.col(text).alias("tested"), F.explode(self.possible(F.col(text))).alias("rule_number"))
        joined = candidates.join(self.rules, "rule_number")
        return joined.filter(F.expr("tested RLIKE rule_pattern")).select(*keys, "rule_id", "signal")


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mixed(rolled: np.ndarray, width: int, gate: bool = False) -> np.ndarray:
    mixed = (rolled ^ (rolled >> np.uint64(31)) ^ np.uint64(width + 64 * gate)) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _rolled(before: np.ndarray, points: np.ndarray) -> np.ndarray:
    return before * _BASE + points + np.uint64(1)


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(i * 17)) & np.uint64((1 << bits) - 1) for i in range(PROBES)]


def _once(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of an owner once, in order."""
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    return owners[first], hashes[first]


def _lists(owners: np.ndarray, hashes: np.ndarray, count: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=count))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))


_HASHES = T.ArrayType(T.LongType())


@F.arrow_udf(T.StructType([T.StructField("literals", _HASHES), T.StructField("gates", _HASHES), T.StructField("widths", T.IntegerType())]))
def _literal_hashes(patterns: pa.Array) -> pa.Array:
    """Hashes of the literals one of which every match of a pattern holds (of their first ``WIDEST`` characters), none where that cannot be
    told; hashes of how these begin at ``GATES``; a bit for the width of each."""
    heads = [{literal[:WIDEST] for literal in required_literals(pattern)} for pattern in patterns.to_pylist()]
    owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    flat = [head for h in heads for head in h]
    lengths = np.array([len(head) for head in flat], np.int64)
    points = np.zeros((len(flat), WIDEST), np.uint64)
    points[np.arange(WIDEST) < lengths[:, None]] = _points("".join(flat))
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole, begun, rolled = [none], [none], np.zeros(len(flat), np.uint64)
    for width in range(1, WIDEST + 1):
        rolled = _rolled(rolled, points[:, width - 1])
        whole.append((owner[lengths == width], _mixed(rolled, width)[lengths == width]))
        if width in GATES:
            begun.append((owner[lengths > width], _mixed(rolled, width, True)[lengths > width]))
    lists = [_lists(*_once(*map(np.concatenate, zip(*made, strict=True))), len(heads)) for made in (whole, begun)]
    widths = [sum({1 << len(head) for head in h}) for h in heads]
    return pa.StructArray.from_arrays([*lists, pa.array(widths, pa.int32())], ["literals", "gates", "widths"])


_BETWEEN = np.array([0x110000], np.uint64)  # no character


def _held(hashes: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bit table may hold a hash, and these hashes."""
    at = np.arange(len(hashes))
    for probe in range(PROBES):
        spot = _probes(hashes, bits)[probe]
        stays = (table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, hashes = at[stays], hashes[stays]
    return at, hashes


def _parts_held(texts: list[str | None], table: np.ndarray, bits: int, widths: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and hashes of their parts, as wide as a bit of ``widths`` says, that the bit table may hold, each once, in order."""
    made = [_points(fold(t)) if t else np.zeros(0, np.uint64) for t in texts]
    owner = np.repeat(np.arange(len(made)), [len(m) + 1 for m in made])
    points = np.concatenate([np.zeros(0, np.uint64), *[x for m in made for x in (m, _BETWEEN)]])
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    places, rolled = np.arange(len(points)), np.zeros(len(points), np.uint64)
    for width in range(1, widths.bit_length()):
        within = np.searchsorted(places, len(points) - width, "right")
        places = places[:within]
        rolled = _rolled(rolled[:within], points[places + (width - 1)])
        if widths >> width & 1:
            at, hashes = _held(_mixed(rolled, width), table, bits)
            owners.append(owner[places[at]])
            found.append(hashes)
        if width in GATES:
            # Whatever is wider begins with what the table holds of this width.
            at, _ = _held(_mixed(rolled, width, True), table, bits)
            places, rolled = places[at], rolled[at]
    return _once(np.concatenate(owners), np.concatenate(found))


def _literals_in(shared, bits: int, widths: int):
    """Hashes of the parts of a text that may be literals."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    @tidy
    def found(texts: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.uint8)
        owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first in range(0, len(texts), 1024):
            numbers, held = _parts_held(texts[first : first + 1024].to_pylist(), table, bits, widths)
            owners.append(numbers + first)
            hashes.append(held)
        return _lists(np.concatenate(owners), np.concatenate(hashes), len(texts))

    return found


def tag_by_join(rules: DataFrame, rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """What ``Lexicon(rules).tag(rows, text, keys)`` gives, for a lexicon of any size: nothing but a bit table of at most 32 MB is sent to every executor."""
    spark = rules.sparkSession
    every = rules.filter("pattern IS NOT NULL").select("rule_id", "signal", F.col("pattern").alias("rule_pattern")).distinct()
    # Patterns are short but slow to read: as many tasks as a shuffle has, whatever their bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = materialize(every.repartition(parts).withColumn("read", _literal_hashes("rule_pattern")).select("*", "read.*").drop("read"), "lexicon")
    held = every.select(F.explode(F.concat("literals", "gates")).alias("met")).distinct()
    widths = every.agg(F.coalesce(F.bit_or("widths"), F.lit(0)).alias("widths")).first().widths
    bits = min(MOST_BITS, max(16, (BITS_EACH * held.count()).bit_length()))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def spots(hashes: pa.Array) -> pa.Array:
        at = np.stack(_probes(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits), axis=1).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, PROBES, dtype=np.int32)), pa.array(at.ravel()))

    # Buckets are numbered from 1 and their bits from 0.
    spot = held.select(F.explode(spots("met")).alias("spot")).select((F.col("spot") + 1).alias("spot"))
    bucket = F.bitmap_bucket_number("spot")
    table = bytearray((1 << bits) // 8)
    for row in spot.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap")).toLocalIterator():
        start = (row.bucket - 1) * len(row.bitmap)
        table[start : start + len(row.bitmap)] = row.bitmap[: len(table) - start]
    found = _literals_in(spark.sparkContext.broadcast(bytes(table)), bits, widths)

    tested = rows.select(*keys, F.col(text).alias("tested")).filter("tested IS NOT NULL")
    met = tested.select("*", found("tested").alias("found")).filter(F.size("found") > 0).select("*", F.explode("found").alias("met"))
    by_literal = every.select("rule_id", "signal", "rule_pattern", "literals", F.explode("literals").alias("met"))
    # Of several literals of a rule, only the first that is in the text counts.
    first = F.element_at(F.array_intersect("literals", "found"), 1)
    joined = met.join(by_literal.hint("merge"), "met").filter((first == F.col("met")) & F.expr("tested RLIKE rule_pattern"))
    found_by_literal = joined.select(*keys, "rule_id", "signal")
    if not every.filter(F.size("literals") == 0).head(1):
        return found_by_literal
    # A file of their own: the planner sees its size, and texts are not read and split again for each file of the lexicon.
    always = materialize(every.filter(F.size("literals") == 0).select("rule_id", "signal", "rule_pattern").repartition(1), "lexicon-rest")
    tried = tested.join(always, F.expr("tested RLIKE rule_pattern"))
    return found_by_literal.union(tried.select(*keys, "rule_id", "signal"))


def tag_all(rules: DataFrame, rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(keys, rule_id, signal)`` of a lexicon of any size: by the automaton where it is small, else by joins."""
    if pattern_bytes(rules) <= SMALL:
        return Lexicon(rules).tag(rows, text, *keys)
    return tag_by_join(rules, rows, text, *keys)


def signals_of(tagged: DataFrame, *keys: str) -> DataFrame:
    """``(keys, signals)``: the distinct signals of what ``tag`` found, sorted. One entry a signal, which a lexicon has few of."""
    return tagged.groupBy(*keys).agg(F.array_sort(F.collect_set("signal")).alias("signals"))
