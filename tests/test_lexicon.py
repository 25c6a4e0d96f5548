import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions import signals
from clauseloom.operators import lexicon

RULES = "rule_id int, signal string, pattern string"


@pytest.mark.parametrize(("pattern", "literals"), [
    ("must|shall", {"must", "shall"}), ("(?i)MUST (be )?signed", {"must "}), ("a+bc*", {"a"}), (r"\d+ points?", {" point"}), ("x|y*", set()), (r"\p{L}+", set()),
    (r"(?<![\p{L}])licen[cs]e", {"licen"}), (r"分\x{5206}", {"分分"}), ("(ab){2,}|cde", {"ab", "cde"}), ("(ab)?", set()), ("(?!no)way", {"way"}), ("[ab]", set()), ("[K]elvin", {"kelvin"}),
    ("broken(", set()), ("", set()), ("(?>atom)ic", {"atom"}), ("a{0,3}tail", {"tail"}),
])
def test_literals(pattern, literals):
    found = lexicon.required_literals(pattern)
    assert found == literals or (pattern == "(?i)MUST (be )?signed" and found == {"signed"})


def tagged(spark, rules, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    made = lexicon.Lexicon(spark.createDataFrame(rules, RULES))
    return sorted(((r.k, r.rule_id, r.signal) for r in made.tag(rows, "text", "k").collect()), key=str)


def tried(spark, rules, texts):
    """Every pattern on every text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    both = rows.crossJoin(spark.createDataFrame(rules, RULES)).filter(F.expr("text RLIKE pattern"))
    return sorted(((r.k, r.rule_id, r.signal) for r in both.select("k", "rule_id", "signal").distinct().collect()), key=str)


def test_equal_to_trying_all(spark):
    rng = random.Random(1)
    words = ["must", "shall", "deliver", "bolt", "gear", "price", "分", "必须", "ſhall", "İs", "straße", "K", "v1.2", "10 points", "ÉTÉ", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(150)] + [None, "", "MUST", "STRASSE ẞ"]
    rules = [(i, rng.choice(("a", "b", None)), p) for i, p in enumerate([
        *(f"(?i){w}" for w in ("must", "SHALL", "gear|bolt", "straße")), "(?iu)shall", "(?iu)is", "(?iu)k", "(?iu)été", "[0-9]+ points", "(?<!无)须", "^$", "[a-z]{7}", "", "price$", r"\bgear\b",
        "(?iu)" + fv.HARD_ENGLISH, fv.HARD_CHINESE, fv.CHINESE_SCORE,
    ])]
    rules += [(99, "n", None), (0, "again", "must")]
    assert tagged(spark, rules, texts) == tried(spark, [r for r in rules if r[2] is not None], texts)


def test_built_in_rules_by_table(spark):
    texts = ["The supplier MUST encrypt.", "供应商须提供证明。", "最高得10分。", "nothing", "worth 5 points"]
    rules = [(i, r.signal, r.pattern) for i, r in enumerate(signals.BUILT_IN_RULES)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = {(r.k, s) for r in lexicon.signals_of(lexicon.Lexicon(spark.createDataFrame(rules, RULES)).tag(rows, "text", "k"), "k").collect() for s in r.signals}
    flags = rows.select("k", *[f.alias(n) for n, f in signals.rule_flags(F.col("text"), signals.BUILT_IN_RULES).items()]).collect()
    assert found == {(r.k, s) for r in flags for s in ("hard", "score") if r[s]}


def test_empty_and_too_large(spark, monkeypatch):
    assert tagged(spark, [(1, "a", None)], ["text"]) == [] and tagged(spark, [(1, "a", "x")], []) == []
    monkeypatch.setattr(lexicon, "LARGEST", 3)
    with pytest.raises(ValueError, match="at most 3"):
        tagged(spark, [(1, "a", "long")], ["text"])


def test_ten_thousand_rules_cost_little_more_than_three(spark):
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(40_000)}" for _ in range(12)) for _ in range(40_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4).cache()
    rows.count()

    def seconds(count):
        made = lexicon.Lexicon(spark.createDataFrame([(i, "s", rf"\bword{i * 3}\b") for i in range(count)], RULES))
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            made.tag(rows, "text", "k").write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    few = seconds(3)
    assert seconds(10_000) < 3 * few + 1


def test_a_large_lexicon_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    words = ["must", "SHALL", "bolt", "分", "必须", "😀 gear", "ſhall", "straße", "Item 12", "item 1234 of the long list", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(1500)] + [None, "", "MUST", "must"]
    patterns = ["(?i)must|shall|bolt", "(?iu)shall", "bolt|gear", "(?i)(^|[^a-z0-9])(item|bolt) 12($|[^0-9])", "(?i)item 1234 of the long", "[0-9][0-9]", "^$", "必须|分", "😀", "(?iu)straße", "bolt$", "absent"]
    rules = [(i, ("a", "b", None)[i % 3], p) for i, p in enumerate(patterns)] + [(0, "again", "must"), (0, "a", "(?i)must|shall|bolt"), (99, "n", None)]
    rows, table = spark.createDataFrame(list(enumerate(texts)), "k int, text string"), spark.createDataFrame(rules, RULES)
    expected = tried(spark, [r for r in rules if r[2] is not None], texts)

    def found(made):
        return sorted(((r.k, r.rule_id, r.signal) for r in made.collect()), key=str)

    assert found(lexicon.tag_by_join(table, rows, "text", "k")) == expected
    assert found(lexicon.tag_all(table, rows, "text", "k")) == expected
    # Beyond what an automaton is made of, nothing is refused; the empty table tags nothing.
    monkeypatch.setattr(lexicon, "LARGEST", 3)
    monkeypatch.setattr(lexicon, "SMALL", 3)
    assert found(lexicon.tag_all(table, rows, "text", "k")) == expected
    assert lexicon.tag_by_join(table.limit(0), rows, "text", "k").count() == 0
    assert lexicon.tag_by_join(table, rows.limit(0), "text", "k").count() == 0


def test_rules_of_a_shape_have_their_own_literals():
    patterns = [f"(?i)(^|[^a-z0-9])(supplier|bidder|item) {n}($|[^a-z0-9])" for n in (7, 12, 345, 1234567)]
    patterns += ["x Ab ÉÉ (q|rs)", r"a \d Bc Dé$", r"\ 12", "a 12*", "a 12?", "[ 12 ]", "a { 2 }", "(?x)ab 12 # 34 \n c", r"\N{LATIN SMALL LETTER A}b 12", "é 12 \U000f0000"]
    for pattern in patterns:
        assert lexicon.required_literals(pattern) == lexicon._shape_literals(pattern)
    before = lexicon._shape_literals.cache_info().misses
    assert [lexicon.required_literals(f"(supplier|bidder) {n}($|x)") for n in range(1000, 1900)] == [{f" {n}"} for n in range(1000, 1900)]
    assert lexicon._shape_literals.cache_info().misses <= before + 1


def test_rules_are_not_looked_up_by_the_words_they_share():
    assert lexicon.required_literals("(supplier|bidder|item) 7($|[^0-9])") == {" 7"}


def test_places_without_the_beginning_of_a_literal_are_given_up(spark):
    literals = lexicon._literal_hashes.func(pa.array(["deliver", "shallow water", "x", "must", "[0-9]"]))
    assert literals.field("widths").to_pylist() == [1 << 7, 1 << 13, 1 << 1, 1 << 4, 0]
    assert [len(g) for g in literals.field("gates").to_pylist()] == [1, 2, 0, 0, 0]
    hashes = np.array([h for f in ("literals", "gates") for made in literals.field(f).to_pylist() for h in made], np.int64).view(np.uint64)
    table = np.zeros(1 << 13, np.uint8)
    for spots in lexicon._probes(hashes, 16):
        np.bitwise_or.at(table, spots >> np.uint64(3), (1 << (spots & np.uint64(7))).astype(np.uint8))
    texts = ["They DELIVER; one must, in shallow water", None, "", "delive", "x", "shallow", "mus", "t shallow wate"]
    widths = 1 << 7 | 1 << 13 | 1 << 1 | 1 << 4
    numbers, held = lexicon._parts_held(texts, table, 16, widths)
    own = {int(np.int64(h).view(np.uint64)): i for i, made in enumerate(literals.field("literals").to_pylist()) for h in made}
    assert sorted((int(n), own[int(h)]) for n, h in zip(numbers, held, strict=True) if int(h) in own) == [(0, 0), (0, 1), (0, 3), (4, 2)]


def test_rules_without_a_literal_do_not_read_the_texts_once_a_file(spark, monkeypatch):
    written = []
    keep = lexicon.materialize
    monkeypatch.setattr(lexicon, "materialize", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    table = spark.createDataFrame([(1, "a", "[0-9]"), (2, "b", "bolt"), (3, "a", "^x")], RULES)
    rows = spark.createDataFrame([(1, "7 bolts"), (2, "x")], "k int, text string")
    assert sorted((r.k, r.rule_id) for r in lexicon.tag_by_join(table, rows, "text", "k").collect()) == [(1, 1), (1, 2), (2, 3)]
    assert {label: df.rdd.getNumPartitions() for label, df in written}["lexicon-rest"] == 1
    written.clear()
    lexicon.tag_by_join(table.filter("rule_id = 2"), rows, "text", "k").collect()
    assert [label for label, _ in written] == ["lexicon"]
