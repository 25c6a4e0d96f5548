import random
import re
from collections import Counter, defaultdict

import pytest

from clauseloom.llm import divergence
from clauseloom.llm.common import read


def plain(rows, least_docs=3, ranks=200):
    """The report over every group, term and pair, in whole numbers."""
    words = defaultdict(Counter)
    seen, groups = defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        words[lang, source].update(found)
        seen[lang].update(set(found))
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        others = [s for la, s in groups if la == lang]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, counts = shares(words[lang, source]), words[lang, source]
        pairs = []
        for other in others:
            q = shares(words[lang, other])
            pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode(), other))
        whole = Counter()
        for other in others:
            whole.update(words[lang, other])
        q = shares(whole)
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", [x for x in pairs if x[2] != source], None), ("term", terms, ranks)):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def reported(docs, **options):
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


def test_terms():
    text = "One-TWO été\tÉTÉ x1y\x00z [a]{b}`c 漢字 " + "w" * 3_000_000 + " end"
    found = [t.decode() for run in divergence.terms_of(text) for t in run]
    assert found == ["one", "two", "été", "ÉtÉ", "x", "y", "z", "a", "b", "c", "漢字", "w" * 3_000_000, "end"]
    assert list(divergence.terms_of("")) == [] and [x for run in divergence.terms_of("12 3") for x in run] == []


def test_bounded_tables_and_runs_change_nothing(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(200)) for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 20, "source": [str(i % 3) for i in range(20)], "text": texts})

    def counted():
        total = defaultdict(lambda: [0, 0])
        for made in divergence._count(iter([batch])):
            for r in made.to_pylist():
                total[r["lang"], r["source"], r["term"]][0] += r["n"]
                total[r["lang"], r["source"], r["term"]][1] += r["docs"]
        return total

    before = counted()
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "RUN", 7)
    assert counted() == before


@pytest.mark.parametrize("ranks", [200, 4])
def test_against_the_plain_report(spark, ranks):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "é", "x", "Z")]
    rows = [
        (rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "é", "", None)), " ".join(rng.choice(vocabulary[: rng.choice((5, 20, 40))]) for _ in range(rng.randrange(30))))
        for _ in range(120)
    ]
    rows += [("fr", "only", "a b c"), ("it", "s1", None), ("it", "s2", "..."), ("en", "silent", ""), ("en", "s1", "repeated " * 5), ("en", "s1", "repeated " * 5)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert reported(docs, ranks=ranks) == plain(rows, ranks=ranks)


def test_on_the_table(spark, documents):
    rows = [(r.lang, r.source, r.text) for r in documents.select("lang", "source", "text").collect()]
    assert reported(documents) == plain(rows)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, kinds = 3 * 10**12, 10**15 + 7, 10**9
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kinds)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + kinds)


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert reported(odd) == plain(rows)
    assert divergence.audit(empty).count() == 0
    clashing = odd.selectExpr("*", "'q' as rank", "1 as value", "'z' as part", "'t' as term", "2 as n", "3 as y")
    assert reported(clashing) == plain(rows)


def test_query(spark, sf_dir):
    from clauseloom.llm.queries import QUERIES

    assert QUERIES["op12_divergence"](spark, sf_dir).count() == divergence.audit(read(spark, sf_dir, "documents")).count() > 0
