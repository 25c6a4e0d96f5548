import numpy as np
import pytest
import xxhash

from clauseloom.llm import simhash
from clauseloom.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """{position: smallest id reachable} over all pairs of fingerprints."""
    prints = [fp for _, fp in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_query_against_all_pairs(documents):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.select("doc_id", "text").collect()]
    expected = {d: (f"{fp:016x}", c) for (d, fp), c in zip(rows, plain_classes(rows), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == expected


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    prints = sorted({0, -1, *base, *near})
    unsigned = [p % 2**64 for p in prints]
    expected = {
        (prints[i], prints[j]) for i in range(len(prints)) for j in range(i + 1, len(prints))
        if (unsigned[i] ^ unsigned[j]).bit_count() <= 3
    }
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert len(found) == len(expected) and {(r.u, r.v) for r in found} == expected


def test_every_close_pair_shares_a_group():
    groups = simhash.key_groups(3)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        changed = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not changed & set(g) for g in groups)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), "test").collect())
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1100)}


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, None, 8} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).collect() == []


def test_one_row_of_each_class_stays(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 7), (True, 0)]
    assert simhash.drop_near_duplicates(empty).count() == 0
    again = odd.filter("doc_id = 2")
    assert simhash.drop_near_duplicates(again).count() == 1


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "A  b\tC d", "é É x", "w " * 5000])
def test_text_fingerprint(text):
    assert simhash.text_fingerprint(text) % 2**64 == plain_fingerprint(text)
