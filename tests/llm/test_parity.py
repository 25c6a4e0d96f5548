import random

import numpy as np
import pytest

from clauseloom.llm import parity


def plain_set(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(rows):
    """``(doc_id, size, class)`` over all pairs."""
    made, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if made[i] and 100 * len(made[i] & made[j]) >= 90 * len(made[i] | made[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(made[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(docs, **options):
    return sorted((tuple(r) for r in parity.jaccard_classes(docs, **options).collect()), key=str)


def planted(seed=4, sizes=(3, 5, 9, 12, 14, 20, 40, 150, 600)):
    rng = random.Random(seed)
    texts = []
    for base in range(36):
        words = [f"w{rng.randrange(5000)}" for _ in range(sizes[base % len(sizes)])]
        texts.append(words)
        for _ in range(8):
            near = list(texts[-1] if base % 3 == 0 else words)
            for _ in range(rng.choice((1, 1, 2, max(1, len(near) // 60)))):
                spot = rng.randrange(max(1, len(near)))
                near[spot : spot + 1] = rng.choice(([], [f"n{rng.randrange(10**6)}"], [*near[spot : spot + 1], "in"]))
            near = near[: -rng.randrange(1, 4)] if rng.random() < 0.4 and len(near) > 6 else near
            texts.append(near or ["x"])
    lines = [" ".join(t) + ("\nOne line that is in all the longer texts of the corpus" if len(t) > 30 else "") for t in texts]
    lines += ["a line said again " * n for n in (2, 3, 50)] + ["", " ", None, "Two words", "two  WORDS", "Three little words", "word"]
    rng.shuffle(lines)
    return list(enumerate(lines))


def test_shingles(monkeypatch):
    texts = [t for _, t in planted()] + ["Ä ä  x y", "a b a b a b", "ÀB c D"]
    for text in texts:
        assert len(parity.shingle_set(text or "")) == len(plain_set(text))
    before = [parity.shingle_set(t or "") for t in texts]
    monkeypatch.setattr(parity, "RUN", 5)
    monkeypatch.setattr(parity, "REMEMBERED", 3)
    assert all(np.array_equal(a, parity.shingle_set(t or "")) for a, t in zip(before, texts, strict=True))


def test_bands_cover_partners():
    least, parts = parity.size_bands((9, 10))
    band = lambda n: int(np.searchsorted(least, n, side="right")) - 1
    for a in [*range(1, 400), 9999, 10_000, 123_456]:
        most = a * 10 // 9
        assert band(most) - band(a) <= 1
        assert all(19 * d > a + b or d < parts[band(a)] for b in (a, most) for d in range(int(parts[band(a)]) + 3))


@pytest.mark.parametrize("size", [9, 14, 20, 33, 80, 500])
def test_linked_sets_meet(size):
    """Some part is equal, the next one agrees in a half, and the parts after it allow a link."""
    rng = np.random.default_rng(size)
    least, parts = parity.size_bands((9, 10))
    count = int(parts[int(np.searchsorted(least, size, side="right")) - 1])
    for _ in range(300):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64)
        gone = int(rng.integers(0, count))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, count - gone)), dtype=np.uint64) * np.uint64(2)])
        differ = parity.sketch(np.sort(a), count) ^ parity.sketch(np.sort(b), count)
        bits = [int(x).bit_count() for x in differ]
        assert sum(bits) <= len(set(a) ^ set(b)) < count

        def meets(i, bits=bits, differ=differ):
            ring = [bits[(i + k) % count] for k in range(parity.RING + 1)]
            after = int(differ[(i + 1) % count])
            return not bits[i] and all(sum(ring[: k + 1]) <= k for k in range(len(ring))) and (after & 0xFFFFFFFF == 0 or after >> 32 == 0)

        assert any(map(meets, range(count)))


@pytest.mark.parametrize("rounds", [1, 2])
def test_against_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(parity, "ROUNDS", rounds)
    rows = planted(seed=rounds)
    expected = plain_classes(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected
    assert len({c for _, _, c in expected}) < len(rows) - 60


def test_a_group_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        near = list(words)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(near)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain_classes(rows)


def test_on_the_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == plain_classes(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    # Rows without words are classes of their own, a null id is never the class id.
    assert found(odd) == plain_classes(rows)
    clashing = odd.selectExpr("*", "1 as node", "2 as hi", "3 as n", "4 as key", "5 as th", "6 as component_id")
    assert found(clashing) == plain_classes(rows)
    assert parity.jaccard_classes(empty).count() == 0
