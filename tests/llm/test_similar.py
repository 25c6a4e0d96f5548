import random

import pytest

import corpus_pipeline
from clauseloom.llm import similar


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Ids of the documents that stay, over all pairs of texts."""
    made, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(made[i] & made[j]) >= 4 * len(made[i] | made[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def planted():
    """Near copies of one to many changed words, a chain of them, repeated lines, and a line that all texts have."""
    rng = random.Random(4)
    texts = []
    for base in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((6, 12, 40, 150, 600)))]
        texts.append(words)
        for _ in range(6):
            near = list(texts[-1] if base % 3 == 0 else words)
            for _ in range(rng.choice((1, 1, 2, max(1, len(near) // 50), max(1, len(near) // 25)))):
                near[rng.randrange(len(near))] = f"n{rng.randrange(10**6)}"
            texts.append(near)
    lines = [" ".join(t) + ("\nOne line that is in all the longer texts of the corpus" if len(t) > 30 else "") for t in texts]
    lines += ["a line said again " * n for n in (2, 3, 50)] + ["", " ", "four words are here", "Four  words are HERE"]
    rng.shuffle(lines)
    return list(enumerate(lines))


def test_stage_against_all_pairs(spark, sf_dir):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, sf_dir).collect())
    assert kept == plain_kept(rows) and len(kept) < len(rows)


def test_stage_on_the_table(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, documents, sf_dir).collect())
    assert kept == plain_kept(rows)


@pytest.mark.parametrize("n", [*range(1, 40), 999, 1000, 1001])
def test_prefix_length(n):
    # As many shingles as may be missing from the other set, and one more.
    assert similar.prefix_length(n, (4, 5)) == n - next(m for m in range(n + 1) if 5 * m >= 4 * n) + 1


def test_any_order_of_shingles_finds_all(spark, monkeypatch):
    monkeypatch.setattr(similar, "COMMON_LEAST", 3)
    rows = planted()
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_odd_rows(odd, empty):
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 7), (True, 0)]
    assert similar.drop_similar(empty).count() == 0


def near_group(n, words=130, seed=6):
    """Near copies of one text, of one to twelve changed words each: many pairs of them are links, and many are not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        near = list(base)
        for _ in range(rng.randrange(1, 4) if rng.random() < 0.6 else rng.randrange(5, 13)):
            near[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    return list(enumerate(texts))


def test_group_of_near_copies_is_not_tried_pair_by_pair(spark, monkeypatch):
    rows, tried = near_group(300), []
    real = similar.materialize

    def counted(df, label):
        written = real(df, label)
        if label == "similar-pairs":
            tried.append(written.count())
        return written

    monkeypatch.setattr(similar, "materialize", counted)
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert sum(tried) < 10 * len(rows)


def test_pivot_table_pairs_against_all_pairs(spark):
    rows = planted() + [(10**6 + i, t) for i, t in near_group(60, words=600)]
    sims = [(i, similar.fingerprint(similar.shingle_set(t))) for i, t in rows]
    found = similar.pivot_pairs(spark.createDataFrame(sims, "fp long, sim long")).collect()
    near = {i: {j for j, b in sims if j != i and ((a ^ b) % 2**64).bit_count() <= 3} for i, a in sims}
    assert {r.v for r in found} == {v for v, us in near.items() if us and min(us) < v} and len(found) > 40
    assert all(r.u in near[r.v] or dict(sims)[r.u] == dict(sims)[r.v] for r in found)


def test_stage_gets_pairs_from_the_pivot_table(spark, sf_dir, monkeypatch):
    rows, met = near_group(40, words=600), []
    real = similar.simhash.links
    monkeypatch.setattr(similar.simhash, "links", lambda *given: met.append(real(*given)) or met[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert len(met) == 1 and not met[0].isEmpty()


def test_sets_are_made_only_of_texts_that_may_have_a_partner(spark, monkeypatch):
    """Long texts that share a passage of an eighth, which 256 parity bits cannot tell from near copies; two of them have one."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(880)] + passage for _ in range(30)]
    texts += [texts[k][:500] + ["changed"] + texts[k][501:] for k in (3, 7)]
    rows, made = [(i, " ".join(t)) for i, t in enumerate(texts)], []
    real = similar.materialize

    def counted(df, label):
        written = real(df, label)
        if label == "similar-sets":
            made.append(written.count())
        return written

    monkeypatch.setattr(similar, "materialize", counted)
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows) == list(range(30))
    assert made == [4]


def test_shuffles_go_with_their_step(spark, monkeypatch):
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(setting, None)
    real = similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, label: seen.append(spark.conf.get(setting, None)) or real(df, label))
    rows = planted()
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert set(seen) == {"true"} and spark.conf.get(setting, None) == before


@pytest.mark.parametrize("n", [1, 90, 700, 3000])
def test_folded_parity_is_the_shorter_parity(spark, n):
    hashes = similar.shingle_set(" ".join(f"w{i}" for i in range(n + 4)))
    wide = similar.parity_words(hashes, 64 * similar.WIDE).tolist()[: similar.WIDE]
    got = spark.createDataFrame([(n, wide)], "n int, wide array<bigint>").select(*similar.shape(similar.WORDS)).first()
    odd = [0] * 256
    for h in hashes.tolist():
        odd[h % 256] ^= 1
    words = [int("".join(map(str, odd[64 * i : 64 * i + 64])), 2) for i in range(4)]
    assert [x % 2**64 for x in got[1:]] == words
