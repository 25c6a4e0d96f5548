import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from clauseloom.llm import bpe, queries

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        return bpe.Vocabulary(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})


@pytest.mark.parametrize("space_leads", [True, False])
def test_texts_against_the_library(vocabulary, library, space_leads):
    rng, letters = random.Random(4), "ab \n\t'st é漢字1٣\x1c\x85 !.,🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, "abc" * 700, "é" * 300, " " * 500, "x" * 256, "xy" * 129]
    ids, counts = bpe.encode_texts(texts, vocabulary, bpe.Memory(), space_leads)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text), repr(text)
        at += n


def test_hashed_pairs(vocabulary):
    some = list(vocabulary.ids.items())[300:5300]
    rows = [(vocabulary.ids[t[:k]], vocabulary.ids[t[k:]], r) for t, r in some for k in range(1, len(t)) if t[:k] in vocabulary.ids and t[k:] in vocabulary.ids]
    left, right, rank = (np.array(x, np.int32) for x in zip(*rows, strict=True))
    assert (vocabulary.pairs.lookup(left, right) == rank).all()
    assert (vocabulary.pairs.lookup(left, np.full_like(right, -1)) == bpe.NO_RANK).all()


def test_query_against_the_library(spark, sf_dir, documents, library):
    got = {r.doc_id: r for r in queries.op6_bpe(spark, sf_dir).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        row = got.pop(r.doc_id)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got


def test_odd_rows(spark, odd, empty):
    codec = queries.codec(spark)
    both = bpe.decode_documents(bpe.encode_documents(odd, codec), codec)
    rows = both.select("text", "ids", F.col("decoded").cast("string").alias("back"), "score", "size").collect()
    assert len(rows) == odd.count()
    assert all((r.text or "") == r.back for r in rows) and all(r.ids == [] for r in rows if not r.text)
    assert bpe.encode_documents(empty, codec).count() == 0
