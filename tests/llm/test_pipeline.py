import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as api
import corpus_pipeline
from clauseloom.llm import bpe, mixing, pii, quality, queries
from clauseloom.llm.common import read
from tests.llm.test_similar import plain_kept


def test_stages_against_their_plain_results(spark, sf_dir):
    docs, columns = read(spark, sf_dir, "documents").cache(), read(spark, sf_dir, "documents").columns
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    scores = quality.quality_scores(docs, read(spark, sf_dir, "labels")).collect()
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.predicted == 1}

    single = corpus_pipeline.near_duplicates_stage(spark, good, sf_dir).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == plain_kept([(r.doc_id, r.text) for r in good.collect()])

    masked = corpus_pipeline.personal_data_stage(spark, single, sf_dir).cache()
    assert masked.columns == columns
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        text, out, done = before[r.doc_id], "", 0
        for start, end, kind in pii.base_spans(text):
            if start >= done:
                out += text[done:start] + f"<{kind}>"
            done = max(done, end)
        assert r.text == out + text[done:] and r.n_chars == len(r.text)

    mixed = corpus_pipeline.mixing_stage(spark, masked, sf_dir).cache()
    assert mixed.columns == columns
    counts = {r.doc_id: r.taken // r.size for r in mixing.mix_counts(masked).collect() if r.size and r.taken}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == counts

    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        ids = bpe.Vocabulary(file.read(), public_tokenizers.PATTERN).ids
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
    texts = {r.doc_id: r.text for r in masked.collect()}
    encoded = corpus_pipeline.encoding_stage(spark, mixed, sf_dir).collect()
    assert len(encoded) == mixed.count()
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in encoded)


def test_run_chains_the_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "source", "ids", "n_tokens"] and rows.count() > 0


def test_odd_documents_go_through(spark, odd, sf_dir):
    documents = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        documents = stage(spark, documents, sf_dir)
        assert documents.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, documents, sf_dir).count() == documents.count()
    nothing = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).filter(F.lit(True)).count() == 0


def test_every_operator_is_registered():
    names = api.queries()
    assert {m[0] for n in names if (m := re.match(r"op\d+_", n))} == {f"op{n}_" for n in range(1, 14)}
    assert "pipeline" in names and set(api.oracle_sql()) <= set(names)
