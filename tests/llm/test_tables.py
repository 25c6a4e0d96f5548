"""Mixing, sharding, URL filters and license scans."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clauseloom.llm import licenses, mixing, queries, sharding, urls
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == []


# --- mixing ---


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; what is above a cap is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


def test_mix_reaches_the_targets(documents):
    source = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    rows = mixing.mix_counts(documents).collect()
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    expected = plain_targets(sizes)
    for r in rows:
        assert abs(r.target - expected[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - expected[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_counts(documents).collect()))


def test_documents_appear_as_often_as_counted(documents):
    counted = {r.doc_id: r.taken // r.size for r in mixing.mix_counts(documents).collect() if r.size and r.taken}
    mixed = mixing.mix_documents(documents).filter(mixing.size_in_words(F.col("text")) > 0)
    assert mixed.columns == documents.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == counted


def test_inclusion_follows_the_odds(spark):
    """Of one source at three quarters, documents with nine times the odds are left out far less often."""
    rows = spark.range(4000).select(
        "id", F.lit("w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 4 < 2, 9.0).otherwise(1.0).alias("odds"),
    )
    got = mixing.mix_counts(rows, weights=(1,), share=0.75, doc_id="id", odds="odds").collect()
    rich, poor = [sum(r.taken for r in got if (r.doc_id % 4 < 2) == want) for want in (True, False)]
    assert rich + poor == 3000 and rich > 1.2 * poor


def test_odd_mix(odd, empty):
    rows = mixing.mix_counts(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4, 8)} == {0}
    assert len({r.taken for r in rows if r.doc_id == 2}) == 1
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# --- sharding ---


def test_shards_are_even_and_numbered(spark, sf_dir, documents):
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    rows = queries.op10_sharding(spark, sf_dir).collect()
    load, numbers = Counter(), defaultdict(list)
    for r in rows:
        data = texts.pop(r.doc_id).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
        numbers[r.shard].append(r.slot)
    assert not texts and set(load) == set(range(16))
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)


def test_a_new_shard_takes_slots_only_into_itself(spark, tmp_path):
    loads = spark.range(512).select(F.col("id").cast("int").alias("virtual_slot"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("bytes"))
    path = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(loads, 4), path, 1)
    sharding.save_map(sharding.add_shard(sharding.load_map(spark, path, 1), 4), path, 2)
    with pytest.raises(AnalysisException):
        sharding.save_map(sharding.first_map(loads, 4), path, 1)
    assert sharding.last_version(spark, path) == 2 and sharding.last_version(spark, path + "-none") == 0
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r for r in sharding.load_map(spark, path, 2).collect()}
    assert old.keys() == new.keys() == set(range(512))
    assert all(r.shard in (4, old[slot]) for slot, r in new.items())
    load = Counter()
    for r in new.values():
        load[r.shard] += r.bytes
    assert max(load.values()) - min(load.values()) < 6000 and set(load) == set(range(5))


def test_one_large_slot_moves_alone(spark):
    loads = spark.range(40).selectExpr("cast(id as int) as virtual_slot", "if(id = 0, 100000, 10) as bytes").withColumn("bytes", F.col("bytes").cast("long"))
    first = sharding.first_map(loads, 4)
    grown = {r.virtual_slot: r.shard for r in sharding.add_shard(first, 4).collect()}
    assert {s for s, shard in grown.items() if shard == 4} == {0}
    even = {r.virtual_slot: r.shard for r in sharding.rebalance(first, loads, 4).collect()}
    assert even[0] == 0 and Counter(even.values()) == Counter({0: 1, 1: 13, 2: 13, 3: 13})


def test_a_stored_map_is_edited(spark, documents, tmp_path):
    path, docs = str(tmp_path / "map"), documents.limit(150).cache()
    runs = [sorted(map(tuple, sharding.shard_documents(docs, shards=4, map_path=path).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 150
    version = sharding.last_version(spark, path)
    before = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, version).collect()}
    more = docs.union(docs.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = sharding.shard_documents(more, shards=4, map_path=path).collect()
    after = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, version + 1).collect()}
    assert len(rows) == more.count() and all(after[r.virtual_slot] == r.shard for r in rows)
    assert 0 < sum(after[s] != before[s] for s in before) < len(before) / 4


def test_equal_rows_spread(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, repeat('hot text ', 20), concat('text ', id, repeat(' w', cast(id % 40 as int)))) as text")
    got = sharding.shard_documents(rows, shards=16).collect()
    load, hot = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        hot[r.shard] += r.doc_id == 7
    assert len(got) == 3000 and max(load.values()) - min(load.values()) < 200 and min(hot.values()) > 20
    for shard in load:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_odd_shards(odd, empty):
    rows = sharding.shard_documents(odd, shards=3).collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}
    for shard in {r.shard for r in rows}:
        numbers = sorted(r.slot for r in rows if r.shard == shard)
        assert numbers == list(range(len(numbers)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_runs_no_python(odd):
    plan = sharding.shard_documents(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- URL filters ---


def judged(spark, captures, events):
    days = "cast(day as date) as day"
    entries = urls.intervals(spark.createDataFrame(events, "list string, kind string, pattern string, action string, day string").selectExpr("list", "kind", "pattern", "action", days))
    rows = spark.createDataFrame(captures, "id int, url string, day string, verdict string").selectExpr("id", "url", days, "verdict")
    return {r.id: (r.lists, r.verdict) for r in urls.judge(rows, entries).collect()}


def test_entries_count_while_they_are_active(spark):
    events = [
        ("ads", "domain", "example.com", "add", "2020-01-10"), ("ads", "domain", "example.com", "remove", "2020-02-10"),
        ("ads", "domain", "example.com", "add", "2020-03-10"), ("adult", "prefix", "b.org/x", "add", "2020-01-01"),
        ("adult", "prefix", "b.org/x", "add", "2020-01-05"), ("allow", "prefix", "www.example.com/ok", "add", "2020-01-01"),
        ("ads", "domain", "same.day", "add", "2020-01-01"), ("ads", "domain", "same.day", "remove", "2020-01-01"),
        ("ads", "domain", "gone.net", "remove", "2020-01-01"), ("ads", "domain", "none.net", "add", None),
    ]
    captures = [
        (1, "http://www.Example.com/a", "2020-01-09", "old"), (2, "http://www.example.com/a", "2020-01-10", "old"),
        (3, "http://www.example.com/a", "2020-02-10", "old"), (4, "http://example.com", "2021-01-01", "old"),
        (5, "http://www.example.com/ok/page", "2020-01-20", "old"), (6, "https://b.org/x?q=1", "2020-01-06", "old"),
        (7, "https://b.org/xy", "2020-01-06", "old"), (8, None, "2020-01-06", "old"), (9, "no url", "2020-01-06", "old"),
        (10, "http://example.com/", None, "old"), (11, "http://same.day/", "2020-01-02", "old"),
        (12, "http://gone.net/", "2020-01-02", "old"), (13, "http://notexample.com/", "2020-01-20", "old"), (2, "http://www.example.com/a", "2020-01-10", "old"),
    ]
    got = judged(spark, captures, events)
    assert {k for k, (_, v) in got.items() if v == "block"} == {2, 4, 6}
    assert got[5] == (["ads", "allow"], "allow") and got[6] == (["adult"], "block") and len(got) == 13
    hosts = ["http://example.com:8080/a", "http://user@example.com/a", "http://u:p@www.example.com:80?q", "http://example.com./a", "HTTPS://EXAMPLE.com.:443"]
    assert {v for _, v in judged(spark, [(i, u, "2020-01-20", "old") for i, u in enumerate(hosts)], events).values()} == {"block"}
    others = ["http://example.com@other.net/", "//example.com/a", "example.com/a", "http://[::1]:80/", "http://:80/", "http://example.com:x/"]
    assert {v for _, v in judged(spark, [(i, u, "2020-01-20", "old") for i, u in enumerate(others)], events).values()} == {"allow"}
    assert judged(spark, captures[:0] or [(1, None, None, None)], events) == {1: ([], "allow")}
    assert judged(spark, captures[:2], events[:0] or [("x", "domain", "y.z", "add", None)])[2] == ([], "allow")


# --- licenses ---


def test_rules_over_sentences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nSomething else.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        (1, "Text. Released under the MIT License. More. RELEASED UNDER THE MIT-LICENSE"), (2, bsd), (3, bsd + third), (4, None), (5, ""),
        (6, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (7, "No license here."), (1, "Released under the MIT License."),
    ]
    got = Counter(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([
        (1, "MIT", 2), (2, "BSD-2-Clause", 1), (3, "BSD-3-Clause", 1), (6, "Apache-2.0", 1), (6, "CC-BY-NC-4.0", 1), (1, "MIT", 1),
    ])


def test_odd_licenses(odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
