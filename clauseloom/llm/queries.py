"""One query per operator over its whole table, and the SQL that tells the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import ann, bpe, divergence, licenses, mixing, parity, pii, quality, repair, sharding, simhash, topk, urls
from clauseloom.llm.common import bounded_batches, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def codec(spark: SparkSession) -> bpe.Codec:
    # The pattern attaches a space to what follows and takes a lone line break by itself.
    return bpe.Codec(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, space_leads=True)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=3, shingle=3)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(read(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


#: Fetch days and list events come from hashes of the pages' own URLs: the tables have neither. The text is the same for
#: Spark and for the oracle but for two functions: a whole number from hexadecimal digits, and a day.
_SPARK = ("CAST(conv({}, 16, 10) AS BIGINT)", "date_add(DATE '2020-01-01', CAST({} AS INT))")
_DUCKDB = ("CAST(concat('0x', {}) AS BIGINT)", "(DATE '2020-01-01' + CAST({} AS INTEGER))")


def _captures(dialect: tuple[str, str], pages: str) -> str:
    number, day = (form.format for form in dialect)
    return f"SELECT page_id, url, {day(number('substr(md5(url), 1, 6)') + ' % 1000')} AS day FROM {pages}"


def _events(dialect: tuple[str, str], pages: str) -> str:
    number, day = (form.format for form in dialect)
    parts = ", ".join(f"{number(f'substr(h, {4 * i + 1}, 4)')} AS {name}" for i, name in enumerate("abc"))
    return f"""
    WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
                          regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS segment FROM {pages}),
    named AS (SELECT DISTINCT 'ads' AS list, 'domain' AS kind, host AS pattern FROM hosts
              UNION SELECT 'malware', 'domain', regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) FROM hosts
              UNION SELECT 'adult', 'prefix', concat(host, '/', segment) FROM hosts
              UNION SELECT 'allow', 'prefix', concat(host, '/', segment) FROM hosts),
    hashed AS (SELECT list, kind, pattern, md5(concat(list, ':', pattern)) AS h FROM named WHERE pattern <> ''),
    dated AS (SELECT *, {parts} FROM hashed)
    SELECT list, kind, pattern, 'add' AS action, {day('a % 700')} AS day FROM dated WHERE c % 3 <> 0
    UNION ALL SELECT list, kind, pattern, 'remove', {day('a % 700 + b % 300')} FROM dated WHERE c % 3 <> 0 AND b % 4 <> 0
    UNION ALL SELECT list, kind, pattern, 'add', {day('a % 700 + b % 300 + c % 200')} FROM dated WHERE c % 3 = 1"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures, events = spark.sql(_captures(_SPARK, "{pages}"), pages=pages), spark.sql(_events(_SPARK, "{pages}"), pages=pages)
    judged = urls.judge(captures, urls.intervals(events))
    return judged.select(
        "page_id", "url", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join("lists", ",").alias("lists"), "verdict"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = codec(spark)
    encoded = bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), own).select("doc_id", "ids")
    return bpe.decode_documents(encoded, own).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Longer documents have up to three times the inclusion odds of the shortest.
    odds = F.least(mixing.size_in_words(F.col("text")), F.lit(1000)) / F.lit(500.0) + 1
    documents = read(spark, sf_dir, "documents").withColumn("inclusion_odds", odds)
    return mixing.mix_counts(documents, weights=(5, 2, 1), share=1.5, cap=2, odds="inclusion_odds")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_classes(read(spark, sf_dir, "documents"), ratio=(9, 10), shingle=3)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least_docs=3, ranks=200)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_digests(*repair.repair(read(spark, sf_dir, "conversations")))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _bounded(f) for f in (
        op1_simhash, op2_pii, op3_quality, op4_nearest, op5_url_filter, op6_bpe, op7_licenses, op8_maxscore, op9_mixing,
        op10_sharding, op11_jaccard, op12_divergence, op13_repair,
    )
}

# --- the same in DuckDB's SQL -----------------------------------------------------------------------


_URL_SQL = f"""
WITH captures AS ({_captures(_DUCKDB, 'pages')}),
events AS ({_events(_DUCKDB, 'pages')}),
steps AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day, action) AS until FROM events),
entries AS (SELECT list, kind, pattern, day AS since, until FROM steps WHERE action = 'add' AND (until IS NULL OR until > day)),
parts AS (SELECT DISTINCT url, day, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')) AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM captures),
cut AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS segments FROM parts WHERE host <> ''),
keyed AS (SELECT url, day, 'domain' AS kind, unnest(list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.'))) AS pattern FROM cut
          UNION SELECT url, day, 'prefix', unnest(list_transform(range(1, len(segments) + 1), lambda n: concat(host, array_to_string(segments[1:n], '/')))) FROM cut),
hits AS (SELECT url, day, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed FROM keyed JOIN entries USING (kind, pattern)
         WHERE day >= since AND (until IS NULL OR day < until) GROUP BY url, day)
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS day, coalesce(h.lists, '') AS lists,
       CASE WHEN h.lists IS NOT NULL AND NOT h.allowed THEN 'block' ELSE 'allow' END AS verdict
FROM captures c LEFT JOIN hits h ON c.url = h.url AND c.day = h.day"""

_KNOWN = ", ".join(f"'{s}'" for s in licenses.ALL_SENTENCES.values())
_NUMBERED = ", ".join(f"'{licenses.rule_key((key,))}'" for key in licenses.ALL_SENTENCES)
_NAMES = " ".join(f"WHEN '{licenses.rule_key(r)}' THEN '{n}'" for r, n in licenses.ALL_RULES.items())
_SPDX = " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in licenses.spdx_names().items())
_PLAIN = "lower(text)"
for _pattern, _by in licenses.STEPS:
    _escaped = _pattern.replace("'", "''")
    _by = "chr(10)" if _by == "\n" else f"'{_by}'"
    _PLAIN = f"regexp_replace({_PLAIN}, '{_escaped}', {_by}, 'g')"
#: Without looking around: every separator is doubled, and a sentence takes one on either side.
_LICENSE_SQL = f"""
WITH plain AS (SELECT row_number() OVER () AS k, doc_id, text, regexp_replace('|' || trim({_PLAIN}) || '|', '([|/])', '\\1\\1', 'g') AS s FROM documents),
sentences AS (SELECT k, doc_id, text, regexp_extract_all(s, '[|/]({licenses.sentence_pattern('(?: |//)')})[|/]', 1) AS known FROM plain),
numbers AS (SELECT k, doc_id, text, array_to_string(list_transform(known, lambda x: list_extract([{_NUMBERED}], list_position([{_KNOWN}], replace(x, '//', ' ')))), '') AS seq FROM sentences),
tokens AS (SELECT k, doc_id, unnest(list_transform(flatten(list_transform(regexp_extract_all(lower(text), '{licenses.SPDX_LINE}', 1), lambda line: regexp_extract_all(line, '{licenses.SPDX_TOKEN}'))),
                                                   lambda t: string_split_regex(t, ' +with +'))) AS t FROM plain),
named AS (SELECT k, doc_id, CASE t[1] {_SPDX} END || CASE WHEN len(t) > 1 THEN ' WITH ' || t[2] ELSE '' END AS license FROM tokens),
rules AS (SELECT k, doc_id, unnest(regexp_extract_all(seq, '{licenses.rule_pattern()}')) AS rule FROM numbers),
found AS (SELECT k, doc_id, CASE rule {_NAMES} END AS license FROM rules UNION ALL SELECT k, doc_id, license FROM named WHERE license IS NOT NULL)
SELECT doc_id, license, count(*) AS matches FROM found GROUP BY k, doc_id, license"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TOP_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE {_USABLE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

_MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  (CAST(('0x' || substr(md5(concat_ws('|', '1', CAST(doc_id AS VARCHAR), md5(text))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM n),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, most / weight) FILTER (WHERE most / weight > level) AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN most / weight > level THEN weight * common ELSE CAST(most AS DOUBLE) END AS target FROM l, c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part FROM t),
r AS (SELECT d.doc_id, d.size, p.*, d.u, (d.u / (1 - d.u) / (part / (1 - part) * (least(d.size, 1000) / 500.0::DOUBLE + 1))) AS q FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, CASE WHEN part > 0 THEN q / (1 + q) ELSE 1.0 END AS place, target - copies * source_size AS rest FROM r),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through, sum(size) OVER (PARTITION BY source, place, u) AS own FROM o)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST((copies + CASE WHEN part > 0 AND (through <= rest OR (through - own < rest AND through - rest < rest - through + own)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x"""

_AUDIT_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
occurring AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT k, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS y FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, sum(y) AS ny, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS x FROM words GROUP BY ALL),
grid AS (SELECT o.lang, o.source, k.term, k.y, coalesce(w.x, 0) AS x FROM occurring o JOIN kept k ON o.lang = k.lang
         LEFT JOIN own w ON w.lang = o.lang AND w.source = o.source AND w.term = k.term),
sized AS (SELECT *, sum(x) OVER (PARTITION BY lang, source) AS n FROM grid),
shares AS (SELECT lang, source, term, x, 1 + 1000000000 * (x + 1) // (n + v) AS p, 1 + 1000000000 * (y + 1) // (ny + v) AS q FROM sized JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE x > 0 AND p > q),
parts AS (SELECT 'pair' AS part, * FROM every UNION ALL SELECT 'term', * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: CRC-32 of ASCII digits, a colon and spaces; then a fold over the rows from the last, with cost and edits from the four states.
_REPAIR_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                               lambda a, b: xor(t[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8), 4294967295), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                    lag(substr(role, 1, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
             WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
togo AS (SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS s0, {'c': 6, 'a': 'II'} AS s1, {'c': 3, 'a': 'I'} AS s2, {'c': 0, 'a': ''} AS s3 FROM judged
         UNION ALL
         SELECT conv_id, i, list_sort([d0, {'c': u.c + 3, 'a': 'I' || u.a}])[1], list_sort([d1, {'c': u.c + 3, 'a': 'I' || u.a}])[1], u, list_sort([d3, {'c': u.c + 3, 'a': 'I' || u.a}])[1]
         FROM (SELECT *, list_sort([d2, {'c': d3.c + 3, 'a': 'I' || d3.a}])[1] AS u FROM (
             SELECT j.conv_id, j.i,
                    list_sort([{'c': s0.c + 4, 'a': 'D' || s0.a}, {'c': s2.c + x + 3, 'a': 'R' || s2.a}, {'c': s2.c + x + CASE initial WHEN 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || s2.a},
                               {'c': s1.c + x + CASE initial WHEN 's' THEN 0 ELSE 1000000 END, 'a': 'K' || s1.a}])[1] AS d0,
                    list_sort([{'c': s1.c + 4, 'a': 'D' || s1.a}, {'c': s2.c + x + 3, 'a': 'R' || s2.a}, {'c': s2.c + x + CASE initial WHEN 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || s2.a}])[1] AS d1,
                    list_sort([{'c': s2.c + 4, 'a': 'D' || s2.a}, {'c': s3.c + x + 3, 'a': 'R' || s3.a}, {'c': s3.c + x + CASE initial WHEN 'a' THEN 0 ELSE 1000000 END, 'a': 'K' || s3.a}])[1] AS d2,
                    list_sort([{'c': s3.c + 4, 'a': 'D' || s3.a}, {'c': s2.c + x + 3, 'a': 'R' || s2.a}, {'c': s2.c + x + CASE initial WHEN 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || s2.a}])[1] AS d3
             FROM togo t JOIN (SELECT *, CASE fault WHEN 'blank' THEN 1000000 WHEN 'duplicate' THEN 1000000 WHEN 'truncated' THEN 3 ELSE 0 END AS x FROM judged) j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.i = t.i - 1))),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM togo WHERE i = 1),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS pos FROM best WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS k FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
stay AS (SELECT p.*, j.role, CASE edit WHEN 'I' THEN '' ELSE j.text END AS text, max(CASE WHEN k = 1 AND edit = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
         FROM placed p LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM stay GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""

_JACCARD_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingles FROM d),
sets AS (SELECT md5(array_to_string(list_sort(shingles), '|')) AS k, len(any_value(shingles)) AS n, any_value(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY 1),
entries AS (SELECT k, n, unnest(shingles) AS g FROM sets),
shared AS (SELECT g FROM entries GROUP BY g HAVING count(*) > 1),
few AS (SELECT e.* FROM entries e SEMI JOIN shared USING (g)),
met AS (SELECT a.k AS u, b.k AS v FROM few a JOIN few b ON a.g = b.g AND a.k <> b.k AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
        GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT k, k AS r FROM sets UNION SELECT reach.k, met.v FROM reach JOIN met ON met.u = reach.r),
docs AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), '|')) AS k FROM s),
least AS (SELECT reach.k, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.k = reach.r AND docs.n > 0 GROUP BY reach.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM docs LEFT JOIN least USING (k)"""

ORACLES = {"op11_jaccard": _JACCARD_SQL, "op13_repair": _REPAIR_SQL, "op12_divergence": _AUDIT_SQL, "op5_url_filter": _URL_SQL, "op7_licenses": _LICENSE_SQL, "op8_maxscore": _TOP_SQL, "op9_mixing": _MIX_SQL}
