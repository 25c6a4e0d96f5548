"""Text structure, sentences, rules and requirement extraction over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions import signals
from clauseloom.functions import text as tx
from clauseloom.operators import bigtext, lexicon
from clauseloom.operators import blocks as bl
from clauseloom.operators import requirements as rq
from clauseloom.operators import sentences as se
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import delimiter, hard, score, u16
from clauseloom.sources.derived import corpus, derive, table


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.canonical_documents(corpus(spark, sf_dir))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.sectioned_blocks(canonical(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.split_sentences(bl.line_blocks(canonical(spark, sf_dir)))


@entry("txt_canonicalize", ("canon",), "SELECT doc_id, text FROM canon")
def txt_canonicalize(spark, sf_dir):
    return canonical(spark, sf_dir)


@entry("txt_utf16_length", ("canon",), f"SELECT doc_id, {u16('text')} AS units, length(text) AS code_points FROM canon")
def txt_utf16_length(spark, sf_dir):
    text = F.col("text")
    return canonical(spark, sf_dir).select(
        "doc_id", tx.utf16_length(text).alias("units"), F.length(text).alias("code_points")
    )


@entry("txt_line_blocks", ("line_blocks",), "SELECT * FROM line_blocks")
def txt_line_blocks(spark, sf_dir):
    return bl.line_blocks(canonical(spark, sf_dir))


@entry("txt_heading", ("headed",), "SELECT doc_id, line_no, level, title FROM headed WHERE kind = 'heading'")
def txt_heading(spark, sf_dir):
    return headed(spark, sf_dir).filter("kind = 'heading'").select("doc_id", "line_no", "level", "title")


@entry(
    "txt_section_path",
    ("pathed",),
    "SELECT doc_id, line_no, kind, array_to_string(path, '|') AS section_path FROM pathed",
)
def txt_section_path(spark, sf_dir):
    return headed(spark, sf_dir).select("doc_id", "line_no", "kind", "section_path")


@entry(
    "sent_split",
    ("pieces",),
    "SELECT doc_id, line_no, piece_no, raw, piece_offset FROM pieces WHERE length(raw) > 0",
)
def sent_split(spark, sf_dir):
    pieces = se.raw_pieces(bl.line_blocks(canonical(spark, sf_dir)))
    return pieces.filter(F.length("raw") > 0).select(
        "doc_id", "line_no", "piece_no", "raw", F.col("offset").alias("piece_offset")
    )


@entry(
    "sent_trim_range",
    ("sentences",),
    "SELECT doc_id, line_no, piece_no, quote, quote_start, quote_end FROM sentences",
)
def sent_trim_range(spark, sf_dir):
    return sentences(spark, sf_dir).select(
        "doc_id", "line_no", "piece_no", "quote", "quote_start", "quote_end"
    )


@entry(
    "sent_has_delimiter",
    ("line_blocks",),
    f"SELECT doc_id, line_no, {delimiter('line')} AS has_delimiter FROM line_blocks",
)
def sent_has_delimiter(spark, sf_dir):
    return bl.line_blocks(canonical(spark, sf_dir)).select(
        "doc_id", "line_no", signals.has_delimiter(F.col("line")).alias("has_delimiter")
    )


@entry(
    "quote_sha256",
    ("sentences",),
    "SELECT doc_id, line_no, piece_no, sha256(quote) AS quote_sha256 FROM sentences",
)
def quote_sha256(spark, sf_dir):
    return sentences(spark, sf_dir).select(
        "doc_id", "line_no", "piece_no", F.sha2("quote", 256).alias("quote_sha256")
    )


def _rule_query(name: str, column: str, sql: str, test) -> None:
    @entry(
        name,
        ("sentences",),
        f"SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE {sql}) AS {column} FROM sentences GROUP BY doc_id",
    )
    def query(spark, sf_dir):
        return (
            sentences(spark, sf_dir)
            .groupBy("doc_id")
            .agg(F.count("*").alias("sentences"), F.count_if(test(F.col("quote"))).alias(column))
        )


@entry(
    "txt_scan_blocks",
    ("pathed",),
    "SELECT doc_id, block_no, line_no, text_start, text_end, kind, level, title, array_to_string(path, '|') AS section_path FROM pathed",
)
def txt_scan_blocks(spark, sf_dir):
    lines = bigtext.split_lines(canonical(spark, sf_dir), lines_a_chunk=64)
    return bigtext.sectioned_blocks(lines).drop("line")


@entry(
    "pos_scan_offsets",
    ("sentences", "all_lines"),
    """SELECT o.doc_id, o."offset", l.line_no AS line, o."offset" - l.text_start AS "column" FROM (
         SELECT doc_id, quote_start AS "offset" FROM sentences UNION ALL SELECT doc_id, quote_end FROM sentences) o
       JOIN all_lines l ON l.doc_id = o.doc_id AND o."offset" BETWEEN l.text_start AND l.text_start + l.n""",
)
def pos_scan_offsets(spark, sf_dir):
    ends = sentences(spark, sf_dir).select("doc_id", F.explode(F.array("quote_start", "quote_end")).alias("offset"))
    return bigtext.positions_at(bigtext.split_lines(canonical(spark, sf_dir), lines_a_chunk=64), ends)


_rule_query("rule_hard", "hard_hits", hard("quote"), signals.has_hard)
_rule_query("rule_score", "score_hits", score("quote"), signals.has_score)
_rule_query("rule_any", "signal_hits", f"{hard('quote')} OR {score('quote')}", signals.has_signal)


@entry(
    "rule_table_tag",
    ("sentences",),
    f"""SELECT doc_id, line_no, piece_no, {hard('quote')} AS is_hard, {score('quote')} AS is_score,
               regexp_matches(quote, '(?i)licen[cs]e') AS is_licence
        FROM sentences WHERE {hard('quote')} OR {score('quote')} OR regexp_matches(quote, '(?i)licen[cs]e')""",
)
def rule_table_tag(spark, sf_dir):
    rules = (*signals.BUILT_IN_RULES, signals.Rule("licence", "en", "(?i)licen[cs]e"))
    flags = signals.rule_flags(F.col("quote"), rules)
    tagged = sentences(spark, sf_dir).select(
        "doc_id", "line_no", "piece_no", *[test.alias(f"is_{name}") for name, test in flags.items()]
    )
    return tagged.filter("is_hard OR is_score OR is_licence")


#: A user's lexicon made from the parts: a rule per part and one per kind of goods, and one without any literal.
_LEXICON = """
    SELECT CAST(p_partkey AS BIGINT) AS rule_id, concat('size-', CAST(p_size % 5 AS STRING)) AS signal,
           concat('(?i)(^|[^a-z0-9])(supplier|bidder|item) ', CAST(p_partkey AS STRING), '($|[^a-z0-9])') AS pattern FROM {part}
    UNION ALL SELECT -1 - min(p_partkey), 'goods', concat('(?i)', p_name) FROM {part} GROUP BY p_name
    UNION ALL SELECT -1000000000, 'long-number', '[0-9][0-9][0-9][0-9]'"""


@entry(
    "rule_lexicon_tag",
    ("sentences",),
    f"""SELECT doc_id, line_no, piece_no, rule_id, signal FROM sentences JOIN (
          SELECT *, CASE signal WHEN 'goods' THEN lower(substr(pattern, 5)) WHEN 'long-number' THEN '' ELSE ' ' || rule_id END AS l FROM ({_LEXICON.format(part='part')}))
        ON contains(lower(quote), l) AND regexp_matches(quote, pattern)""",
)
def rule_lexicon_tag(spark, sf_dir):
    rules = spark.sql(_LEXICON, part=table(spark, sf_dir, "part"))
    return lexicon.tag_all(rules, sentences(spark, sf_dir), "quote", "doc_id", "line_no", "piece_no")


@entry(
    "req_candidates",
    ("candidates",),
    "SELECT doc_id, line_no, piece_no, quote, quote_start, quote_end, hard, score FROM candidates",
)
def req_candidates(spark, sf_dir):
    return rq.candidates(headed(spark, sf_dir)).select(
        "doc_id", "line_no", "piece_no", "quote", "quote_start", "quote_end", "hard", "score"
    )


@entry(
    "req_dedup_first",
    ("firsts",),
    "SELECT doc_id, quote, quote_start, quote_end FROM firsts",
)
def req_dedup_first(spark, sf_dir):
    return rq.keep_first_quote(rq.candidates(headed(spark, sf_dir))).select(
        "doc_id", "quote", "quote_start", "quote_end"
    )


@entry("req_codes", ("extracted",), "SELECT doc_id, code, quote, quote_start FROM extracted")
def req_codes(spark, sf_dir):
    found = rq.keep_first_quote(rq.candidates(headed(spark, sf_dir)))
    return rq.with_codes(found).select("doc_id", "code", "quote", "quote_start")


@entry(
    "req_priority_confidence",
    ("firsts",),
    """SELECT CASE WHEN hard THEN 'mandatory' ELSE 'important' END AS priority,
              CASE WHEN hard AND score THEN 0.98 WHEN hard THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
              count(*) AS requirements, count(DISTINCT doc_id) AS documents
       FROM firsts GROUP BY 1, 2""",
)
def req_priority_confidence(spark, sf_dir):
    found = rq.keep_first_quote(rq.candidates(headed(spark, sf_dir)))
    hard_, score_ = F.col("hard"), F.col("score")
    return (
        found.select(
            "doc_id",
            signals.priority_of(hard_).alias("priority"),
            signals.confidence_of(hard_, score_).alias("confidence"),
        )
        .groupBy("priority", "confidence")
        .agg(F.count("*").alias("requirements"), F.countDistinct("doc_id").alias("documents"))
    )


@entry("req_category", ("extracted",), "SELECT doc_id, code, category FROM extracted")
def req_category(spark, sf_dir):
    return rq.extract_txt_requirements(corpus(spark, sf_dir)).select("doc_id", "code", "category")


@entry(
    "req_extract",
    ("extracted", "line_blocks"),
    """SELECT doc_id, code, quote, category, priority, confidence, array_to_string(path, '|') AS section_path,
              line_no, quote_start, quote_end, sha256(quote) AS quote_sha256, line_no AS start_line, quote_start - text_start AS start_column,
              line_no AS end_line, quote_end - text_start AS end_column
       FROM extracted JOIN (SELECT doc_id, block_no, text_start FROM line_blocks) USING (doc_id, block_no)""",
)
def req_extract(spark, sf_dir):
    return rq.extract_txt_requirements(corpus(spark, sf_dir)).select(
        "doc_id", "code", "quote", "category", "priority", "confidence", "section_path", "line_no",
        "quote_start", "quote_end", F.sha2("quote", 256).alias("quote_sha256"),
        # Where the locator starts and ends; a sentence never leaves its line.
        F.col("line_no").alias("start_line"), (F.col("quote_start") - F.col("text_start")).alias("start_column"),
        F.col("line_no").alias("end_line"), (F.col("quote_end") - F.col("text_start")).alias("end_column"),
    )


@entry(
    "req_extract_summary",
    ("extracted",),
    "SELECT category, priority, count(*) AS requirements, count(DISTINCT doc_id) AS documents FROM extracted GROUP BY ALL",
)
def req_extract_summary(spark, sf_dir):
    return (
        rq.extract_txt_requirements(corpus(spark, sf_dir))
        .groupBy("category", "priority")
        .agg(F.count("*").alias("requirements"), F.countDistinct("doc_id").alias("documents"))
    )


_FIXTURE_VALUES = ", ".join(
    "(" + ", ".join(f"'{v}'" for v in row) + ")" for row in fv.FIXTURE_ROWS
)


@entry(
    "req_fixture_rows",
    ("project_files",),
    f"""SELECT f.id AS file_id, f.file_name, v.code, v.title, v.description, v.category, v.priority,
               '{fv.FIXTURE_METHOD}' AS extraction_method, CAST(NULL AS DOUBLE) AS confidence, '{fv.FIXTURE_SECTION}' AS section
        FROM project_files f CROSS JOIN (VALUES {_FIXTURE_VALUES}) v(code, title, description, category, priority)""",
)
def req_fixture_rows(spark, sf_dir):
    files = derive(spark, sf_dir, "project_files").select(F.col("id").alias("file_id"), "file_name")
    return rq.fixture_rows(files)


@entry(
    "req_parser_route",
    ("parse_tasks",),
    """SELECT id, type, CASE type WHEN 'development-document-parse' THEN 'fixture' WHEN 'document-parse-v1' THEN 'rules' END AS parser,
              CASE WHEN type NOT IN ('development-document-parse', 'document-parse-v1') THEN 'UNSUPPORTED_TASK_TYPE' END AS reject_reason
       FROM parse_tasks""",
)
def req_parser_route(spark, sf_dir):
    return rq.route_tasks(derive(spark, sf_dir, "parse_tasks").select("id", "type"))


@entry(
    "eval_recall",
    ("tender_lines",),
    f"""SELECT label, count(*) AS sentences, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 6) AS hit_rate
        FROM (SELECT label, CASE label WHEN 'hard' THEN {hard('line')} WHEN 'score' THEN {score('line')}
                                       ELSE {hard('line')} OR {score('line')} END AS hit
              FROM (SELECT line, CASE WHEN kind IN (2, 3, 4, 5, 10, 11) THEN 'hard' WHEN kind IN (6, 7) THEN 'score' ELSE 'none' END AS label
                    FROM tender_lines)) GROUP BY label""",
)
def eval_recall(spark, sf_dir):
    kind = F.col("kind")
    labelled = derive(spark, sf_dir, "tender_lines").select(
        F.when(kind.isin(2, 3, 4, 5, 10, 11), "hard")
        .when(kind.isin(6, 7), "score")
        .otherwise("none")
        .alias("label"),
        signals.has_hard(F.col("line")).alias("hard"),
        signals.has_score(F.col("line")).alias("score"),
    )
    return rq.recall_report(labelled)
