"""Common table expressions of the SQL oracles (name -> dependencies, body).

The oracle dialect has no look-around, so boundaries are written with consuming classes, and no
UTF-16, so units are code points plus astral code points.
"""

from __future__ import annotations

from clauseloom.functions import fixed_values as fv
from clauseloom.sources.derived import SHARED

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    name: (inputs, text.format(**{i: i for i in inputs})) for name, (inputs, text) in SHARED.items()
}

WS = fv.WS
_B = r"[^\p{L}\p{N}_]"


def u16(expr: str) -> str:
    return (
        f"CAST(length({expr}) + length(regexp_replace({expr}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT)"
    )


def hard(expr: str) -> str:
    return (
        f"(regexp_matches({expr}, '(?i)(^|{_B})(must|shall)($|{_B})')"
        f" OR regexp_matches({expr}, '必须|不得|应当|(^|[^无])须($|[^知])'))"
    )


def score(expr: str) -> str:
    zh = (
        "(最高可得|最高得|最高为|满分为|满分|分值为|分值|得|计|赋)"
        rf"{WS}*\d+(\.\d+)?{WS}*分($|{_B})"
    )
    # The prefixed English form always contains the bare "N points" form.
    return (
        f"(regexp_matches({expr}, '{zh}')"
        rf" OR regexp_matches({expr}, '(?i)(^|{_B})\d+(\.\d+)?{WS}+points?($|{_B})'))"
    )


def delimiter(expr: str) -> str:
    return rf"regexp_matches({expr}, '[{fv.SENTENCE_MARKS}]|\.({WS}|\z)')"


def trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+\z', '', 'g')"


def ltrim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+', '')"


def blank(expr: str) -> str:
    return rf"regexp_matches({expr}, '^{WS}*\z')"


def txt_heading_level(expr: str) -> str:
    """NULL unless the line is a heading by the plain-text grammar."""
    ok = f"{u16(expr)} <= 120 AND NOT {delimiter(expr)} AND NOT {hard(expr)} AND NOT {score(expr)}"
    cases = []
    for pattern, group, level in (
        (fv.TXT_MARKDOWN, 2, f"length(regexp_extract({expr}, '{fv.TXT_MARKDOWN}', 1))"),
        (fv.TXT_CHAPTER, 2, f"CASE regexp_extract({expr}, '{fv.TXT_CHAPTER}', 1) WHEN '章' THEN 1 ELSE 2 END"),
        (fv.TXT_DECIMAL, 2, f"len(string_split(regexp_extract({expr}, '{fv.TXT_DECIMAL}', 1), '.'))"),
        (fv.TXT_CHINESE_LIST, 1, "1"),
    ):
        title = f"regexp_extract({expr}, '{pattern}', {group})"
        cases.append(
            f"WHEN regexp_matches({expr}, '{pattern}') THEN CASE WHEN {blank(title)} THEN NULL ELSE {level} END"
        )
    return f"CAST(CASE WHEN NOT ({ok}) THEN NULL {' '.join(cases)} END AS BIGINT)"


def txt_heading_title(expr: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({expr}, '{p}') THEN regexp_extract({expr}, '{p}', {g})"
        for p, g in (
            (fv.TXT_MARKDOWN, 2), (fv.TXT_CHAPTER, 2), (fv.TXT_DECIMAL, 2), (fv.TXT_CHINESE_LIST, 1),
        )
    )
    return f"CASE {cases} END"


def category(text: str) -> str:
    def words(pattern: str) -> str:
        return f"(?i)(^|{_B}){pattern}($|{_B})"

    return (
        f"CASE WHEN regexp_matches({text}, '{'|'.join(fv.COMPLIANCE_CHINESE)}')"
        f" OR regexp_matches({text}, '{words(fv.COMPLIANCE_ENGLISH)}') THEN 'compliance'"
        f" WHEN regexp_matches({text}, '{'|'.join(fv.COMMERCIAL_CHINESE)}')"
        f" OR regexp_matches({text}, '{words(fv.COMMERCIAL_ENGLISH)}') THEN 'commercial'"
        f" ELSE 'technical' END"
    )


BREAK = chr(0xE000)

PARTS.update(
    {
        "tender_raw": (
            ("tender_lines",),
            r"""
            SELECT doc_no,
                   CASE WHEN doc_no % 5 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS text
            FROM (SELECT doc_no, string_agg(line, chr(10) ORDER BY seq) || chr(10) ||
                         CASE WHEN doc_no % 3 = 0 THEN 'Cafe' || chr(769) || ' annex' ELSE 'annex' END AS t
                  FROM tender_lines GROUP BY doc_no)""",
        ),
        "corpus": (
            ("tender_raw",),
            """
            SELECT 'd-' || doc_id AS doc_id, text FROM documents
            UNION ALL SELECT 't-' || doc_no, text FROM tender_raw""",
        ),
        "canon": (
            ("corpus",),
            r"""
            SELECT doc_id, nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text FROM corpus""",
        ),
        "all_lines": (
            ("canon",),
            f"""
            SELECT doc_id, line_no, line, n,
                   CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_start
            FROM (SELECT doc_id, line_no, line, {u16('line')} AS n
                  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                               CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no
                        FROM canon))""",
        ),
        "line_blocks": (
            ("all_lines",),
            """
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no, line_no, line,
                   text_start, text_start + n AS text_end
            FROM all_lines WHERE length(line) > 0""",
        ),
        "headed": (
            ("line_blocks",),
            f"""
            SELECT *, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind,
                   CASE WHEN level IS NOT NULL THEN {txt_heading_title('line')} END AS title
            FROM (SELECT *, {txt_heading_level('line')} AS level FROM line_blocks)""",
        ),
        # A heading stays open until the next heading of its level or a shallower one.
        "open_headings": (
            ("headed",),
            """
            SELECT h.doc_id, h.line_no, h.level, h.title,
                   (SELECT min(c.line_no) FROM headed c
                    WHERE c.doc_id = h.doc_id AND c.line_no > h.line_no AND c.level <= h.level) AS closed_at
            FROM headed h WHERE h.level IS NOT NULL""",
        ),
        "pathed": (
            ("headed", "open_headings"),
            """
            SELECT b.doc_id, b.block_no, b.line_no, b.line, b.text_start, b.text_end, b.kind, b.level, b.title,
                   coalesce(p.path, []) AS path
            FROM headed b LEFT JOIN (
              SELECT b.doc_id, b.line_no, list(o.title ORDER BY o.line_no) AS path
              FROM headed b JOIN open_headings o
                ON o.doc_id = b.doc_id AND o.line_no <= b.line_no AND (o.closed_at IS NULL OR o.closed_at > b.line_no)
              GROUP BY b.doc_id, b.line_no) p ON p.doc_id = b.doc_id AND p.line_no = b.line_no""",
        ),
        "pieces": (
            ("pathed",),
            f"""
            SELECT *, CAST(coalesce(sum({u16('raw')}) OVER (PARTITION BY doc_id, line_no ORDER BY piece_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS piece_offset
            FROM (SELECT doc_id, block_no, line_no, text_start, kind, path, unnest(parts) AS raw,
                         CAST(generate_subscripts(parts, 1) AS BIGINT) AS piece_no
                  FROM (SELECT *, string_split(regexp_replace(regexp_replace(line,
                               '([{fv.SENTENCE_MARKS}])', '\\1{BREAK}', 'g'),
                               '\\.({WS}|\\z)', '.{BREAK}\\1', 'g'), '{BREAK}') AS parts FROM pathed))""",
        ),
        "sentences": (
            ("pieces",),
            f"""
            SELECT doc_id, block_no, line_no, kind, path, piece_no, {trim('raw')} AS quote,
                   text_start + piece_offset + length(raw) - length({ltrim('raw')}) AS quote_start,
                   text_start + piece_offset + length(raw) - length({ltrim('raw')}) + {u16(trim('raw'))} AS quote_end
            FROM pieces WHERE length({trim('raw')}) > 0""",
        ),
        "tagged": (
            ("sentences",),
            f"SELECT *, {hard('quote')} AS hard, {score('quote')} AS score FROM sentences",
        ),
        "candidates": (("tagged",), "SELECT * FROM tagged WHERE kind <> 'heading' AND (hard OR score)"),
        "firsts": (
            ("candidates",),
            """
            SELECT * EXCLUDE (occurrence) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, quote
                     ORDER BY quote_start, quote_end) AS occurrence FROM candidates) WHERE occurrence = 1""",
        ),
        "extracted": (
            ("firsts",),
            f"""
            SELECT *, 'REQ-' || CASE WHEN ordinal < 1000 THEN lpad(CAST(ordinal AS VARCHAR), 4, '0')
                                     ELSE CAST(ordinal AS VARCHAR) END AS code,
                   {category("(array_to_string(path, ' ') || ' ' || quote)")} AS category,
                   CASE WHEN hard THEN 'mandatory' ELSE 'important' END AS priority,
                   CASE WHEN hard AND score THEN 0.98 WHEN hard THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quote_start, quote_end) AS ordinal
                  FROM firsts)""",
        ),
    }
)
