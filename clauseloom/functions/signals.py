"""Requirement signals, headings and categories as Catalyst expressions over literal patterns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.text import is_blank, trim_ws, utf16_length

_WORD_CASELESS = "(?iu)"


def _word(pattern: str) -> str:
    return rf"{_WORD_CASELESS}(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])"


def _contains_any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _caseless_any(text: Column, *words: str) -> Column:
    """Byte-level pre-test for caseless words; the long s folds to s, so its presence passes too."""
    return _contains_any(F.lower(text), *words) | text.contains("ſ")


# Each test below puts plain byte searches before its pattern: most text has no such word at all.


def has_hard(text: Column) -> Column:
    english = _caseless_any(text, "must", "shall") & text.rlike(_WORD_CASELESS + fv.HARD_ENGLISH)
    chinese = _contains_any(text, "须", "不得", "应当") & text.rlike(fv.HARD_CHINESE)
    return english | chinese


def has_score(text: Column) -> Column:
    chinese = text.contains("分") & text.rlike(fv.CHINESE_SCORE)
    english = F.lower(text).contains("point") & (
        text.rlike(_WORD_CASELESS + fv.ENGLISH_PREFIX_SCORE)
        | text.rlike(_WORD_CASELESS + fv.EXPLICIT_ENGLISH_SCORE)
    )
    return chinese | english


def has_signal(text: Column) -> Column:
    return has_hard(text) | has_score(text)


def may_signal(text: Column) -> Column:
    """Superset of ``has_signal`` for any piece of ``text``: a cheap filter before splitting."""
    return _contains_any(text, "须", "不得", "应当", "分") | _caseless_any(text, "must", "shall", "point")


def has_delimiter(text: Column) -> Column:
    full_stop = text.contains(".") & text.rlike(rf"\.(?:{fv.WS}|\z)")
    return _contains_any(text, *fv.SENTENCE_MARKS) | full_stop


class Rule(NamedTuple):
    """One row of a user lexicon."""

    signal: str
    language: str
    pattern: str


BUILT_IN_RULES: tuple[Rule, ...] = (
    Rule("hard", "en", _WORD_CASELESS + fv.HARD_ENGLISH),
    Rule("hard", "zh", fv.HARD_CHINESE),
    Rule("score", "zh", fv.CHINESE_SCORE),
    Rule("score", "en", _WORD_CASELESS + fv.ENGLISH_PREFIX_SCORE),
    Rule("score", "en", _WORD_CASELESS + fv.EXPLICIT_ENGLISH_SCORE),
)


def rule_flags(text: Column, rules: Iterable[Rule]) -> dict[str, Column]:
    """One boolean per signal. Rules are literals in the plan: each pattern compiles once per task
    and no row is paired with a rules table."""
    by_signal: dict[str, list[Column]] = {}
    for rule in rules:
        by_signal.setdefault(rule.signal, []).append(text.rlike(rule.pattern))
    return {name: reduce(lambda a, b: a | b, tests) for name, tests in by_signal.items()}


def _first_match(*cases: tuple[Column, Column]) -> Column:
    """``when`` chain: the first test that holds decides, even when its value is NULL."""
    chain = F.when(cases[0][0], cases[0][1])
    for test, value in cases[1:]:
        chain = chain.when(test, value)
    return chain


def _heading(level: Column, title: Column) -> Column:
    return F.when(~is_blank(title), F.struct(level.cast("int").alias("level"), title.alias("title")))


def txt_heading(text: Column) -> Column:
    """struct<level,title> or NULL for one physical line of plain text."""
    eligible = (utf16_length(text) <= fv.HEADING_MAX_UNITS) & ~has_delimiter(text) & ~has_signal(text)
    chapter = F.regexp_extract(text, fv.TXT_CHAPTER, 1)
    decimal = F.regexp_extract(text, fv.TXT_DECIMAL, 1)
    found = _first_match(
        (
            text.rlike(fv.TXT_MARKDOWN),
            _heading(
                F.length(F.regexp_extract(text, fv.TXT_MARKDOWN, 1)),
                F.regexp_extract(text, fv.TXT_MARKDOWN, 2),
            ),
        ),
        (
            text.rlike(fv.TXT_CHAPTER),
            _heading(
                F.when(chapter == "章", 1).otherwise(2), F.regexp_extract(text, fv.TXT_CHAPTER, 2)
            ),
        ),
        (
            text.rlike(fv.TXT_DECIMAL),
            _heading(F.size(F.split(decimal, r"\.")), F.regexp_extract(text, fv.TXT_DECIMAL, 2)),
        ),
        (
            text.rlike(fv.TXT_CHINESE_LIST),
            _heading(F.lit(1), F.regexp_extract(text, fv.TXT_CHINESE_LIST, 1)),
        ),
    )
    # Only lines that start like a heading pay for the signal and delimiter tests.
    return F.when(text.rlike(r"^(?:#|第|\d|[一二三四五六七八九十百])"), F.when(eligible, found))


def page_heading(text: Column) -> Column:
    """struct<level,title> or NULL by the page-text grammar (wider numerals, trimmed title)."""
    chapter = F.regexp_extract(text, fv.PAGE_CHAPTER, 1)
    decimal = F.regexp_extract(text, fv.PAGE_DECIMAL, 1)
    return _first_match(
        (
            text.rlike(fv.PAGE_MARKDOWN),
            _heading(
                F.length(F.regexp_extract(text, fv.PAGE_MARKDOWN, 1)),
                trim_ws(F.regexp_extract(text, fv.PAGE_MARKDOWN, 2)),
            ),
        ),
        (
            text.rlike(fv.PAGE_CHAPTER),
            _heading(
                F.when(chapter == "章", 1).otherwise(2),
                trim_ws(F.regexp_extract(text, fv.PAGE_CHAPTER, 2)),
            ),
        ),
        (
            text.rlike(fv.PAGE_DECIMAL),
            _heading(
                F.least(F.lit(9), F.size(F.split(decimal, r"\."))),
                trim_ws(F.regexp_extract(text, fv.PAGE_DECIMAL, 2)),
            ),
        ),
        (
            text.rlike(fv.PAGE_CHINESE_LIST),
            _heading(F.lit(1), trim_ws(F.regexp_extract(text, fv.PAGE_CHINESE_LIST, 1))),
        ),
    )


def category_of(section_path: Column, quote: Column) -> Column:
    """compliance, else commercial, else technical, judged on section titles plus quote."""
    text = F.concat(F.array_join(section_path, " "), F.lit(" "), quote)
    compliance = text.rlike("|".join(fv.COMPLIANCE_CHINESE)) | text.rlike(_word(fv.COMPLIANCE_ENGLISH))
    commercial = text.rlike("|".join(fv.COMMERCIAL_CHINESE)) | text.rlike(_word(fv.COMMERCIAL_ENGLISH))
    return F.when(compliance, "compliance").when(commercial, "commercial").otherwise("technical")


def priority_of(hard: Column) -> Column:
    return F.when(hard, "mandatory").otherwise("important")


def confidence_of(hard: Column, score: Column) -> Column:
    return (
        F.when(hard & score, fv.CONFIDENCE_BOTH)
        .when(hard, fv.CONFIDENCE_HARD)
        .otherwise(fv.CONFIDENCE_SCORE)
        .cast("decimal(5,4)")
    )
