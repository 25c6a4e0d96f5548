"""Text primitives: UTF-16 arithmetic, canonical form, whitespace trimming, prefix sums."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseloom.functions.fixed_values import WS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression (a lambda variable is evaluated a single time)."""
    return F.transform(F.array(value), body)[0]


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a one-row generator, so that later uses read the value instead of
    repeating the expression (the optimizer merges plain projections)."""
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; Spark's ``length`` counts code points."""
    ascii_only = F.octet_length(text) == F.length(text)
    encoded = F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)
    return F.when(ascii_only, F.length(text)).otherwise(encoded).cast("long")


# Ranges in which every code point is NFC already and never composes with a neighbour (a test walks
# them against the Unicode database): Latin, Greek capitals aside, general punctuation, CJK marks,
# kana, ideographs, Hangul syllables, full-width forms, pictographs.
NFC_SAFE = (
    r"\x{0}-\x{2FF}\x{391}-\x{3A1}\x{3B1}-\x{3C9}\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205E}"
    r"\x{2190}-\x{21FF}\x{2460}-\x{26FF}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FFEE}\x{1F300}-\x{1FAFF}"
)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def needs_nfc(text: Column) -> Column:
    """May NFC change ``text``? False is certain, True is a maybe."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(f"[^{NFC_SAFE}]")


def nfc(text: Column) -> Column:
    """NFC; only strings that may change travel to Python, the rest cross as nulls."""
    return F.coalesce(_nfc(F.when(needs_nfc(text), text)), text)


def canonicalize(text: Column) -> Column:
    """LF newlines, then NFC."""
    lf = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return nfc(lf)


# The characters of ``WS``, for the built-in trims (no regex in the hot path).
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def ltrim_ws(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return text.rlike(rf"^{WS}*\z")


_CHUNK, _LEVELS = 32, 2


def running_starts(lengths: Column, levels: int = _LEVELS) -> Column:
    """Exclusive prefix sums of an array<long>, inside the row.

    An element adds up its own chunk; the chunks' totals are summed in the same way, level by level, so the
    work is near proportional to the array (only the totals of 32² elements are added up directly). No shuffle, sort or window is needed to place
    parts of a text.
    """
    zero = F.lit(0).cast("long")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda acc, x: acc + x)

    def with_lengths(lens: Column) -> Column:
        chunks = F.ceil(F.size(lens) / _CHUNK).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), F.greatest(chunks - 1, F.lit(0))),
            lambda c: total(F.slice(lens, c * _CHUNK + 1, F.lit(_CHUNK))),
        )
        if levels > 1:
            bases = running_starts(sums, levels - 1)
        else:
            bases = let(sums, lambda s: F.transform(s, lambda _x, c: total(F.slice(s, F.lit(1), c))))

        def place(base: Column) -> Column:
            return F.transform(
                lens,
                lambda _x, i: base[F.floor(i / _CHUNK).cast("int")]
                + total(F.slice(lens, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)),
            )

        return let(bases, place)

    return let(lengths, with_lengths)
