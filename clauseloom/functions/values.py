"""Canonical forms of values that documents write in many ways: dates, amounts of money, durations, numbers, names.

Everything is a short regular expression and a small conversion; texts that say no such value give null.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import WS_CHARS

# --- Fixed values: how languages write numbers, months and units -----------------------------------
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
STEPS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
MYRIADS = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8}
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SCALES = {"": 1, "万": 10**4, "亿": 10**8, "thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9}
CURRENCIES = {"人民币": "CNY", "rmb": "CNY", "cny": "CNY", "¥": "CNY", "￥": "CNY", "元": "CNY", "圆": "CNY", "usd": "USD", "us$": "USD", "$": "USD", "美元": "USD", "eur": "EUR", "€": "EUR", "欧元": "EUR"}
DAYS = {"日历天": 1, "天": 1, "日": 1, "day": 1, "days": 1, "周": 7, "week": 7, "weeks": 7}

_CHINESE = "[" + "".join((*DIGITS, *STEPS, *MYRIADS)) + "]+"
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_DATES = (
    re.compile(r"(\d{4})\s*(?:-|/|\.|年)\s*(\d{1,2})\s*(?:-|/|\.|月)\s*(\d{1,2})"), re.compile(rf"({_CHINESE}|[一二三四五六七八九〇零]{{4}})年({_CHINESE})月({_CHINESE})[日号]"),
    re.compile(r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})", re.I), re.compile(r"([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", re.I),
)
_SIGN = "|".join(re.escape(c) for c in sorted(CURRENCIES, key=len, reverse=True))
_SCALE = "|".join(s for s in sorted(SCALES, key=len, reverse=True) if s)
_AMOUNT = re.compile(rf"(?P<before>{_SIGN})?\s*(?P<number>{_NUMBER}|{_CHINESE})\s*(?P<scale>(?:{_SCALE})(?![a-z]))?\s*(?P<after>{_SIGN})?", re.I)
_DURATION = re.compile(rf"({_NUMBER}|{_CHINESE})\s*(?:calendar\s+|个)?({'|'.join(sorted(DAYS, key=len, reverse=True))})(?![a-z])", re.I)


def chinese_number(text: str) -> int | None:
    """The whole number of Chinese numerals; digit by digit where no step is named."""
    if not text or any(c not in DIGITS and c not in STEPS and c not in MYRIADS for c in text):
        return None
    if all(c in DIGITS for c in text):
        return int("".join(str(DIGITS[c]) for c in text))
    whole = part = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in STEPS:
            part, digit = part + (digit or 1) * STEPS[c], 0
        else:
            whole, part, digit = (whole + part + digit) * MYRIADS[c] if MYRIADS[c] > whole else whole + (part + digit) * MYRIADS[c], 0, 0
    return whole + part + digit


def number(text: str) -> Decimal | None:
    text = text.replace(",", "")
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return Decimal(text)
    found = chinese_number(text)
    return None if found is None else Decimal(found)


def _plain(value: Decimal) -> str:
    return format(value.normalize(), "f")


def a_date(text: str) -> str | None:
    """The first date, as year-month-day; one that no calendar has is none."""
    for kind, pattern in enumerate(_DATES):
        if found := pattern.search(text):
            try:
                if kind < 2:
                    year, month, day = (int(number(x)) for x in found.groups())
                else:
                    day, month = (found[1], found[2]) if kind == 2 else (found[2], found[1])
                    year, month, day = int(found[3]), MONTHS[month.lower()], int(day)
                return date(year, month, day).isoformat()
            except (KeyError, TypeError, ValueError):
                continue
    return None


def an_amount(text: str) -> str | None:
    """The first amount of money, as currency and plain number; a number without a currency is none."""
    for found in _AMOUNT.finditer(text):
        sign, value = found["before"] or found["after"], number(found["number"])
        if sign and value is not None:
            return f"{CURRENCIES[sign.lower()]} {_plain(value * SCALES[(found['scale'] or '').lower()])}"
    return None


def a_duration(text: str) -> str | None:
    found = _DURATION.search(text)
    value = number(found[1]) if found else None
    return None if value is None else f"{_plain(value * DAYS[found[2].lower()])} d"


def a_name(text: str) -> str | None:
    """Compatible characters alike, white space joined, closing marks and case away."""
    made = " ".join(unicodedata.normalize("NFKC", text).split()).strip(WS_CHARS + "。.;；,，")
    return made.casefold() or None


def a_code(text: str) -> str | None:
    made = re.sub(r"\s", "", unicodedata.normalize("NFKC", text)).strip("。.;；,，").upper()
    return made or None


KINDS = {"date": a_date, "amount": an_amount, "duration": a_duration, "name": a_name, "code": a_code}


@F.arrow_udf(T.StringType())
def canonical_value(kinds: pa.Array, texts: pa.Array) -> pa.Array:
    """A value of a kind in its canonical form; null where the text has none, or the kind is unknown."""
    made = []
    for kind, text in zip(kinds.to_pylist(), texts.to_pylist(), strict=True):
        reader = KINDS.get(kind)
        made.append(reader(text) if reader and text is not None else None)
    return pa.array(made, pa.string())
