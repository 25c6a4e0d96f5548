"""Where lines, sentences and open headings lie: Arrow functions over a batch of texts.

Offsets are UTF-16 code units. Each function is one pass over a text with prefix sums in numpy; in column expressions a prefix sum costs
many evaluations an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.batches import tidy
from clauseloom.functions.text import WS_CHARS

_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
LINES = T.ArrayType(T.StructType().add("line_no", _LONG).add("line", _STRING).add("text_start", _LONG).add("text_end", _LONG))
PIECES = T.ArrayType(T.StructType().add("piece_no", _INT).add("raw", _STRING).add("offset", _LONG))
QUOTES = T.ArrayType(T.StructType().add("piece_no", _INT).add("quote", _STRING).add("lead", _LONG).add("units", _LONG))

# After a mark always; after a full stop only before white space or the end.
_BREAK = re.compile(rf"[{re.escape(fv.SENTENCE_MARKS)}]|\.(?=[{re.escape(WS_CHARS)}]|\Z)")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_ASTRAL.findall(text))


def _lengths(text: str, parts: list[str]) -> np.ndarray:
    """UTF-16 lengths of the parts of a text; only texts with characters beyond 16 bits count them part by part."""
    measure = len if text.isascii() or not _ASTRAL.search(text) else units
    return np.fromiter(map(measure, parts), np.int64, len(parts))


def _lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _whole(parts: Iterable[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


@F.arrow_udf(LINES)
@tidy
def line_ranges(texts: pa.Array) -> pa.Array:
    """The non-empty physical lines of a text (null: none)."""
    lines, numbers, starts, ends, counts = [], [], [], [], []
    for value in texts:
        text = value.as_py()
        every = [] if text is None else text.split("\n")
        lengths = _lengths(text or "", every)
        filled = np.flatnonzero(lengths)
        start = (np.cumsum(lengths + 1) - lengths - 1)[filled]
        lines += [line for line in every if line]
        numbers.append(filled + 1)
        starts.append(start)
        ends.append(start + lengths[filled])
        counts.append(len(filled))
    return _lists(counts, {
        "line_no": pa.array(_whole(numbers)), "line": pa.array(lines, pa.string()), "text_start": pa.array(_whole(starts)), "text_end": pa.array(_whole(ends)),
    })


def _cut(text: str) -> list[str]:
    """A text between its sentence breaks; what follows the last break is a piece, empty or not."""
    pieces, at = [], 0
    for found in _BREAK.finditer(text):
        pieces.append(text[at : found.end()])
        at = found.end()
    pieces.append(text[at:])
    return pieces


@F.arrow_udf(PIECES)
@tidy
def sentence_pieces(texts: pa.Array) -> pa.Array:
    """Every piece of a text, untrimmed, with its offset in it (null: none)."""
    pieces, numbers, offsets, counts = [], [], [], []
    for value in texts:
        text = value.as_py()
        own = [] if text is None else _cut(text)
        lengths = _lengths(text or "", own)
        pieces += own
        numbers.append(np.arange(1, len(own) + 1))
        offsets.append(np.cumsum(lengths) - lengths)
        counts.append(len(own))
    return _lists(counts, {
        "piece_no": pa.array(_whole(numbers).astype(np.int32)), "raw": pa.array(pieces, pa.string()), "offset": pa.array(_whole(offsets)),
    })


@F.arrow_udf(QUOTES)
@tidy
def sentence_quotes(texts: pa.Array) -> pa.Array:
    """The pieces that are not blank, trimmed at their edges, with their offset in the text and length."""
    numbers, quotes, leads, sizes, counts = [], [], [], [], []
    for value in texts:
        text, at, before = value.as_py(), 0, len(quotes)
        own = [] if text is None else _cut(text)
        for number, piece in enumerate(own, 1):
            bare = piece.lstrip(WS_CHARS)
            quote = bare.rstrip(WS_CHARS)
            if quote:
                numbers.append(number)
                quotes.append(quote)
                # White space is never beyond 16 bits.
                leads.append(at + len(piece) - len(bare))
                sizes.append(units(quote))
            at += units(piece)
        counts.append(len(quotes) - before)
    return _lists(counts, {
        "piece_no": pa.array(numbers, pa.int32()), "quote": pa.array(quotes, pa.string()), "lead": pa.array(leads, pa.int64()), "units": pa.array(sizes, pa.int64()),
    })


@F.arrow_udf(T.ArrayType(T.ArrayType(_STRING)))
@tidy
def open_titles(headings: pa.Array) -> pa.Array:
    """Per line of an array of ``struct<level,title>`` (null where the line is none), the titles open at it: a heading closes those of its own
    level or deeper. A path is made once per heading and shared by the lines below it."""
    counts = np.array(headings.value_lengths().fill_null(0), np.int64)
    flat = headings.flatten()
    first = np.repeat(np.cumsum(counts) - counts, counts)
    marked = np.flatnonzero(np.array(flat.is_valid()))
    levels, titles = flat.field("level").take(pa.array(marked)).to_pylist(), flat.field("title").take(pa.array(marked)).to_pylist()
    paths: list[list[str]] = [[]]
    stack: list[tuple[int, str]] = []
    row = -1
    for at, level, title in zip(first[marked].tolist(), levels, titles, strict=True):
        if at != row:
            row, stack = at, []
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        paths.append([t for _, t in stack])
    number = np.zeros(len(flat), np.int64)
    number[marked] = np.arange(1, len(marked) + 1)
    # The last heading up to a line, if it is of the same text.
    last = np.maximum.accumulate(np.where(number > 0, np.arange(len(flat)), -1)) if len(flat) else number
    number = np.where(last >= first, number[last], 0)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths, pa.list_(pa.string())).take(pa.array(number)))
