"""Personal data by base formats and by bootstrapped contextual extraction.

Base formats (e-mail, IP address, card and phone numbers) give seed entities. Then, over the whole corpus:

1. One pass over the texts yields the base spans and, for every seed and every other identifier-like token
   (six digits or more, or an at sign), its lexical patterns: the two words before it, the two words after it, and
   the word on either side, each together with the token's class (number, address, other).
2. Patterns and instances form a bipartite graph. Confidence spreads over it in rounds: a pattern is worth the
   mean worth of the distinct instances it meets (with a prior that keeps rare patterns low), and an instance
   is worth its best pattern; seeds are worth one. Discovered instances thus vouch for further patterns.
3. Occurrences of instances in a pattern of high confidence, which enough different seeds or strong instances
   support, become spans of kind ``id``, unless they overlap a base span.

The graph is made of distinct (pattern, instance) pairs, so an identifier repeated in a third of all rows is one
edge, and every step is a partially aggregated group or an equi-join on pattern, instance or row.

Defined results: a null or empty text has no spans; a null id keeps its row; repeated rows have equal spans;
spans are in code points, end exclusive, ordered by start and then by kind in the order of ``KINDS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import fresh, named, tidy
from clauseloom.session import materialize

#: Kinds in their order; the last one is what the contexts find.
KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Numbers begin where a run of digits begins: a match that fails there fails later in the run, too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_SPACE = "\t\n\x0b\x0c\r "
_EDGES = "\"'`()[]{}<>,;:!?."

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done, "email"
        at = text.find("@", max(done, at + 1))


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base formats, by start and then kind."""
    found = list(_emails(text))
    if _DIGITS.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]
        found += [
            (*m.span(), "card") for m in _CARD.finditer(text)
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)
        ]
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _token_at(text: str, at: int) -> tuple[int, int]:
    """The word around a position, without punctuation at its ends."""
    start = end = at
    while start > 0 and text[start - 1] not in _SPACE:
        start -= 1
    while end < len(text) and text[end] not in _SPACE:
        end += 1
    while start < end and text[start] in _EDGES:
        start += 1
    while start < end and text[end - 1] in _EDGES:
        end -= 1
    return start, end


def identifier_tokens(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Words with six digits or more, or an at sign, that overlap no base span."""
    done, spans = 0, iter(sorted(taken))
    span = next(spans, None)
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < done:
            continue
        start, end = _token_at(text, m.start())
        done = max(end, m.end())
        while span and span[1] <= start:
            span = next(spans, None)
        if start < end and not (span and span[0] < end):
            token = text[start:end]
            if "@" in token or len(_digits(token)) >= 6:
                yield start, end


def token_class(token: str) -> str:
    """``@`` for address-like tokens, ``9`` for numbers with any separators, ``x`` for all others (with letters)."""
    return "@" if "@" in token else "x" if any(c.isalpha() for c in token) else "9"


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to two lower-cased words on either side, found within 200 characters of the token's ends."""
    before = text[max(0, start - 200) : start].lower().split()[-2:]
    after = text[end : end + 200].lower().split(None, 2)[:2]
    return before, [w.strip(_EDGES) or w for w in after]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a token: two words before, two words after, one on either side, with its class."""
    before, after = _near(text, start, end)
    kind, found = token_class(text[start:end]), []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} <{kind}>")
    if len(after) == 2:
        found.append(f"<{kind}> {after[0]} {after[1]}")
    if before and after:
        found.append(f"{before[-1]} <{kind}> {after[0]}")
    return found


_SPANS = "array<struct<start:int,end:int,kind:string>>"
_FOUND = f"struct<base:{_SPANS},tokens:array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<string>>>>"


def scan(text: Column) -> Column:
    """Base spans and identifier-like tokens with their patterns, of a text column."""

    @F.arrow_udf(_FOUND)
    @tidy
    def of_texts(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            body = value.as_py() or ""
            base = base_spans(body)
            places = [(s, e, True) for s, e, _ in base] + [(s, e, False) for s, e in identifier_tokens(body, base)]
            rows.append({
                "base": [{"start": s, "end": e, "kind": k} for s, e, k in base],
                "tokens": [
                    {"start": s, "end": e, "instance": body[s:e].lower(), "seed": seed, "patterns": patterns(body, s, e)}
                    for s, e, seed in places
                ],
            })
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        token = pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()),
            ("patterns", pa.list_(pa.string())),
        ])
        return pa.array(rows, pa.struct([("base", pa.list_(span)), ("tokens", pa.list_(token))]))

    return of_texts(text)


def confident_patterns(
    occurrences: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, prior: float = 0.5
) -> DataFrame:
    """``occurrences(pattern, instance, seed)`` → ``(pattern, worth)`` of the patterns to trust.

    ``support``: distinct instances worth at least ``confidence`` that a pattern must have met; ``prior``:
    worthless instances added to every pattern.
    """
    edges = materialize(
        occurrences.groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.max("seed").alias("seed")),
        "pii-graph",
    )
    worth = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("instance_worth"))
    for step in range(rounds):
        met = edges.join(worth, "instance")
        strong = F.sum((F.col("instance_worth") >= confidence).cast("int"))
        scored = met.groupBy("pattern").agg(
            (F.sum("instance_worth") / (F.count("*") + prior)).alias("worth"), strong.alias("strong")
        ).filter((F.col("worth") >= confidence) & (F.col("strong") >= support)).select("pattern", "worth")
        if step + 1 < rounds:
            best = edges.join(scored, "pattern", "left").groupBy("instance").agg(
                F.max(F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("worth", F.lit(0.0)))).alias("instance_worth")
            )
            worth = materialize(best, "pii-worth")
    return scored


def _discovered(found: DataFrame, keys: list[str], **settings: float) -> DataFrame:
    """``found(keys, tokens)`` → ``(keys, extra)``: spans that only their context gives away."""
    tokens = found.select(*keys, F.inline("tokens"))
    places = tokens.select(*keys, "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    trusted = materialize(confident_patterns(places, **settings), "pii-patterns")
    spans = places.filter("not seed").join(trusted, "pattern").select(*keys, "start", "end").distinct()
    span = F.struct("start", "end", F.lit(KINDS[-1]).alias("kind"))
    return spans.groupBy(*keys).agg(F.collect_list(span).alias("extra"))


def _ordered(base: Column, extra: Column) -> Column:
    """All spans by start, then kind. An extra span never overlaps a base span."""
    rank = F.transform(
        F.concat(base, F.coalesce(extra, F.array().cast(_SPANS))),
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
            s["end"].alias("end"), s["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.sort_array(rank), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )


def _row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart by id and text; copies of a text under many ids are then many keys, not a hot one."""
    return F.md5(F.concat_ws("\0", named(doc_id).cast("string"), named(text)))


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings: float) -> DataFrame:
    """``(doc_id, base, spans)``: base spans and all spans of every row of ``docs``.

    Rows are told apart by id and a hash of the text; equal rows share their spans.
    """
    row = _row_key(doc_id, text)
    found = materialize(
        docs.select(named(doc_id).alias("doc_id"), row.alias("row"), scan(named(text)).alias("found")).select(
            "doc_id", "row", "found.base", "found.tokens"
        ),
        "pii",
    )
    extra = _discovered(found.filter(F.size("tokens") > 0), ["row"], **settings)
    return found.join(extra, "row", "left").select("doc_id", "base", _ordered(F.col("base"), F.col("extra")).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans go as one."""

    @F.arrow_udf("string")
    @tidy
    def masked(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(texts, lists, strict=True):
            body, found = value.as_py(), found.as_py()
            if body and found:
                parts, done = [], 0
                for s in found:
                    if s["start"] >= done:
                        parts += [body[done : s["start"]], f"<{s['kind']}>"]
                    done = max(done, s["end"])
                body = "".join(parts) + body[done:]
            out.append(body)
        return pa.array(out, pa.string())

    return masked(text, spans)


def mask_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings: float) -> DataFrame:
    """``docs`` with personal data masked in ``text``. The graph is built from a table of tokens; texts are
    scanned again where they lie and meet only the few rows that contexts add spans to."""
    found, row, extra = fresh(docs, "found", "row", "extra")
    tokens = materialize(
        docs.select(_row_key(doc_id, text).alias("row"), scan(named(text)).alias("found")).select("row", "found.tokens")
        .filter(F.size("tokens") > 0), "pii",
    )
    # Written out, its true size is known when the join is planned.
    more = materialize(_discovered(tokens, ["row"], **settings), "pii-extra").withColumnsRenamed({"row": row, "extra": extra})
    marked = docs.withColumn(row, _row_key(doc_id, text)).join(more, row, "left").withColumn(found, scan(named(text)))
    whole = marked.withColumn(text, mask(named(text), _ordered(F.col(f"{found}.base"), F.col(extra))))
    return whole.select(*[named(c) for c in docs.columns])


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
