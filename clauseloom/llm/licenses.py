"""License scans by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifier of a known license sentence, and the
sequence of identifiers is matched against ordered rules, longest first, so that a rule that extends another one wins.
All of it happens within a row, in built-in functions: nothing is shuffled. Texts without any of the words that
known sentences contain are not cut at all.

Lines are joined: a known sentence may run over line breaks (with or without comment signs), starts where a line or sentence
starts and ends where one ends, so that wrapped texts and unpunctuated lines both match. Blank lines and marks end it; published sentences that
hold a colon or semicolon are therefore several known sentences and one ordered rule.

SPDX lines are read as expressions: each license of ``A OR B``, ``A AND (B OR C)`` or ``A WITH exception`` is one find, by its identifier.

Defined results: a null or empty text has no licenses; repeated rows each have theirs; several licenses of one text are
several rows; sentences between those of a rule that are not known do not matter, known ones out of order do; an identifier that the table of SPDX
identifiers lacks is not reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import named

_AS_PUBLISHED = "you can redistribute it and or modify it under the terms of the gnu {kind}general public license{version} as published by the free software foundation"
_EITHER = "either version {version} of the license or at your option any later version"

# --- Fixed values: sentences of public license texts, in normal form, and rules over them ---------
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gnu-program": "this program is free software",
    "gnu-library": "this library is free software",
    "gpl-terms": _AS_PUBLISHED.format(kind="", version=""),
    "gpl-terms-2-only": _AS_PUBLISHED.format(kind="", version=" version 2"),
    "gpl-terms-3-only": _AS_PUBLISHED.format(kind="", version=" version 3"),
    "gpl-terms-2": _AS_PUBLISHED.format(kind="", version="") + " " + _EITHER.format(version="2"),
    "gpl-terms-3": _AS_PUBLISHED.format(kind="", version="") + " " + _EITHER.format(version="3"),
    "lgpl-terms": _AS_PUBLISHED.format(kind="lesser ", version=""),
    "lgpl-terms-21": _AS_PUBLISHED.format(kind="lesser ", version="") + " " + _EITHER.format(version="2 1"),
    "lgpl-terms-3": _AS_PUBLISHED.format(kind="lesser ", version="") + " " + _EITHER.format(version="3"),
    "agpl-terms-3": _AS_PUBLISHED.format(kind="affero ", version="") + " " + _EITHER.format(version="3"),
    "either-2": _EITHER.format(version="2"),
    "either-21": _EITHER.format(version="2 1"),
    "either-3": _EITHER.format(version="3"),
    "reserved": "all rights reserved",
    "released-mit": "released under the mit license",
    "work-gpl-3": "this work is licensed under the gnu general public license version 3",
    "work-gpl-2": "this work is licensed under the gnu general public license version 2",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
}
RULES = {
    ("mit-grant", "mit-notice", "mit-warranty"): "MIT",
    ("bsd-use", "bsd-source", "bsd-binary", "bsd-names"): "BSD-3-Clause",
    ("bsd-use", "bsd-source", "bsd-binary"): "BSD-2-Clause",
    ("apache-notice", "apache-use", "apache-warranty"): "Apache-2.0",
    ("isc-grant",): "ISC",
    ("mpl-2",): "MPL-2.0",
    ("gnu-program", "gpl-terms", "either-2"): "GPL-2.0-or-later",
    ("gnu-program", "gpl-terms-2"): "GPL-2.0-or-later",
    ("gnu-program", "gpl-terms", "either-3"): "GPL-3.0-or-later",
    ("gnu-program", "gpl-terms-3"): "GPL-3.0-or-later",
    ("gnu-program", "gpl-terms-2-only"): "GPL-2.0",
    ("gnu-program", "gpl-terms-3-only"): "GPL-3.0",
    ("gnu-library", "lgpl-terms", "either-21"): "LGPL-2.1-or-later",
    ("gnu-library", "lgpl-terms-21"): "LGPL-2.1-or-later",
    ("gnu-library", "lgpl-terms", "either-3"): "LGPL-3.0-or-later",
    ("gnu-library", "lgpl-terms-3"): "LGPL-3.0-or-later",
    ("gnu-program", "agpl-terms-3"): "AGPL-3.0-or-later",
    ("reserved",): "All-Rights-Reserved",
    ("released-mit",): "MIT",
    ("work-gpl-3",): "GPL-3.0",
    ("work-gpl-2",): "GPL-2.0",
    ("cc-by-nc",): "CC-BY-NC-4.0",
    ("cc-by",): "CC-BY-4.0",
    ("cc-by-sa",): "CC-BY-SA-4.0",
}
#: Names under which texts say that they are licensed.
NAMES = {
    "mit license": "MIT", "apache license version 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "isc license": "ISC",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "mozilla public license version 2 0": "MPL-2.0",
    "gnu lesser general public license version 3": "LGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0",
}
#: SPDX identifiers that are reported, and the name under which where it is another.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
    "LGPL-3.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "EPL-2.0", "Zlib", "BSL-1.0", "0BSD",
)
SPDX_NAMES = {"gpl-2.0-only": "GPL-2.0", "gpl-3.0-only": "GPL-3.0", "lgpl-2.1-only": "LGPL-2.1", "lgpl-3.0-only": "LGPL-3.0", "agpl-3.0-only": "AGPL-3.0"}
#: Every known sentence contains one of these; single words, which no separator can break.
ANCHORS = ("licen", "permission", "reserved", "redistributi", "software")

# --- By rule: what is licensed, and where the text is, may stand around a name ---------------------
_SUBJECTS = ("", "this project is ", "this software is ", "this program is ", "this library is ", "this package is ", "this code is ", "this file is ")
_POINTERS = ("", " see license", " see the license file", " see the license file for details", " see license for details")
_NAMED = {
    f"named-{name}-{i}-{j}".replace(" ", "-"): (f"{subject}licensed under the {name}{pointer}", license_)
    for name, license_ in NAMES.items() for i, subject in enumerate(_SUBJECTS) for j, pointer in enumerate(_POINTERS)
}
ALL_SENTENCES = SENTENCES | {key: sentence for key, (sentence, _) in _NAMED.items()}
ALL_RULES = RULES | {(key,): license_ for key, (_, license_) in _NAMED.items()}
#: Identifiers of sentences are their numbers.
_NUMBERS = {key: n for n, key in enumerate(ALL_SENTENCES)}
#: A text in steps to its normal form: "|" ends a sentence, "/" is a line break within one; neither survives from the text itself.
STEPS = (
    (r"[|/]", " "), (r"\r\n?", "\n"), (r"spdx.license.identifier:[^\n]*", " "), (r"\bv[.][ \t]+([0-9])", r"v \1"), (r"[.!?;:]+([ \t\n]+|$)", "|"),
    (r"\n([^a-z0-9\n|]*\n)+", "|"), (r"\n", "/"), (r"[^a-z0-9|/]+", " "), (r" *([|/]) *", r"\1"),
)
SPDX_LINE = r"spdx.license.identifier:[ \t]*([^\n\r]*)"
SPDX_TOKEN = r"[a-z0-9][a-z0-9.+-]*( +with +[a-z0-9][a-z0-9.+-]*)?"


def rule_key(rule: tuple[str, ...]) -> str:
    return "".join(f"{_NUMBERS[key]};" for key in rule)


def rule_pattern() -> str:
    """Alternatives for all rules, those of most sentences first."""
    return "|".join(sorted(map(rule_key, ALL_RULES), key=lambda r: (-r.count(";"), r)))


def sentence_pattern(line_break: str) -> str:
    """Alternatives for all sentences, longest first, with spaces or line breaks between words."""
    return "|".join(s.replace(" ", line_break) for s in sorted(ALL_SENTENCES.values(), key=lambda s: (-len(s), s)))


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def identifiers(text: Column) -> Column:
    """The known sentences of a text, a number and a semicolon each, in order."""
    plain = reduce(lambda at, step: F.regexp_replace(at, step[0], step[1].replace("\\1", "$1")), STEPS, F.lower(text))
    plain = F.concat(F.lit("|"), F.trim(plain), F.lit("|"))
    known = _mapping({s: f"{_NUMBERS[key]};" for key, s in ALL_SENTENCES.items()})
    found = F.regexp_extract_all(plain, F.lit(f"(?<=[|/])({sentence_pattern('[ /]')})(?=[|/])"))
    return F.array_join(F.transform(found, lambda s: known[F.translate(s, "/", " ")]), "")


def spdx_names() -> dict[str, str]:
    return {i.lower(): SPDX_NAMES.get(i.lower(), i) for i in SPDX}


def expressions(text: Column) -> Column:
    """The licenses of a text's SPDX lines, in order; an exception stays with its license."""
    names = _mapping(spdx_names())
    lines = F.regexp_extract_all(F.lower(text), F.lit(SPDX_LINE), 1)
    tokens = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(SPDX_TOKEN), 0)))

    def name(token: Column) -> Column:
        parts = F.split(token, " +with +")
        of = F.try_element_at(names, parts[0])
        return F.when(F.size(parts) > 1, F.concat(of, F.lit(" WITH "), F.get(parts, F.lit(1)))).otherwise(of)

    return F.filter(F.transform(tokens, name), lambda n: n.isNotNull())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, license, matches)``: one row per row of ``docs`` and license found in it."""
    lowered = F.lower(named(text))
    maybe = reduce(Column.__or__, [F.contains(lowered, F.lit(a)) for a in ANCHORS])
    names = _mapping({rule_key(rule): license_ for rule, license_ in ALL_RULES.items()})
    found = F.transform(F.regexp_extract_all(identifiers(named(text)), F.lit(f"({rule_pattern()})")), lambda r: names[r])
    rows = docs.filter(maybe).select(named(doc_id).alias("doc_id"), F.concat(found, expressions(named(text))).alias("found"))
    return rows.select("doc_id", "found", F.explode(F.array_distinct("found")).alias("license")).select(
        "doc_id", "license", F.size(F.filter("found", lambda x: x == F.col("license"))).cast("long").alias("matches")
    )
