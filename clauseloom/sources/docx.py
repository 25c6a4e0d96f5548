"""DOCX bytes → one row per document with its paragraphs, styles and numbering as arrays.

Python only opens the archive and lists what is there; headings, numbering, blocks and paths are
relational (``operators.wordproc``).
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# --- Fixed values: namespaces and archive caps --------------------------------------------------
WORD = (
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "http://purl.oclc.org/ooxml/wordprocessingml/main",
)
WORD_2010 = "http://schemas.microsoft.com/office/word/2010/wordml"
MAX_ENTRIES, MAX_EXPANDED = 2_048, 100 * 1024 * 1024
HIDDEN = {"del", "delText", "instrText", "pPr"}

_PATH = "array<struct<table_index:bigint,row_index:bigint,cell_index:bigint>>"
_PROPS = "outline_level:bigint,num_id:string,num_level:bigint"
SCHEMA = (
    "doc_id string, reject_reason string, "
    f"paragraphs array<struct<paragraph_index:bigint,paragraph_id:string,table_path:{_PATH},style_id:string,{_PROPS},text:string>>, "
    f"styles array<struct<style_id:string,based_on:string,name:string,{_PROPS}>>, "
    "nums array<struct<num_id:string,abstract_id:string>>, "
    "levels array<struct<abstract_id:string,level:bigint,start:bigint,format:string,text:string>>, "
    "overrides array<struct<num_id:string,level:bigint,start_override:bigint,start:bigint,format:string,text:string>>"
)


def _local(element) -> str | None:
    """Local name of a Word element, None for any other namespace."""
    namespace, _, name = element.tag[1:].partition("}") if element.tag.startswith("{") else ("", "", "")
    return name if namespace in WORD else None


def _children(element, name: str) -> list:
    return [c for c in element if _local(c) == name]


def _child(element, name: str):
    found = _children(element, name) if element is not None else []
    return found[0] if found else None


def _attribute(element, name: str) -> str | None:
    return next((element.get(f"{{{ns}}}{name}") for ns in WORD if element.get(f"{{{ns}}}{name}") is not None), None)


def _val(element) -> str | None:
    return None if element is None else _attribute(element, "val")


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"0|[1-9][0-9]{0,14}", value) else None


def _properties(owner) -> dict:
    props = _child(owner, "pPr")
    outline = _number(_val(_child(props, "outlineLvl")))
    numbering = _child(props, "numPr")
    return {
        "outline_level": outline if outline is not None and outline <= 9 else None,
        "num_id": _val(_child(numbering, "numId")),
        "num_level": _number(_val(_child(numbering, "ilvl"))),
    }


def _unwrapped(element) -> Iterator:
    """Children with content controls and custom XML opened in place."""
    for child in element:
        name = _local(child)
        if name == "sdt":
            content = _child(child, "sdtContent")
            if content is not None:
                yield from _unwrapped(content)
        elif name == "customXml":
            yield from _unwrapped(child)
        elif name is not None:
            yield child


def _text(element) -> str:
    parts = []
    for child in element:
        name = _local(child)
        if name is None or name in HIDDEN:
            continue
        if name == "t":
            parts.append((child.text or "") + "".join(c.tail or "" for c in child))
        elif name == "tab":
            parts.append("\t")
        elif name in ("br", "cr"):
            parts.append("\n")
        else:
            parts.append(_text(child))
    return "".join(parts)


def _paragraph_id(element) -> str | None:
    value = element.get(f"{{{WORD_2010}}}paraId")
    return value.upper() if value and re.fullmatch(r"[0-9a-fA-F]{8}", value) else None


def _walk(container, path: list, found: list) -> None:
    tables = 0
    for element in _unwrapped(container):
        name = _local(element)
        if name == "p":
            text = unicodedata.normalize("NFC", re.sub("\r\n?", "\n", _text(element)))
            style = _val(_child(_child(element, "pPr"), "pStyle"))
            found.append(
                {"paragraph_index": len(found), "paragraph_id": _paragraph_id(element), "table_path": path,
                 "style_id": style, **_properties(element), "text": text}
            )
        elif name == "tbl":
            rows = [r for r in _unwrapped(element) if _local(r) == "tr"]
            for r, row in enumerate(rows):
                cells = [c for c in _unwrapped(row) if _local(c) == "tc"]
                for c, cell in enumerate(cells):
                    _walk(cell, [*path, {"table_index": tables, "row_index": r, "cell_index": c}], found)
            tables += 1


def _first_by(rows: list[dict], *keys: str) -> list[dict]:
    """The first row of each key wins; rows without a key are dropped."""
    kept: dict = {}
    for row in rows:
        key = tuple(row[k] for k in keys)
        if None not in key:
            kept.setdefault(key, row)
    return list(kept.values())


def _level(element) -> dict:
    start = _number(_val(_child(element, "start")))
    return {
        "start": 1 if start is None else start, "format": _val(_child(element, "numFmt")),
        "text": _val(_child(element, "lvlText")),
    }


def _open(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED:
            return {"reject_reason": "DOCUMENT_RESOURCE_LIMIT_EXCEEDED"}
        names = {e.filename for e in entries}

        def xml(path: str):
            return ElementTree.fromstring(archive.read(path)) if path in names else None

        document, styles, numbering = (xml(f"word/{n}.xml") for n in ("document", "styles", "numbering"))
    if document is None or _local(document) != "document" or len(_children(document, "body")) != 1:
        return {"reject_reason": "INVALID_DOCX"}
    paragraphs: list[dict] = []
    _walk(_child(document, "body"), [], paragraphs)
    style_rows = [
        {"style_id": _attribute(s, "styleId") or None, "based_on": _val(_child(s, "basedOn")),
         "name": _val(_child(s, "name")), **_properties(s)}
        for s in (_children(styles, "style") if styles is not None else [])
    ]
    abstracts = _children(numbering, "abstractNum") if numbering is not None else []
    numbers = _children(numbering, "num") if numbering is not None else []
    levels = [
        {"abstract_id": _attribute(a, "abstractNumId"), "level": _number(_attribute(lv, "ilvl")), **_level(lv)}
        for a in abstracts for lv in _children(a, "lvl")
    ]
    overrides = []
    for number in numbers:
        for o in _children(number, "lvlOverride"):
            own = _child(o, "lvl")
            overrides.append(
                {"num_id": _attribute(number, "numId"), "level": _number(_attribute(o, "ilvl")),
                 "start_override": _number(_val(_child(o, "startOverride"))),
                 **(_level(own) if own is not None else {"start": None, "format": None, "text": None})}
            )
    return {
        "paragraphs": paragraphs, "styles": _first_by(style_rows, "style_id"),
        "nums": _first_by(
            [
                {"num_id": _attribute(n, "numId"), "abstract_id": abstract} for n in numbers
                if (abstract := _val(_child(n, "abstractNumId"))) is not None
            ],
            "num_id",
        ),
        "levels": _first_by([v for v in levels if v["format"] is not None and v["text"] is not None], "abstract_id", "level"),
        "overrides": _first_by(overrides, "num_id", "level"),
    }


_EMPTY = {"reject_reason": None, "paragraphs": [], "styles": [], "nums": [], "levels": [], "overrides": []}


#: Paragraphs after which opened documents are handed on, so that a batch never holds many large ones.
HANDED_ON = 5_000


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, held = [], 0
        for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
            try:
                opened = _open(bytes(content))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, RuntimeError):
                opened = {"reject_reason": "INVALID_DOCX"}
            rows.append({"doc_id": doc_id, **_EMPTY, **opened})
            held += len(rows[-1]["paragraphs"])
            if held >= HANDED_ON:
                yield pd.DataFrame(rows, columns=["doc_id", *_EMPTY])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", *_EMPTY])


def read_docx(files: DataFrame) -> DataFrame:
    """``files(doc_id string, content binary)`` → one row per document; see ``SCHEMA``."""
    return files.select("doc_id", "content").mapInPandas(_read, SCHEMA)
