"""The per-value helpers Spark has no expression for, as Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from logloom.functions import fixed_values as fv

_ASTRAL = "[\\x{10000}-\\x{10FFFF}]"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def dashed(path: Column) -> Column:
    """Every character outside [A-Za-z0-9] becomes a dash (two above the basic plane)."""
    return F.regexp_replace(F.regexp_replace(path, _ASTRAL, "--"), "[^a-zA-Z0-9]", "-")


def slug(path: Column) -> Column:
    """Directory slug of a path, NFC first. Meant for distinct paths, not for rows."""
    return dashed(nfc(path))


_PHASE = T.StructType([T.StructField("title", T.StringType()), T.StructField("detail", T.StringType())])
WORKFLOW_META = T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
                              T.StructField("phases", T.ArrayType(_PHASE))])
_LEXEME = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|[{}\[\]]""", re.S)
_FIELD = r"""\b%s\s*:\s*(?:'((?:\\.|[^'\\])*)'|"((?:\\.|[^"\\])*)"|`((?:\\.|[^`\\])*)`)"""
_PAIRS = {"{": "}", "[": "]"}


def _balanced(src: str, start: int) -> str | None:
    """Text from an opening brace to its partner, ignoring braces in string literals."""
    opener, depth = src[start], 0
    for m in _LEXEME.finditer(src, start):
        if m.group() == opener:
            depth += 1
        elif m.group() == _PAIRS[opener]:
            depth -= 1
            if depth == 0:
                return src[start:m.end()]
    return None


def _field(block: str, key: str) -> str | None:
    m = re.search(_FIELD % key, block, re.S)
    return next((g for g in m.groups() if g is not None), None) if m else None


def _objects(block: str) -> list[str]:
    found, at = [], block.find("{")
    while at >= 0:
        entry = _balanced(block, at)
        if entry is None:
            break
        found.append(entry)
        at = block.find("{", at + len(entry))
    return found


def read_workflow_meta(script: str | None) -> dict:
    blank = {"name": None, "description": None, "phases": []}
    start = re.search(r"export const meta[^{]*", script or "")
    if not start or start.end() >= len(script):
        return blank
    block = _balanced(script, start.end())
    if block is None:
        return blank
    listed = re.search(r"\bphases\s*:[^\[]*", block)
    phases = _balanced(block, listed.end()) if listed and listed.end() < len(block) else None
    rows = [{"title": _field(o, "title"), "detail": _field(o, "detail")} for o in _objects(phases or "")]
    head = block.replace(phases, "", 1) if phases else block
    return {"name": _field(head, "name"), "description": _field(head, "description"),
            "phases": [r for r in rows if r["title"] is not None]}


@F.pandas_udf(WORKFLOW_META)
def workflow_meta(script: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_workflow_meta(s) for s in script], columns=["name", "description", "phases"])


def _scrubbed(value, key: str, framed: bool, home: str, slugged: str):
    if isinstance(value, list):
        return [_scrubbed(v, key, False, home, slugged) for v in value]
    if isinstance(value, dict):
        frame = value.get("kind") == fv.FRAME_KIND
        return {k: _scrubbed(v, k, frame, home, slugged) for k, v in value.items() if not re.search(fv.SECRET_KEYS, k)}
    if not isinstance(value, str):
        return value
    if key == fv.LINK_KEY:
        return fv.LINK_STANDIN
    if framed and key in fv.FRAME_STANDINS:
        return fv.FRAME_STANDINS[key]
    if key in fv.PROSE_KEYS:
        return key if value else ""
    over, to = (fv.ARGUMENT_CHARS, fv.ARGUMENT_HEAD) if key in fv.ARGUMENT_KEYS else (fv.TITLE_CHARS, fv.TITLE_CHARS) if key == "title" else (len(value), 0)
    value = value[:to] + "…" if len(value) > over else value
    return value.replace(home, fv.HOME_STANDIN).replace(slugged, fv.HOME_SLUG_STANDIN)


def scrubbed_json(text: Column, key: str, home: str, slugged: str) -> Column:
    """JSON text with the redaction rules applied to whatever fields it has, at any depth; what is no JSON, or
    too deep to be read, becomes an empty object."""
    @F.pandas_udf(T.StringType())
    def scrub(s: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            try:
                return json.dumps(_scrubbed(json.loads(v), key, False, home, slugged), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return "{}"
        return s.map(one, na_action="ignore")
    return scrub(text)
