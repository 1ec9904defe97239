"""Structured answers of models: the first JSON block of a text, checked against a schema, or the reason why not."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED = "value string, reason string"
#: Names of JSON types in a schema, with what they are in Python.
TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def block_end(text: str, start: int) -> int | None:
    """Where the block that opens at ``start`` is closed: brackets balance outside of strings; none if it is cut off or closed wrongly."""
    open_: list[str] = []
    quoted = escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_.pop() != c:
                return None
            if not open_:
                return i + 1
    return None


def first_block(text: str | None) -> tuple[Any, str | None]:
    """The first JSON object or array of a text, with fences and prose around it left aside, and why there is none."""
    if not text or not text.strip():
        return None, "empty"
    cut = False
    at = min((i for c in "{[" if (i := text.find(c)) >= 0), default=-1)
    while at >= 0:
        end = block_end(text, at)
        if end is None:
            cut = True
        else:
            try:
                return json.loads(text[at:end]), None
            except ValueError:
                pass  # braces of prose: look further inside and behind
        at = min((i for c in "{[" if (i := text.find(c, at + 1)) >= 0), default=-1)
    return None, "cut_off" if cut else "no_json"


def refusal(value: Any, schema: dict, path: str = "$") -> str | None:
    """Why a value is not of a schema (type, enum, required, properties, additionalProperties, items), by path; none if it is."""
    kind = schema.get("type")
    if kind in TYPES and (not isinstance(value, TYPES[kind]) or kind in ("number", "integer") and isinstance(value, bool)):
        found = next(k for k, t in TYPES.items() if isinstance(value, t) and (k != "number" or not isinstance(value, bool)) and not (isinstance(value, bool) and k != "boolean"))
        return f"{path}: expected {kind}, got {found}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if lacking := [k for k in schema.get("required", ()) if k not in value]:
            return f"{path}: missing {lacking[0]}"
        if schema.get("additionalProperties") is False and (extra := sorted(set(value) - set(known))):
            return f"{path}: unexpected {extra[0]}"
        return next((r for k, s in known.items() if k in value and (r := refusal(value[k], s, f"{path}.{k}"))), None)
    if isinstance(value, list) and "items" in schema:
        return next((r for i, x in enumerate(value) if (r := refusal(x, schema["items"], f"{path}[{i}]"))), None)
    return None


def parse_answer(answer: Column, schema: dict) -> Column:
    """struct(value, reason): the answer's JSON as text if it is of the schema, else null and the reason."""

    def parse(answers: pd.Series) -> pd.DataFrame:
        rows = []
        for text in answers:
            value, reason = first_block(text)
            reason = reason or refusal(value, schema)
            rows.append((None if reason else json.dumps(value, ensure_ascii=False), reason))
        return pd.DataFrame(rows, columns=["value", "reason"], dtype=object)

    parse.__annotations__ = {"answers": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(parse, PARSED)(answer)
