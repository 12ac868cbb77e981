"""JSON inside other text: repair, scanning for complete objects, balanced braces. Arrow functions, where no expression exists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DECODER = json.JSONDecoder()


def balanced(text: str, start: int) -> str | None:
    """The bracketed value that begins at start, quoted strings and escapes respected."""
    closing, stack, quote, i = {"{": "}", "[": "]"}, [], "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in closing:
            stack.append(closing[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return text[start : i + 1]
        i += 1
    return None


def objects(text: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of every JSON object, nested ones too."""
    out, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
            out.append((at, end, value))
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return out


def repaired(text: str) -> str:
    """Without fences and trailing commas, with double quotes and JSON's words."""
    t = re.sub(r"^\s*```\w*|```\s*$", "", text.strip()).strip()
    t = re.sub(r"\bNone\b|\bundefined\b|\bNaN\b", "null", t)
    t = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", t))
    t = re.sub(r"(?<=[{,\[:])\s*'([^'\"]*)'\s*(?=[,:}\]])", r'"\1"', t)
    return re.sub(r",\s*([}\]])", r"\1", t)


def array_of(text: str) -> list | None:
    """A JSON array: the whole repaired text, else the part in brackets, else its complete objects."""
    t = repaired(text)
    for part in (t, t[t.find("[") : t.rfind("]") + 1] if "[" in t else ""):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, list):
            return value
        if isinstance(value, dict):
            return [value]
    found, last = [], -1
    for start, end, value in objects(t):
        if start >= last:
            found.append(value)
            last = end
    return found or None


@F.pandas_udf(StringType())
def json_array(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None or (v := array_of(t)) is None else json.dumps(v, ensure_ascii=False), na_action="ignore")


def best_object(text: str, fields: tuple[str, ...]) -> dict | None:
    """The object with most of the fields filled, then present, then the last."""
    best, mark = None, (-1, -1, -1)
    for k, (_, _, value) in enumerate(objects(text)):
        if isinstance(value, dict) and any(f in value for f in fields):
            score = (sum(value.get(f) is not None for f in fields), sum(f in value for f in fields), k)
            if score >= mark:
                best, mark = {f: value.get(f) for f in fields}, score
    return best


def best_json(fields: tuple[str, ...]):
    @F.pandas_udf(StringType())
    def pick(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if (v := best_object(t, fields)) is None else json.dumps(v, ensure_ascii=False), na_action="ignore")

    return pick


def last_complete(text: str, keys: frozenset[str]) -> dict | None:
    """The last outermost object, if it has all keys and nothing but a closing fence follows."""
    outer, last = [], -1
    for start, end, value in objects(text):
        if start >= last:
            outer.append((end, value))
            last = end
    if not outer or not isinstance(outer[-1][1], dict) or not keys <= outer[-1][1].keys():
        return None
    return outer[-1][1] if text[outer[-1][0] :].strip() in ("", "```") else None


def accepted_json(keys: tuple[str, ...]):
    @F.pandas_udf(StringType())
    def accept(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if (v := last_complete(t, frozenset(keys))) is None else json.dumps(v, ensure_ascii=False), na_action="ignore")

    return accept


def script_value(name: str):
    """The object or array assigned to, or keyed by, a name in script text."""
    pattern = re.compile(rf"[\"']?\b{re.escape(name)}\b[\"']?\s*[:=]\s*(?=[{{\[])")

    @F.pandas_udf(StringType())
    def value(text: pd.Series) -> pd.Series:
        return text.map(lambda t: balanced(t, m.end()) if (m := pattern.search(t)) else None, na_action="ignore")

    return value


@F.pandas_udf(StringType())
def stable_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces."""
    return text.map(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")
