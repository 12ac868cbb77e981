"""Arrays of objects out of a model's answer: known faults mended, then read whole, within its brackets, or object by object.

Mending is expressions. What JSON's own reader must judge runs in one Arrow function, linear in the answer but for its
readings: the whole text, the bracketed part, and each outermost pair of braces once.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed values, in order: what such answers get wrong again and again, and what it should be.
FAULTS = (
    (r"\](\s*)\)+(\s*)(?=[,\]])", "]$1}$2"),  # a parenthesis for the object's brace
    (r'"artist_(birth|death)_year":\s*"?-?\d+"?,?\s*', ""),  # the question's years repeated
    (r'"artist":\s*"[^"]*",?\s*', ""),  # the question's name repeated
    (r'(:\s*-?\d+)"(?=[,}])', "$1"),  # a quote after a number
    (r"\]\}\}(\s*)(?=[,\]])", "]}$1"),  # a brace too many
)

FOUND = StructType([StructField("way", StringType()), StructField("objects", ArrayType(StringType()))])


def mended(answer: Column) -> Column:
    """Without a fence around it and with the known faults put right."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(F.regexp_replace(text, "^```(json)?", ""), r"```$", "")
    for fault, right in FAULTS:
        text = F.regexp_replace(text, fault, right)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _read(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def outermost(text: str) -> list:
    """What stands in each outermost pair of braces, as far as it is JSON. Braces in strings count, as an answer that gets here is broken anyhow; after a closing brace too many no pair is outermost."""
    found, depth, start = [], 0, -1
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start >= 0:
                if (value := _read(text[start : m.end()])) is not None:
                    found.append(value)
                start = -1
    return found


def array_in(text: str) -> tuple[str, list] | None:
    """How an array was found, and its items."""
    if isinstance(value := _read(text), list):
        return "whole", value
    first, last = text.find("["), text.rfind("]")
    part = text[first : last + 1] if 0 <= first < last else text
    if part is not text and isinstance(value := _read(part), list):
        return "brackets", value
    return ("objects", found) if (found := outermost(part)) else None


@F.pandas_udf(FOUND)
def _found(text: pd.Series) -> pd.DataFrame:
    got = [None if t is None else array_in(t) for t in text]
    return pd.DataFrame({"way": [g and g[0] for g in got], "objects": [g and [json.dumps(x, ensure_ascii=False) for x in g[1]] for g in got]})


def recovered(answer: Column) -> Column:
    """(way, objects): the items as JSON text and how they were found (whole, brackets, objects); both null where there is no array, null or empty answers among them."""
    return _found(mended(answer))
