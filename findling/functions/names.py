"""Artist names: attribution, titles, life dates and places, inversion, casing. One Arrow function; give it distinct names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from findling.functions.lifedates import fused, inline, life, parenthesised

__all__ = ["artist_name", "cased", "life", "normal_name"]

# Name words of several kinds.
UNKNOWN = r"unbekannt\w*|unknown\w*|unidentified|anon(?:ym\w*|iem|ymous)?|n\.?\s*n\.?|artist unknown|künstler unbekannt"
ATTRIBUTIONS = r"zugeschrieben|zugeschr\.?|attributed to|attribué à|attr\.?(?: to)?|wohl|vermutlich|presumably|probably"
QUALIFIERS = r"nach|after|d'après|umkreis(?: von| des)?|circle of|werkstatt(?: von| des)?|workshop of|schule(?: von| des)?|school of|follower of|nachfolger(?: von| des)?|manner of|studio of|atelier de"
TITLES = r"prof\.?|professor|dr\.?|sir|dame|lord|lady|mr\.?|mrs\.?|ms\.?|baron|graf|gräfin|freiherr|maestro"
PARTICLES = frozenset("von van de der den del della di du da dos das le la zu zum zur ter ten y e und and af av".split())
COLLECTIVES = r"(?i)\b(?:manufaktur|manufacture|manufactory|werkstätte|school|schule|meister|master|company|gmbh|atelier|workshop|studio)\b"
SEVERAL = frozenset(("und", "and", "&", "or", "sowie"))
NATIONS = frozenset("german deutsch deutscher dutch niederländisch french französisch italian italienisch english englisch british american flemish austrian swiss spanish russian polish".split())


def cased(name: str) -> str:
    """Capitals at the start of words, particles small (but not in front), Mc and Mac, Roman numerals, hyphens; mixed case is left as it is."""

    def word(w: str, first: bool) -> str:
        if not (w.isupper() and len(w.strip(".")) > 1 or w.islower()):
            return w
        low = w.lower()
        if low in PARTICLES and not first:
            return low
        if re.fullmatch(r"[ivx]{2,}\.?", low) and w.isupper():
            return w
        if "-" in low:
            return "-".join(word(p.upper(), True) for p in w.split("-"))
        if m := re.fullmatch(r"(mc|mac)([a-zà-ÿ]{3,})", low):
            return m[1].capitalize() + m[2].capitalize()
        if m := re.fullmatch(r"([do]['’])([a-zà-ÿ]+)", low):
            return m[1].capitalize() + m[2].capitalize()
        return low[:1].upper() + low[1:]

    return " ".join(word(w, i == 0) for i, w in enumerate(name.split()))


def normal_name(raw: str | None) -> dict:
    """matched, name, dob, dod, pob, pod. Unknown artists match without a name; several artists, and text that is no name, do not match."""
    out: dict = dict.fromkeys(("name", "dob", "dod", "pob", "pod")) | {"matched": False}
    name = (raw or "").strip()
    if name.startswith("{"):
        try:
            value = json.loads(name)
            name = str(value.get("name") or "").strip() if isinstance(value, dict) else name
        except ValueError:
            pass
    if not name:
        return out
    name = re.sub(r"\s*\?+$", "", name)
    name, found, other = parenthesised(name)
    name, found = inline(name, found)
    out |= found
    if re.fullmatch(rf"(?i)(?:{UNKNOWN})(?:\b.*)?", name):
        return out | {"matched": True}
    name = re.sub(rf"(?i)^(?:{ATTRIBUTIONS})[:,]?\s+|[,\s]+(?:{ATTRIBUTIONS})\.?$", "", name)
    name = re.sub(r"(?i)[,\s]+(?:genannt|called|alias|(?:also )?known as)\s+.*$", "", name)
    if m := re.search(r"(?i)\bd\.\s*i\.\s+(.+)", name):
        name = m[1]
    name = re.sub(rf"(?i)^(?:(?:{TITLES})\s+)+", "", name)
    qualifier = ""
    if m := re.match(rf"(?i)({QUALIFIERS})\s+(?=\S)", name):
        qualifier, name = m[1] + " ", name[m.end() :]
    suffix = ""
    if m := re.search(r"(?i)[,\s]+(?:d\.?\s*([äj])\.?|the (elder|younger))$", name):
        suffix = " d.Ä." if (m[1] or "").lower() == "ä" or (m[2] or "").lower() == "elder" else " d.J."
        name = name[: m.start()]
    if (m := re.match(r"^(.*?),\s*(\w+)$", name)) and m[2].lower() in NATIONS:
        name = m[1]
    words = re.split(r"[\s,;/]+", name.lower())
    if not name or all(w in NATIONS for w in words):
        return out | {"matched": True}
    if not re.search(COLLECTIVES, name):
        if SEVERAL & set(words) or "/" in name or ";" in name or re.search(r"\d", name) or name.count(",") > 1:
            return out
        if m := re.match(r"^([^,]+),\s*([^,]+)$", name):
            name = f"{m[2]} {m[1]}"
        if not 1 <= len(name.split()) <= 6 or not re.fullmatch(r"[\w.’'\-\s]+", name):
            return out
    name = re.sub(r"(?<=[A-Za-z]\.)(?=[A-Za-zÀ-ÿ]{2})", " ", name)
    return out | {"matched": True, "name": qualifier + cased((other and fused(name, other)) or name) + suffix}


@F.pandas_udf(StructType([StructField("matched", BooleanType())] + [StructField(n, StringType()) for n in ("name", "dob", "dod", "pob", "pod")]))
def artist_name(raw: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = [known.setdefault(r, None) or known.update({r: normal_name(r)}) or known[r] for r in raw]
    return pd.DataFrame(rows, columns=["matched", "name", "dob", "dod", "pob", "pod"])
