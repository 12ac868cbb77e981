"""Dates and places of a life in artist names: a tokeniser, an ordered grammar over kinds of tokens, presumed names, dates within a name.

Every token has a kind of one character, so that a text's kinds are a string as long as its tokens; a production is a
shape of kinds with the fields that its places and years fill. What no production knows is not understood (None), which
is different from understood and empty ({}).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

FIELDS = ("dob", "dod", "pob", "pod")

# Words of a kind, in German, English and French, without accents and dots.
BORN = frozenset(("b", "geb", "born", "ne", "nee", "ne en", "nee en"))
DIED = frozenset(("die", "died", "gest"))
ACTIVE = frozenset(("fl", "act", "active"))
ABOUT = frozenset(("circa", "ca", "c", "um"))
ROUGHLY = frozenset(("early", "late", "mid"))
CENTURY = frozenset(("century", "jahrhundert", "jh", "c"))
MONTHS = frozenset("januar februar marz april mai juni juli august september oktober november dezember january february march may june july october december".split())
SAME_PLACE = frozenset(("ebenda", "ebd"))
IGNORED = frozenset(("sr", "jr", "snr", "jnr", "wohl", "vielleicht", "wohl vielleicht", "wohl/vielleicht"))
NATIONS = frozenset("american austrian belgian british czech danish deutsch deutsche deutscher dutch english finnish flemish francais francaise franzosisch french german greek hungarian irish italian italienisch japanese niederlandisch norwegian osterreicher osterreichisch polish portuguese romanian russian schweizer scottish spanish swedish swiss".split())

_TOKEN = re.compile(r"\d{4}/\d{1,4}(?!\d)|\d+(?:st|nd|rd|th)?(?![^\W_])|\d+|[^\W\d_]+(?:[.'’/-]+[^\W\d_]+)*\.?|\S")
_FOLD = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def folded(word: str) -> str:
    return word.lower().translate(_FOLD).rstrip(".")


def _kind(token: str) -> str:
    """Y year, F fraction of years, O ordinal, D day, - dash, M month, N nation, W word; else the sign itself."""
    if token[0].isdigit():
        return "F" if "/" in token else "Y" if len(token) == 4 and token.isdigit() else "D" if len(token) <= 2 else "O" if not token.isdigit() and len(token) <= 4 else "#"
    if token in "-–—":
        return "-"
    if not token[0].isalpha():
        return token
    word = folded(token)
    return "M" if word in MONTHS else "N" if all(p in NATIONS for p in word.split("/")) else "W"


#: Shapes and the fields of their years and words in order; the first that fits is taken. W stands for words of any kind.
PRODUCTIONS = [
    (re.compile(shape), fields)
    for shape, fields in (
        ("WY-WY", ("pob", "dob", "pod", "dod")),
        ("YW-YW", ("dob", "pob", "dod", "pod")),
        ("YW-Y", ("dob", "pob", "dod")),
        ("YW", ("dob", "pob")),
        ("F", ("dob",)),
        (r"AY(?:-Y)?", ()),
        (r"W,?Y-Y\??", ("pob", "dob", "dod")),
        (r"W,?Y-\??", ("pob", "dob")),
        ("W,?Y", ("pob", "dob")),
        ("Y-Y,?W", ("dob", "dod", "pod")),
        ("F-[FY]|Y-F", ("dob", "dod")),
        (r"Y-D\.?MY", ("dob", "dod")),
        (r"Y-Y\??", ("dob", "dod")),
        (r"(Y-Y)[^-].*", ("dob", "dod")),
        (r"Y-\??", ("dob",)),
        ("Y", ("dob",)),
        (r"[OD](?:/[OD])?\.?C\.?", ()),
    )
]


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token), without what says nothing about a life."""
    found = [(_kind(t), t) for t in _TOKEN.findall(text)]
    out: list[tuple[str, str]] = []
    for i, (kind, token) in enumerate(found):
        word, after = folded(token), found[i + 1][0] if i + 1 < len(found) else ""
        if kind == "W" and (word in ROUGHLY or word in ABOUT and after in "YFDO" and after):
            continue
        if word in DIED and after == "Y":
            out.append(("-", "-"))
        elif word == "to" and out and out[-1][0] in "YFDO" and after and after in "YFDO":
            out.append(("-", "-"))
        elif word in ACTIVE and after == "Y" and not out:
            out.append(("A", token))
        elif word in CENTURY and out and out[-1][0] in "OD.":
            out.append(("C", token))
        else:
            out.append((kind, token))
    kinds = "".join(k for k, _ in out)
    if m := re.search(r"[OD]-[OD]", kinds):  # a range of days or centuries: its first
        del out[m.start() + 1 : m.end()]
    if kinds.endswith("Y/"):
        out.pop()
    return [a for i, a in enumerate(out) if not (a[0] == "-" and i and out[i - 1][0] == "-")]


def _without_lead(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without signs and words of birth in front."""
    while tokens and (tokens[0][0] == "*" or folded(tokens[0][1]) in BORN | {"wohl"}):
        tokens = tokens[2 if len(tokens) > 1 and folded(tokens[0][1]) in ("ne", "nee") and folded(tokens[1][1]) == "en" else 1 :]
    return tokens


def life(text: str) -> dict[str, str] | None:
    """The fields that a parenthesis fills; None if it is not understood."""
    text = re.sub(r"(?i),?\s*(?:attributed\s+to|attr(?:ib)?\.?)\s*$", "", text.strip())
    if not re.search(r"\d", text) or folded(text) in IGNORED:
        return {}
    tokens = _without_lead(_tokens(text))
    while tokens and tokens[0][0] == "N" and len(tokens) > 1:
        tokens = _without_lead(tokens[2:] if tokens[1][0] == "," else tokens[1:])
    if not any(t[0].isdigit() for _, t in tokens):
        return {}
    kinds = "".join("W" if k in "NM" and not (k == "M" and i and tokens[i - 1][0] in "D.") else k for i, (k, _) in enumerate(tokens))
    for shape, fields in PRODUCTIONS:
        if m := shape.fullmatch(kinds):
            stop = m.end(1) if shape.groups else len(kinds)
            filling = [(k, t) for k, t in tokens[:stop] if k in "YFWN" or k == "M" and "M" not in kinds]
            found = {f: t for f, (k, t) in zip(fields, filling, strict=False) if k != "N"}
            if folded(found.get("pod", "")) in SAME_PLACE:
                found["pod"] = found.get("pob", found["pod"])
            return found
    return None


def presumed(text: str) -> tuple[str | None, dict[str, str]]:
    """Name and fields of "presumably ..." in parentheses: name tokens up to the first year, then a life."""
    words = re.sub(r"(?i)^wohl\s+", "", text.strip()).lstrip("* ").split()
    words = [w for w in words if folded(w) not in (BORN - {"b"}) | (ABOUT - {"c"}) and w not in ("b.", "c.")]
    at = next((i for i, w in enumerate(words) if re.match(r"\*?\d{4}", w)), len(words))
    name, rest = words[:at], " ".join(words[at:])
    found = (life(rest) if rest else {}) or {}
    if not name:
        return None, found
    if not all(re.fullmatch(r"[\w.\-'/]+", w) and not w.isdigit() and folded(w) not in NATIONS for w in name):
        return None, {}
    if rest and not found:
        years = re.findall(r"\d{4}", rest)
        found = {"dob": years[0]} | ({"dod": years[-1]} if len(years) > 1 else {}) if years else {}
    return " ".join(name), found


def shortens(short: str, full: str) -> bool:
    """Whether a token is an initial or a cut form of another."""
    own, other = short.upper(), full.upper()
    if own.endswith("."):
        return 0 < len(own) - 1 < len(other) and other.startswith(own[:-1])
    return "-" in full and len(own) < len(other) and other.startswith(own)


def _either(a: str, b: str) -> str | None:
    """The fuller of two forms of one token; None if they are of two tokens."""
    if a.upper() == b.upper() or shortens(b, a):
        return a
    if shortens(a, b):
        return b
    return a if "-" in b and a[:1].upper() == b[:1].upper() else None


def fused(name: str, other: str) -> str | None:
    """A name with its initials and gaps filled from a presumed form; None if the two do not go together."""
    own, more = name.split(), other.split()
    if not own or not more:
        return None
    if len(own) == len(more):
        both = [_either(a, b) for a, b in zip(own, more, strict=True)]
        return None if None in both else " ".join(both)
    if len(own) == 1:
        alone, last = own[0], more[-1]
        if last.upper() == alone.upper() or shortens(last, alone):
            return " ".join([*more[:-1], alone])
        initial = alone.rstrip(".")
        fits = len(initial) == 1 and initial.isalpha() and any(w[:1].upper() == initial.upper() for w in more)
        return other if fits else None
    if len(more) < len(own):
        out, free = list(own), set(range(len(own)))
        for word in more:
            at = next((i for i in sorted(free) if shortens(own[i], word)), None)
            if at is not None:
                out[at] = word
                free.remove(at)
        return " ".join(out) if len(free) < len(own) else None
    first, last = _either(own[0], more[0]), _either(own[-1], more[-1])
    if first and last:
        return " ".join([first, *more[1:-1], last])
    head, tail = more[: -len(own)], more[-len(own) :]
    return " ".join([*head, *own]) if all(map(shortens, tail, own)) else None


def parenthesised(text: str) -> tuple[str, dict[str, str], str | None]:
    """The text without parentheses, the fields that they fill (the first of each), and a presumed name."""
    found: dict[str, str] = {}
    name = None
    for inner in re.findall(r"\(([^)]*)\)", text):
        if re.match(r"(?i)wohl\s+\S", inner.strip()) and folded(inner.strip()) not in IGNORED:
            other, own = presumed(inner)
            name = name or other
        else:
            own = life(inner) or {}
        found = own | found
    return re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", text)).strip(" ,"), found, name


_TAIL = re.compile(r"(?:,?\s+(\d{4})\s*[-–—]\s*(\d{4})?|,?\s+\*\s*(\d{4})|,\s*(\d{4}))\s*$")
_SIGN = re.compile(r"[,\s]*([*†])\s*(\d{4})(?:\s+([\w.\-'/]+))?")


def inline(name: str, found: dict[str, str]) -> tuple[str, dict[str, str]]:
    """A name without the dates that stand in it, and the fields with those filled that were open."""
    found = dict(found)
    if m := _TAIL.search(name):
        born, died = m[1] or m[3] or m[4], m[2]
        found = {k: v for k, v in (("dob", born), ("dod", died)) if v} | found
        name = name[: m.start()].strip(" ,")
    for sign, year, place in (("*", "dob", "pob"), ("†", "dod", "pod")):
        if m := next((m for m in _SIGN.finditer(name) if m[1] == sign), None):
            found.setdefault(year, m[2])
            where = found.get("pob") if m[3] and sign == "†" and folded(m[3]) in SAME_PLACE else m[3]
            if where:
                found.setdefault(place, where)
            name = re.sub(r"\s{2,}", " ", name[: m.start()] + name[m.end() :]).strip(" ,")
    commas = [i for i, c in enumerate(name) if c == ","]
    if commas:
        at = commas[min(1, len(commas) - 1)]
        if own := life(name[at + 1 :].strip()):
            name, found = name[:at].strip(), own | found
    return name, found


STRUCT = StructType([StructField("understood", BooleanType()), *(StructField(n, StringType()) for n in ("name", *FIELDS))])


def _column(f):
    """An Arrow function that works out each different text of a batch once."""

    @F.pandas_udf(STRUCT)
    def run(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for t in texts:
            if t not in known:
                name, found = f(t) if t is not None else (None, None)
                known[t] = (found is not None, name, *((found or {}).get(k) for k in FIELDS))
            rows.append(known[t])
        return pd.DataFrame(rows, columns=["understood", "name", *FIELDS])

    return run


def _presumed(text: str) -> tuple[str | None, dict[str, str]]:
    """"A. Name (wohl Anton Name 1900 Ort)" with the initials filled."""
    name, found, other = parenthesised(text)
    return (other and fused(name, other)) or name, found


life_dates = _column(lambda text: (None, life(text)))
presumed_names = _column(_presumed)
inline_dates = _column(lambda text: inline(text, {}))
