"""Names and titles as sites print them: placeholders, marks and notes off, and whether a title only repeats the name.

All are expressions. Texts are compared folded: lower case, with the sharp s as two letters. Null and blank texts give
null; white space is collapsed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands where nobody or nothing is named, and how sites number lots.
NOBODY_FIRST = ("künstler", "unbekannter", "anonym")
NOBODY = ("undefined", "unknown", "n/a", "na")
NOBODY_SHORT = ("unbekannt", "unknown")
UNREAD_SIGNATURE = ("nicht identifizierte signatur", "signature non identifiée", "signature non identifiee", "unidentified signature")
UNTITLED = ("undefined", "ohne titel", "untitled", "n/a")
MARKS = r"\s*[*+#-]+$"
LOT_PREFIX = r"(?i)^\s*\d+[a-z]?([-/]\d+[a-z]?){0,4}(\s*(bis|ter))?\s*[-–—]\s*"


def spaced(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _any(tests) -> Column:
    return reduce(or_, tests)


def marked_artist(text: Column) -> Column:
    """Without the marks at its end; null for what says that the artist is not known."""
    name = F.nullif(F.trim(F.regexp_replace(spaced(text), MARKS, "")), F.lit(""))
    none = (folded(name) == "undefined") | _any(folded(name).startswith(w) for w in NOBODY_FIRST)
    return F.when(~none, name)


def signed_artist(text: Column) -> Column:
    """Null for placeholders and for notes that a signature was not read."""
    name = spaced(text)
    none = folded(name).isin(*NOBODY) | _any(folded(name).contains(w) for w in UNREAD_SIGNATURE)
    return F.when(~none, name)


def bracketed_artist(text: Column) -> Column:
    """Without what stands in brackets and parentheses; an empty pair of brackets is left."""
    name = spaced(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]+\]", ""), r"\([^)]*\)", ""))
    return F.when(~F.lower(name).isin(*NOBODY_SHORT), name)


def identity(text: Column) -> Column:
    """What two spellings of a name have in common: no marks, no parentheses, folded."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, MARKS, "")), r"\([^)]*\)", "")
    return folded(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def same_identity(a: Column, b: Column) -> Column:
    """False where either is null or empty."""
    return F.coalesce((a != "") & (b != "") & (identity(a) == identity(b)), F.lit(False))


def title(text: Column, artist: Column) -> Column:
    """Null for placeholders, without an artist, and where it only repeats the artist: a headline often is the name alone."""
    own = spaced(text)
    return F.when(artist.isNotNull() & ~folded(own).isin(*UNTITLED) & ~same_identity(own, artist), own)


def display_title(text: Column) -> Column:
    """Without the lot's number before it and punctuation around it; '' for null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LOT_PREFIX, ""), r"(?U)\s+", " "))
    return F.btrim(bare, F.lit(" ,.-;:|"))
