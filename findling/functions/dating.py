"""Datings: free text to years, structured mentions to intervals, interval unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_YEAR, HEDGE = 2026, 5

# Words of each kind, in German, English and French, without accents and dots.
KINDS = {
    "a": ("ca", "circa", "um", "around", "about", "vers", "env", "environ"),
    "d": ("dat", "datiert", "dated", "datato", "date", "datee"),
    "g": ("jahrhundert", "jhdt", "jh"),
    "e": ("century", "cent"),
    "f": ("siecle", "siecles", "siecl", "s"),
    "n": ("st", "nd", "rd", "th"),
    "o": ("er", "eme"),
    "c": ("c",),
    "x": ("e",),
    "w": ("wohl",),
}


# What parts of a century and of a decade span.
CENTURY_PARTS = {"full": (0, 100), "early": (0, 25), "q1": (0, 25), "q2": (25, 50), "mid": (25, 75), "first_half": (0, 50), "q3": (50, 75), "second_half": (50, 100), "late": (75, 100), "q4": (75, 100)}
DECADE_PARTS = {"full": (0, 10), "early": (0, 5), "mid": (3, 7), "late": (5, 10)}


def parse_dating(text: Column) -> Column:
    """struct(start, end, matched) of a text that is one dating as a whole, else not matched.

    The text is folded (case, accents, dashes, dots behind words) and cut to numbers, words, single spaces and signs.
    Each token has a kind of one letter: Y for four digits, T for two, D for one, those of KINDS for words, itself for
    a sign. The kinds in a row are the text's shape, which names the form; years are read off the numbers.
    """
    t = F.translate(F.lower(text), "–—éèê", "--eee")
    t = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), r"([a-z])\.+", "$1"), r" ?([-/]) ?", "$1")
    tokens = F.regexp_extract_all(t, F.lit(r"\d+|[a-z]+|."), F.lit(0))
    named = F.create_map(*(F.lit(x) for kind, words in KINDS.items() for w in words for x in (w, kind)))
    number = lambda w: w.rlike("^[0-9]+$")
    kind = lambda w: F.when(number(w), F.when(F.length(w) == 4, "Y").when(F.length(w) == 2, "T").when(F.length(w) == 1, "D").otherwise("#")).when(w.rlike("^[a-z]"), F.coalesce(F.try_element_at(named, w), F.lit("?w"))).otherwise(w)
    shape = F.array_join(F.transform(tokens, kind), "")
    numbers = F.transform(F.filter(tokens, number), lambda w: w.cast("long"))
    read = F.struct(shape.alias("shape"), F.get(numbers, F.lit(0)).alias("one"), F.get(numbers, F.lit(1)).alias("two"))
    return F.get(F.transform(F.array(read), _form), F.lit(0))  # a lambda, so that the text is read once for all forms


def _form(read: Column) -> Column:
    one, two = read["one"], read["two"]
    second = one - one % 100 + two
    joined, century = one * 100 + two, (one - 1) * 100
    forms = [
        ("Y[-/]Y", one, two),
        ("Y[-/]T", one, F.when(second < one, second + 100).otherwise(second)),
        ("d ?Y", one, one),
        (r"\[[DT]\]T|\([DT]\)T", joined, joined),
        ("T", one, one),
        (r"[DT]\.? ?g|[DT]n ?[ec]|[DT][ox]? ?f", century, century + 100),
        (r"Y ?\(\?\)", one, one),
        (r"(?:w )?[ac] Y(?: ?\((?:w )?[ac]\))?|Y ?\((?:w )?[ac]\)", one - HEDGE, one + HEDGE),
        ("Y", one, one),
    ]
    case = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("matched"))
    for form, start, end in reversed(forms):
        case = F.when(read["shape"].rlike(f"^(?:{form})$"), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(True).alias("matched"))).otherwise(case)
    return case


def expand_two_digits(parsed: Column, birth_year: Column) -> Column:
    """A bare two-digit year becomes the first such year not before the birth year; without one the bounds are null but matched."""
    year, short = parsed["start"], parsed["matched"] & (parsed["start"] < 100) & (parsed["start"] == parsed["end"])
    near = birth_year - birth_year % 100 + year
    full = F.when(near < birth_year, near + 100).otherwise(near).cast("int")
    return F.when(short, F.struct(full.alias("start"), full.alias("end"), F.lit(True).alias("matched"))).otherwise(parsed)


def _bounds(start: Column, part: Column, parts: dict) -> tuple[Column, Column]:
    named = F.coalesce(part, F.lit("full"))
    pick = lambda i: F.coalesce(*(F.when(named == k, F.lit(v[i])) for k, v in parts.items()))
    return start + pick(0), F.least(start + pick(1), F.lit(LAST_YEAR))


def century_bounds(n: Column, part: Column) -> tuple[Column, Column]:
    """Bounds of a part of the n-th century; a number from 100 on is a decade's first year. An unknown part gives a null start."""
    c, d = _bounds((n - 1) * 100, part, CENTURY_PARTS), _bounds(n, part, DECADE_PARTS)
    known = lambda b: (b[0], F.when(b[0].isNotNull(), b[1]))
    c, d = known(c), known(d)
    return F.when(n >= 100, d[0]).otherwise(c[0]), F.when(n >= 100, d[1]).otherwise(c[1])


def decade_bounds(n: Column, part: Column) -> tuple[Column, Column]:
    s, e = _bounds(n, part, DECADE_PARTS)
    return s, F.when(s.isNotNull(), e)


def resolve_mention(m: Column, birth_year: Column) -> Column:
    """struct(start, end) of a mention (kind, n1, n2, subdivision, subdivision2, hedge, truncate_start, truncate_end)."""
    n1, n2, kind = m["n1"], m["n2"], m["kind"]
    hedge = F.coalesce(m["hedge"], F.lit(False))
    none = F.lit(None).cast("int")
    c1, c2 = century_bounds(n1, m["subdivision"]), century_bounds(n2, m["subdivision2"])
    d1, d2 = decade_bounds(n1, m["subdivision"]), decade_bounds(n2, m["subdivision2"])
    digits = F.abs(n1)
    modulus = F.when(digits >= 1000, 10000).when(digits >= 100, 1000).otherwise(100)
    near = birth_year - birth_year % modulus + digits
    fragment = F.when(near < birth_year, near + modulus).otherwise(near)
    real = n1.between(100, LAST_YEAR)
    by = {
        "year": (F.when(real, n1 - F.when(hedge, HEDGE).otherwise(0)), F.when(real, n1 + F.when(hedge, HEDGE).otherwise(0))),
        "fragment": (fragment, fragment),
        "century": c1,
        "century_span": (F.when(c2[1].isNotNull(), c1[0]), F.when(c1[0].isNotNull(), c2[1])),
        "decade": d1,
        "decade_span": (F.when(d2[1].isNotNull(), d1[0]), F.when(d1[0].isNotNull(), d2[1])),
        "range": (F.when(n2.isNotNull() | ~hedge, n1 - F.when(hedge, HEDGE).otherwise(0)), F.when(n1.isNotNull() | ~hedge, n2 + F.when(hedge, HEDGE).otherwise(0))),
        "open_after": (n1, none),
        "open_before": (none, n1),
    }
    start = F.coalesce(*(F.when(kind == k, v[0]) for k, v in by.items()))
    end = F.coalesce(*(F.when(kind == k, v[1]) for k, v in by.items()))
    wrong = F.coalesce(start > end, F.lit(False))
    open_start, open_end = F.coalesce(m["truncate_start"], F.lit(False)), F.coalesce(m["truncate_end"], F.lit(False))
    return F.struct(F.when(~wrong & ~open_start, start).cast("int").alias("start"), F.when(~wrong & ~open_end, end).cast("int").alias("end"))


def unite(intervals: Column) -> Column:
    """struct(start, end) over the intervals that say something; one open bound leaves the whole open there."""
    some = F.filter(intervals, lambda i: i["start"].isNotNull() | i["end"].isNotNull())
    side = lambda f, pick: F.when(F.exists(some, lambda i: i[f].isNull()), F.lit(None)).otherwise(pick(F.transform(some, lambda i: i[f])))
    return F.struct(side("start", F.array_min).cast("int").alias("start"), side("end", F.array_max).cast("int").alias("end"))


def resolve_dating(mentions: Column, birth_year: Column) -> Column:
    return unite(F.transform(mentions, lambda m: resolve_mention(m, birth_year)))
