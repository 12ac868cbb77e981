"""Values out of catalogue text: money, numbers, dates, lengths, labels. Native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Centimetres of a unit.
CENTIMETRES = {"mm": 0.1, "cm": 1.0, "in": 2.54, "inch": 2.54, "inches": 2.54, '"': 2.54, "''": 2.54, "ft": 30.48, "feet": 30.48, "foot": 30.48, "'": 30.48}
# Words that part materials and techniques.
CONNECTIVES = ("and", "und", "mit", "over", "et", "auf", "über")
# Ranks of an image's size classes; others rank 0.
SIZE_CLASSES = {"extraextralarge": 5, "extra_large": 4, "extralarge": 4, "large": 3, "medium": 2, "small": 1}
_MONEY = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def nth(text: Column, pattern: str, group: int = 1, n: int = 1) -> Column:
    """The group of the n-th match, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(n))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def money(text: Column, n: int = 1) -> Column:
    """The n-th number, thousands grouped by commas."""
    return F.replace(nth(text, _MONEY, 0, n), F.lit(","), F.lit("")).try_cast("double")


def estimate(low: Column, high: Column, text: Column) -> Column:
    """struct(low, high): given amounts, else one or two numbers of the text, none if it is on request."""
    a, b = money(low), money(high)
    asked = F.lower(text).contains("request")
    x, y = money(text), F.coalesce(money(text, 2), money(text))
    given = a.isNotNull() | b.isNotNull()
    return F.struct(F.when(given, a).when(~asked, x).alias("low"), F.when(given, b).when(~asked, y).alias("high"))


def decimal(text: Column) -> Column:
    """The separator that comes last is the decimal one; a lone comma is decimal."""
    t = F.regexp_replace(text, "[^0-9,.-]", "")
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    has_comma, has_dot = t.contains(","), t.contains(".")
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(has_comma & (~has_dot | (comma > dot)), european).when(has_comma, F.replace(t, F.lit(","), F.lit(""))).otherwise(t).try_cast("double")


def integer(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9-]", "").try_cast("int")


def boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "ja"), True).when(t.isin("false", "0", "no", "nein"), False)


def any_date(text: Column) -> Column:
    """ISO, day.month.year, day month-name year, month-name day, year, or epoch seconds."""
    t = F.trim(text)
    formats = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "dd/MM/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy")
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.to_date(F.timestamp_seconds(t.try_cast("long"))))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats), epoch, F.substring(t, 1, 10).try_cast("date"))


def lot_number(text: Column) -> Column:
    """Without the word before it and edge signs; null if long, without a digit or with a word in it."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?i)^(?:los|lot)\s*", "")
    t = F.regexp_replace(t, r"^[#:\- ]+|[#:\- ]+$", "")
    return F.when((F.length(t) <= 24) & t.rlike(r"\d") & ~t.rlike("[A-Za-zÀ-ÿ]{5,}"), t)


def centimetres(text: Column) -> Column:
    """A number with a unit, or feet and inches, rounded to 3 decimals; null without a known unit."""
    t = F.trim(text)
    feet = r"""^(\d+(?:[.,]\d+)?)\s*(?:ft\.?|feet|foot|')\s*(\d+(?:[.,]\d+)?)\s*(?:in\.?|inch(?:es)?|"|'')$"""
    one = r"""^(\d+(?:[.,]\d+)?)\s*([A-Za-z]+|"|''|')\.?$"""
    number = lambda p, i: F.replace(nth(F.lower(t), p, i), F.lit(","), F.lit(".")).try_cast("double")
    unit = nth(F.lower(t), one, 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(v)) for u, v in CENTIMETRES.items()))
    return F.when(F.lower(t).rlike(feet), F.round(number(feet, 1) * 30.48 + number(feet, 2) * 2.54, 3)).otherwise(F.round(number(one, 1) * factor, 3))


def height_by_width(text: Column) -> Column:
    """struct(height, width, depth) of `H x W [x D]` in the text's own unit."""
    n = r"(\d+(?:[.,]\d+)?)"
    p = rf"(?i){n}\s*(?:cm|mm|in)?\s*[x×]\s*{n}(?:\s*(?:cm|mm|in)?\s*[x×]\s*{n})?"
    get = lambda i: F.replace(nth(text, p, i), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(get(1).alias("height"), get(2).alias("width"), get(3).alias("depth"))


def tokens(raw: Column) -> Column:
    """Materials or techniques of a text, lower-cased, each once, in order."""
    words = "|".join(CONNECTIVES)
    parts = F.split(F.lower(raw), rf"(?U)[/,;()]+|\b(?:{words})\b")
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: (p != "") & ~p.isin(*CONNECTIVES))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(kept))


def names_of(raw: Column) -> Column:
    """Names of a braced array literal, or of a list parted by the first of ; and | that occurs; commas part nothing."""
    t = F.trim(raw)
    braced = t.startswith("{") & t.endswith("}")
    inner = F.transform(F.regexp_extract_all(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(r'"((?:[^"\\]|\\.)*)"|([^,]+)'), F.lit(0)), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), '^"|"$', ""), r"\\(.)", "$1"))
    parts = F.when(braced, inner).when(t.contains(";"), F.split(t, ";")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.array(t))
    clean = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(clean)


def fitted(text: Column, size: int = 255) -> Column:
    """At most size characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.left(text, F.lit(size - 1))), F.lit("…"))).otherwise(text)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def slug_title(url: Column) -> Column:
    """The last part of a path as words, without a leading number."""
    part = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/*$", 1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(part), r"^\d+[-_]", ""), r"[-_]+", " ")))


def grouped(n: Column) -> Column:
    """An integer with dots between thousands."""
    return F.translate(F.format_number(n.cast("long"), 0), ",", ".")


def byte_size(n: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f TB", n / F.lit(1024.0**4))
    for i in range(3, 0, -1):
        out = F.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {units[i]}", n / F.lit(1024.0**i))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def short_number(c: Column) -> Column:
    """Two decimals at most, comma as decimal sign."""
    text = F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.?0+$", "")
    return F.when(c.isNotNull(), F.replace(text, F.lit("."), F.lit(",")))


def dimensions_label(width: Column, height: Column, raw: Column, frame_width: Column, frame_height: Column, diameter: Column, depth: Column) -> Column:
    size = lambda w, h: F.concat(short_number(w), F.lit(" x "), short_number(h), F.lit(" cm"))
    return F.coalesce(size(width, height), blank_to_null(raw), F.concat(F.lit("Rahmen: "), size(frame_width, frame_height)), F.concat(F.lit("Ø "), blank_to_null(diameter)), F.concat(F.lit("Tiefe: "), blank_to_null(depth)))


def safe_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def safe_path(path: Column) -> Column:
    return F.coalesce(~path.startswith("/") & ~F.array_contains(F.split(path, "[/\\\\]"), ".."), F.lit(False))


def flattened(entries: Column) -> Column:
    """A list's filled entries, white space collapsed, parted by bars; an empty text for none."""
    clean = F.transform(entries, lambda e: F.regexp_replace(F.regexp_replace(e, r"(?U)\s+", " "), "^ | $", ""))
    return F.coalesce(F.array_join(F.filter(clean, lambda e: e != ""), " | "), F.lit(""))


def canonical_path(path: Column, root: str, prefix: str) -> Column:
    """A stored file's path below prefix: paths below root are moved there, relative ones put there, other absolute ones kept."""
    own = F.regexp_replace(F.trim(path), r"^\./", "")
    moved = F.concat(F.lit(prefix), F.substring(own, F.lit(len(root) + 1), F.length(own)))
    there = (own == prefix) | own.startswith(f"{prefix}/")
    below = own.startswith(f"{root}/") if root else F.lit(False)
    return F.when(there, own).when(below, moved).when(own.startswith("/"), own).otherwise(F.concat(F.lit(f"{prefix}/"), own))


def best_rendition(renditions: Column) -> Column:
    """The url of the largest of array<struct<url, size, width, height>>: by size class, then area, then place; null without one."""
    rank = lambda size: F.coalesce(*(F.when(F.lower(size) == k, F.lit(n)) for k, n in SIZE_CLASSES.items()), F.lit(0))
    area = lambda r: F.coalesce(r["width"].cast("long") * r["height"].cast("long"), F.lit(0))
    scored = F.transform(renditions, lambda r, i: F.struct(rank(r["size"]).alias("rank"), area(r).alias("area"), (-i).alias("place"), r["url"].alias("url")))
    return F.nullif(F.array_max(scored)["url"], F.lit(""))


def rendition_urls(images: Column) -> Column:
    """Each image's best rendition, each url once, in order."""
    return F.array_distinct(F.filter(F.transform(images, best_rendition), lambda u: u.isNotNull()))


def payload(columns: dict[str, Column], no_zeros: tuple[str, ...] = ()) -> Column:
    """JSON of what is filled: nulls and blank texts are left out, and zeros of the columns in no_zeros; {} where nothing is."""

    def filled(name: str, c: Column) -> Column:
        empty = F.trim(c.cast("string")) == ""
        if name in no_zeros:
            empty = empty | (c == 0)
        return F.when(~empty, c).alias(name)

    return F.to_json(F.struct(*(filled(k, c) for k, c in columns.items())), {"ignoreNullFields": "true"})
