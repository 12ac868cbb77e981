"""Records of mixed shape as variants: fields that may be text, a number, an object or a list, read by what they are.

Expressions only: JSON text is parsed once (`parsed`, null if it is broken), and each accessor looks at the kind of what
stands at a path, so that a number where text is due, or an object where a list is due, is null and no error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where an artist may be named, in order; sizes of an image, best first.
ARTIST_KEYS = ("artist_name", "artistName", "artist", "artist_display_name", "artistDisplayName", "creator", "maker", "primary_artist", "primaryArtist")
IMAGE_SIZES = ("large", "detail", "full", "original", "medium")
KINDS = {"STRING": "text", "OBJECT": "object", "ARRAY": "list", "BOOLEAN": "flag"} | dict.fromkeys(("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"), "number")  #: of Spark's names of types
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def at(record: Column, path: str) -> Column:
    """What stands at a path; null if there is nothing, or something else on the way."""
    return F.try_variant_get(record, path, "variant")


def kind(value: Column) -> Column:
    """text, number, flag, object, list, or null for nothing and JSON's null."""
    names = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v)))
    return F.try_element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def clean(text: Column) -> Column:
    """Entities resolved, tags cut, white space collapsed; null for nothing."""
    resolved = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    bare = F.regexp_replace(resolved, r"<[^>]+>", " ")  # cuts nothing without both signs
    return F.nullif(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(""))


def raw_text(value: Column) -> Column:
    return let(value, lambda x: F.when(kind(x) == "text", F.try_variant_get(x, "$", "string")))


def text_at(record: Column, path: str) -> Column:
    return clean(raw_text(at(record, path)))


def list_at(record: Column, path: str) -> Column:
    """array<variant>; null if no list stands there."""
    return let(at(record, path), lambda x: F.when(kind(x) == "list", F.try_variant_get(x, "$", "array<variant>")))


def amount_at(record: Column, path: str) -> Column:
    """Text as a number, commas between thousands."""
    return F.replace(text_at(record, path), F.lit(","), F.lit("")).try_cast("double")


def scalar_text(value: Column) -> Column:
    """Text or a number as text."""
    return let(value, lambda x: F.when(kind(x).isin("text", "number"), F.nullif(F.trim(F.try_variant_get(x, "$", "string")), F.lit(""))))


def lot(response: Column, origin: str) -> Column:
    """The fields of an auction house's response for one lot, as a struct; null where the response holds no lot.

    origin: the site that lot addresses begin with.
    """
    return let(at(response, "$.data.lot"), lambda own: F.when(kind(own) == "object", let(_fields(own), lambda x: _derived(x, origin))))


def _fields(own: Column) -> Column:
    """What the lot says itself."""
    texts = {
        "lot_id": "$.lotId", "path": "$.slug", "lot_number": "$.lotNumber.lotNumber", "lot_number_type": "$.lotNumber.__typename", "estimate_type": "$.estimateV2.__typename", "accepts_bids": "$.auction.dates.acceptsBids",
        "goes_live": "$.auction.dates.goesLive", "published": "$.auction.dates.published", "closed": "$.auction.dates.closed", "auction_name": "$.auction.slug.name",
    }
    departments = F.filter(F.transform(list_at(own, "$.auction.departmentNames"), lambda x: F.nullif(F.trim(raw_text(x)), F.lit(""))), lambda x: x.isNotNull())
    others = {"estimate_low": amount_at(own, "$.estimateV2.lowEstimate.amount"), "estimate_high": amount_at(own, "$.estimateV2.highEstimate.amount"), "departments": F.nullif(F.array_join(departments, ", "), F.lit("")), "auction_year": scalar_text(at(own, "$.auction.slug.year"))}
    return F.struct(*(text_at(own, path).alias(n) for n, path in texts.items()), *(c.alias(n) for n, c in others.items()))


def _derived(x: Column, origin: str) -> Column:
    """A lot's fields with what follows from them."""
    seen = F.when(F.lower(x["lot_number_type"]) == "visiblelotnumber", True).when(F.lower(x["lot_number_type"]) == "hiddenlotnumber", False).when(x["lot_number_type"].isNull() & x["lot_number"].isNotNull(), True)
    on_request = F.when(x["estimate_type"].isNotNull(), F.lower(x["estimate_type"]) == "estimateuponrequest").when(x["estimate_low"].isNotNull() | x["estimate_high"].isNotNull(), False)
    day = lambda t: F.when(t.try_cast("timestamp").isNotNull(), F.substring(t, 1, 10).try_cast("date"))
    more = {
        "lot_number_visible": seen, "estimate_on_request": on_request, "auction_date": F.coalesce(day(x["goes_live"]), day(x["accepts_bids"]), day(x["published"])),
        "url": F.concat(F.lit(f"{origin}/en/buy/auction/"), x["auction_year"], F.lit("/"), x["auction_name"], F.lit("/"), x["path"]),
    }
    own = ("lot_id", "path", "lot_number", "lot_number_type", "estimate_low", "estimate_high", "estimate_type", "accepts_bids", "goes_live", "published", "closed", "departments", "auction_year", "auction_name")
    return F.struct(*(x[n].alias(n) for n in own), *(c.alias(n) for n, c in more.items()))


def _said(value: Column) -> Column:
    """The value as text if it counts as given (not null, empty, zero or false), else null."""

    def said(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        nothing = F.when(kind(x) == "number", text.try_cast("double") == 0).when(kind(x) == "flag", text == "false").otherwise(text.isin("", "{}", "[]"))
        return F.when(kind(x).isNotNull() & ~nothing, text)

    return let(value, said)


def _named(value: Column) -> Column:
    """Text, or an object's name or else its display name."""

    def named(x: Column) -> Column:
        first = at(x, "$.name")
        inner = F.when(_said(first).isNotNull(), raw_text(first)).otherwise(raw_text(at(x, "$.displayName")))
        return F.nullif(F.trim(F.when(kind(x) == "object", inner).when(kind(x) == "text", F.try_variant_get(x, "$", "string"))), F.lit(""))

    return let(value, named)


def artist_name(record: Column, keys: tuple[str, ...] = ARTIST_KEYS) -> Column:
    """The first key that names an artist: as text, as an object, or as a list's first entry."""
    entry = lambda x: F.when(kind(x) == "list", at(x, "$[0]")).otherwise(x)
    return let(record, lambda r: F.coalesce(*(_named(let(at(r, f"$.{k}"), entry)) for k in keys)))


def asset_urls(assets: Column, sizes: tuple[str, ...] = IMAGE_SIZES) -> Column:
    """Urls of an array<variant> of assets: an asset's own url if its type is an image's or open, else its best size; others are left out."""

    def url(asset: Column) -> Column:
        given = lambda *paths: F.coalesce(*(_said(at(asset, p)) for p in paths))
        fits = F.lower(F.coalesce(given("$.asset_type", "$.type"), F.lit(""))).isin("", "basic", "image")
        return F.coalesce(F.when(fits, given("$.image_url", "$.url", "$.imageUrl")), given(*(f"$.sizes.{s}" for s in sizes)))

    return F.coalesce(F.filter(F.transform(assets, url), lambda u: u.isNotNull()), F.array().cast("array<string>"))


def person_name(name: Column) -> Column:
    """struct(first, last): parted at the first comma (last name first) or at the last space; one word is a last name."""

    def parted(t: Column) -> Column:
        comma, words = F.instr(t, ","), F.split(t, " ")
        before, after = F.trim(F.substring_index(t, ",", 1)), F.trim(F.substr(t, comma + 1))
        first = F.when(comma > 0, F.nullif(after, F.lit(""))).when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
        last = F.when(comma > 0, F.when(before != "", before).otherwise(t)).otherwise(F.element_at(words, -1))
        return F.when(t.isNotNull(), F.struct(first.alias("first"), last.alias("last")))

    return let(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), parted)


def put_together(sources: list[dict[str, Column]]) -> dict[str, Column]:
    """One column for each name that a source has: the first source's value that is filled, as an empty text is not."""
    names = dict.fromkeys(n for s in sources for n in s)
    return {n: F.coalesce(*(F.nullif(F.trim(s[n]), F.lit("")) for s in sources if n in s)) for n in names}


# Registry pages


def contact(text: Column) -> Column:
    """struct(name, address, phone, email, website) of a contact line parted by ';' or line breaks.

    A machine reads one token after the other: a label (tel, e-mail, homepage) waits for the token behind it; a token
    with @ is the mail address while there is none, one that starts as a web address the site; the rest is an address
    if it holds five digits or a word of streets, else part of the name. A label at the end is such a rest.
    """
    tokens = F.filter(F.transform(F.split(text, r"[;\n]"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    n = F.size(tokens)
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (i + 1 == n).alias("last")))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    fields = ("wait", "phone", "email", "website", "names", "places")
    start = F.struct(*(v.alias(f) for f, v in zip(fields, (none, none, none, none, empty, empty), strict=True)))

    def step(state: Column, token: Column) -> Column:
        t, low = token["t"], F.lower(token["t"])
        label = F.when(~token["last"], F.when(low.isin(*CONTACT_LABELS["phone"]), "phone").when(low.isin(*CONTACT_LABELS["email"]), "email").when(low.isin(*CONTACT_LABELS["website"]), "website"))
        what = (
            F.when(state["wait"].isNotNull(), state["wait"])
            .when(t.contains("@") & state["email"].isNull(), "email")
            .when(t.startswith("http://") | t.startswith("https://"), "website")
            .when(label.isNotNull(), F.concat(F.lit("wait "), label))
            .when(t.rlike(r"\d{5}") | low.rlike(STREETS), "places")
            .otherwise("names")
        )

        def taken(what: Column) -> Column:
            wait = F.when(what.startswith("wait "), F.substr(what, F.lit(6)))
            keep = {f: F.when(what == f, t).otherwise(state[f]) for f in ("phone", "email", "website")}
            grow = {f: F.when(what == f, F.array_append(state[f], t)).otherwise(state[f]) for f in ("names", "places")}
            return F.struct(*(v.alias(f) for f, v in ({"wait": wait} | keep | grow).items()))

        return let(what, taken)

    def told(end: Column) -> Column:
        joined = lambda f: F.when(F.size(end[f]) > 0, F.array_join(end[f], "; "))
        return F.struct(joined("names").alias("name"), joined("places").alias("address"), end["phone"].alias("phone"), end["email"].alias("email"), end["website"].alias("website"))

    return F.when(text.isNotNull(), F.aggregate(numbered, start, step, told))


# Labels of contact fields, and words of streets as a pattern.
CONTACT_LABELS = {"phone": ("tel", "telefon", "phone"), "email": ("e-mail", "e mail", "email"), "website": ("homepage", "homepage:")}
STREETS = r"straße|str\.|talen|platz|road|rd\b|avenue|addr"


def listed(text: Column, parting: str = r"\s*[;,|]\s*") -> Column:
    """A text's entries, trimmed, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, parting), lambda t: F.trim(t)), lambda t: t != ""))


def keywords(tags: Column, *others: Column, parting: str = r"\s*[;,|]\s*") -> Column:
    """The tags' entries, or where there are no tags those of all the other fields, each once."""
    some = F.array_distinct(F.flatten(F.array(*(F.coalesce(listed(c, parting), F.array().cast("array<string>")) for c in others))))
    return F.when(F.coalesce(tags, F.lit("")) != "", listed(tags, parting)).otherwise(some)


def first_entry(text: Column, parting: str = r"\s*[;,|]\s*") -> Column:
    """The first entry, as of several kinds of loss; the whole text where nothing is parted."""
    return F.coalesce(F.get(listed(text, parting), F.lit(0)), F.nullif(F.trim(text), F.lit("")))


def year_as_date(text: Column) -> Column:
    """The first of January of the first year from 1000 to 2099 in a text."""
    return F.make_date(F.nullif(F.regexp_extract(text, r"(1\d{3}|20\d{2})", 1), F.lit("")).cast("int"), F.lit(1), F.lit(1))
