"""Details out of page markup by what elements are and bear, and lots out of the objects that scripts assign.

A page is read once for all picks: a pick names an element (`tag.class#id[attribute=value]`, any part of it), one around
it, and what to take. Each pick gives its first value that is not blank, within each element around it. Picks of one
field are tried in order. A page is held in one task, its values are rows; what joins them is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.functions import jsontext, records

ALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())  #: elements without an end
_PART = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]")
AUCTION_KEYS = ("sale_id", "sale_number", "sale_room_code", "sale_location")  # fixed values


@dataclass(frozen=True)
class Element:
    """One element as a page is looked through for it."""

    text: str

    @cached_property
    def parts(self) -> tuple[str, frozenset[str], dict[str, str | None]]:
        tag, marks, attributes = "", set(), {}
        for kind, name, attribute, value in _PART.findall(self.text):
            if attribute:
                attributes[attribute] = value or None
            elif kind == "#":
                attributes["id"] = name
            elif kind == ".":
                marks.add(name)
            else:
                tag = name
        return tag, frozenset(marks), attributes

    def fits(self, tag: str, marks: frozenset[str], attributes: dict[str, str | None]) -> bool:
        own, some, wanted = self.parts
        return (not own or own == tag) and some <= marks and all(a in attributes and (v is None or attributes[a] == v) for a, v in wanted.items())


@dataclass(frozen=True)
class Pick:
    """field: what it is for; within: an element that must be around it; attribute: taken instead of the text; joint: between the texts of its elements."""

    field: str
    element: str
    within: str = ""
    attribute: str = ""
    joint: str = " "


class _Page(HTMLParser):
    """Values as (pick, item, text). item: which of the elements around, counted from 1, 0 where none is asked for."""

    def __init__(self, picks: tuple[Pick, ...]):
        super().__init__(convert_charrefs=True)
        self.picks = [(p, Element(p.element)) for p in picks]
        self.around = {p.within: Element(p.within) for p in picks if p.within}
        self.items = dict.fromkeys(self.around, 0)
        self.inside: dict[str, list[int]] = {w: [] for w in self.around}
        self.stack: list[tuple[str, list[str], list[int]]] = []  # a tag, what it is around, picks that it opened
        self.names: dict[str, int] = {}
        self.open: dict[int, tuple[int, list[str]]] = {}
        self.out: dict[tuple[int, int], str] = {}

    def _keep(self, pick: int, item: int, texts: list[str]) -> None:
        if text := self.picks[pick][0].joint.join(x for t in texts if (x := " ".join(t.split()))):
            self.out.setdefault((pick, item), text)

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        marks = frozenset(attributes.get("class", "").split())
        about, opened = [], []
        for name, element in self.around.items():
            if tag not in ALONE and element.fits(tag, marks, attributes):
                self.items[name] += 1
                self.inside[name].append(self.items[name])
                about.append(name)
        for i, (pick, element) in enumerate(self.picks):
            if i in self.open or pick.within and not self.inside[pick.within] or not element.fits(tag, marks, attributes):
                continue
            item = self.inside[pick.within][-1] if pick.within else 0
            if (i, item) in self.out:
                continue
            if pick.attribute:
                self._keep(i, item, [attributes.get(pick.attribute, "")])
            elif tag not in ALONE:
                self.open[i] = (item, [])
                opened.append(i)
        if tag not in ALONE:
            self.stack.append((tag, about, opened))
            self.names[tag] = self.names.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.names.get(tag):  # one that nothing opened closes nothing
            while self._shut() != tag:
                pass

    def _shut(self) -> str:
        tag, about, opened = self.stack.pop()
        self.names[tag] -= 1
        for name in about:
            self.inside[name].pop()
        for i in opened:
            self._keep(i, *self.open.pop(i))
        return tag

    def handle_data(self, data):
        if self.open and not (self.stack and self.stack[-1][0] in ("script", "style")):
            for _, texts in self.open.values():
                texts.append(data)

    def values(self, page: str | None) -> list[tuple[int, int, str]]:
        self.feed(page or "")
        self.close()
        while self.stack:
            self._shut()
        return [(i, item, text) for (i, item), text in self.out.items()]


def page_values(pages: DataFrame, picks: tuple[Pick, ...], key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, field, pick, item, value): what each pick found. pick: its place among all. Null and empty pages give nothing."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, picks[i].field, i, item, text) for k, m in zip(frame[key], frame[markup], strict=True) for i, item, text in _Page(picks).values(m)]
            yield pd.DataFrame(rows, columns=[key, "field", "pick", "item", "value"])

    return pages.select(key, markup).mapInPandas(run, f"`{key}` {kind}, field string, pick int, item int, value string")


def fields(values: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, value): the first pick that found something, in its first element."""
    return values.groupBy(key, "field").agg(F.min_by("value", F.struct("pick", "item")).alias("value"))


def sections(values: DataFrame, head: str, body: str, names: dict[str, str], key: str = "page_id") -> DataFrame:
    """(key, field, value): bodies by the field that their head, in lower case, stands for; the last of a field counts. Both picks must ask for one element around them."""
    best = lambda field: F.min_by("value", F.when(F.col("field") == field, F.col("pick")))
    each = values.where(F.col("field").isin(head, body)).groupBy(key, "item").agg(F.lower(best(head)).alias("head"), best(body).alias("body"), F.countDistinct("field").alias("n")).where("n = 2")
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    named = each.select(key, "item", F.try_element_at(known, F.col("head")).alias("field"), "body").where("field is not null")
    return named.groupBy(key, "field").agg(F.max_by("body", "item").alias("value"))


def assigned_objects(pages: DataFrame, patterns: dict[str, str], key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, a column for each pattern): the first object that a script assigns to a name of the pattern, as text; null without one or if its braces do not end. A row for each page."""
    kind = pages.schema[key].dataType.simpleString()
    found = {c: re.compile(rf"{p}\s*=\s*(?=\{{)") for c, p in patterns.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = {c: [jsontext.balanced(t, m.end()) if t is not None and (m := p.search(t)) else None for t in frame[markup]] for c, p in found.items()}
            yield pd.DataFrame({key: frame[key], **own})

    return pages.select(key, markup).mapInPandas(run, ", ".join([f"`{key}` {kind}", *(f"{c} string" for c in patterns)]))


def component_lots(pages: DataFrame, root: str, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, source, lot, sale): each page's lot out of `root.lotHeader_<number>`, else out of `root` itself; lot is JSON text, sale a map of texts.

    The first of data.lots counts and must be an object, as must be all on the way; null where neither has one. In `root`
    the sale is the lot's own, and what its auction says of the sale's number and place goes over it unless it is empty.
    """
    name = re.escape(root)
    empty = F.create_map().cast("map<string,string>")
    is_object = lambda x: F.coalesce(records.kind(x) == "object", F.lit(False))
    entries = lambda x: F.coalesce(F.from_json(F.to_json(F.when(is_object(x), x)), "map<string,string>"), empty)
    texts = assigned_objects(pages, {"header": rf"{name}\.lotHeader_\d+", "whole": name}, key, markup)
    x = texts.select(key, records.parsed(F.col("header")).alias("header"), records.parsed(F.col("whole")).alias("whole"))
    x = x.select(key, *(records.at(F.col(c), p).alias(n) for n, c, p in (("h", "header", "$.data.lots[0]"), ("h_sale", "header", "$.data.sale"), ("r", "whole", "$.lots.data.lots[0]"), ("told", "whole", "$.auction.data"))))
    x = x.withColumns({"told": F.map_filter(entries(F.col("told")), lambda k, v: k.isin(*AUCTION_KEYS) & ~v.isin("", "0", "false", "[]", "{}")), "own": entries(records.at(F.col("r"), "$.sale"))})
    own = F.map_filter("own", lambda k, v: ~F.map_contains_key("told", k))
    source = F.when(is_object(F.col("h")), "header").when(is_object(F.col("r")), "components")
    x = x.withColumns({"source": source, "sale": F.when(source == "header", entries(F.col("h_sale"))).when(source == "components", F.map_concat(own, "told"))})
    return x.select(key, "source", F.to_json(F.when(F.col("source") == "header", F.col("h")).when(F.col("source") == "components", F.col("r"))).alias("lot"), "sale")
