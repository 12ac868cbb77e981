"""The segment of a page that a tab shows, told from the tab's own buttons, and its lines as description and provenance.

A page is read once: its texts are kept in one list, and an element that bears the tab's name is a span of it, so that
nested ones cost nothing. One Arrow function, linear in the page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from findling.functions.components import ALONE

# What an element's classes and name say for and against its being the segment.
CLASSES = ((("segment",), 100), (("tab",), 30), (("content", "pane"), 20), (("item",), -50), (("menu",), -75))
BUTTONS, BUTTON, CHILD = ("a", "button", "li", "span"), -120, 20
MOST_TEXT, TEXT_STEP = 500, 10  #: a point for every ten characters, up to fifty
HEADING = re.compile(r"\s*(?:provenienza|provenienz|provenance)\s*:?\s*(.*?)\s*", re.I | re.S)

SEGMENT = StructType([StructField("description", StringType()), StructField("provenance", StringType())])


class _Tabs(HTMLParser):
    """segments: [score without its text, first text, end of texts] of each element of the tab, in order."""

    def __init__(self, tab: str):
        super().__init__(convert_charrefs=True)
        self.tab, self.texts, self.elements, self.segments = tab, [], 0, []
        self.stack: list[tuple[str, int, int]] = []  # a tag, its segment or -1, elements up to it
        self.names: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        self.elements += 1
        own = -1
        if attributes.get("data-tab") == self.tab:
            classes = set(attributes.get("class", "").lower().split())
            score = sum(points for names, points in CLASSES if classes & set(names)) + BUTTON * (tag in BUTTONS)
            own = len(self.segments)
            self.segments.append([score, len(self.texts), len(self.texts)])
        if tag not in ALONE:
            self.stack.append((tag, own, self.elements))
            self.names[tag] = self.names.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.names.get(tag):
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        tag, own, elements = self.stack.pop()
        self.names[tag] -= 1
        if own >= 0:
            self.segments[own][0] += CHILD * (self.elements > elements)
            self.segments[own][2] = len(self.texts)
        return tag

    def handle_data(self, data):
        if data.strip() and not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.texts.append(data.strip())

    def points(self, segment: list[int]) -> int:
        score, first, end = segment
        size, at = -1, first
        while at < end and size < MOST_TEXT:
            size += 1 + len(self.texts[at])
            at += 1
        return score + min(max(size, 0), MOST_TEXT) // TEXT_STEP


def lines_of(page: str, tab: str) -> list[str]:
    """The lines of the best segment, the first among equals; none where no element bears the tab's name."""
    parser = _Tabs(tab)
    parser.feed(page)
    parser.close()
    while parser.stack:
        parser.shut()
    if not parser.segments:
        return []
    _, first, end = max(parser.segments, key=parser.points)
    return [line for text in parser.texts[first:end] for x in text.splitlines() if (line := x.strip())]


def told_apart(lines: list[str]) -> tuple[str, str | None]:
    """Description and provenance: what follows its heading in the same line, else the whole next line, each once whatever its case; the rest is description. The longest heading counts, so that an Italian one leaves no letter behind."""
    description, provenance, due = [], {}, False
    for line in lines:
        said = None if due else HEADING.fullmatch(line)
        if due:
            provenance.setdefault(line.casefold(), line)
        elif said and said[1]:
            provenance.setdefault(said[1].casefold(), said[1])
        elif not said:
            description.append(line)
        due = bool(said) and not said[1]
    return "\n".join(description), "\n".join(provenance.values()) or None


def tab_segment(tab: str):
    """(description, provenance) of a page's tab; '' and null for a page that is null, empty or without the tab."""

    @F.pandas_udf(SEGMENT)
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([told_apart(lines_of(p or "", tab)) for p in pages], columns=["description", "provenance"])

    return read
