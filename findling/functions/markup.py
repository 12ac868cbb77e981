"""Page markup: text, labels and values, links, structured data."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def plain_text(markup: Column) -> Column:
    """Without scripts and tags, entities resolved, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"(?U)\s+", " "))


def title_of(markup: Column) -> Column:
    return F.trim(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(markup: Column) -> Column:
    """Targets of links, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(markup, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1)))


def json_ld(markup: Column, kind: str) -> Column:
    """The first structured-data block of a type."""
    blocks = F.regexp_extract_all(markup, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$.@type") == kind), F.lit(1))


class _Pairs(HTMLParser):
    """Label and value texts: table rows, definition lists, and elements whose class names say label and value."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.label, self.out, self.title = [], [], None, [], ""

    def handle_starttag(self, tag, attrs):
        kinds = (dict(attrs).get("class") or "").lower()
        role = "label" if tag in ("th", "dt") or "label" in kinds else "value" if tag in ("td", "dd") or "value" in kinds else ""
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.append((tag, role))
        if role:
            self.text = []

    def handle_endtag(self, tag):
        while self.stack:
            name, role = self.stack.pop()
            if role:
                text = " ".join("".join(self.text).split())
                if role == "label":
                    self.label = text.rstrip(":").strip()
                elif self.label and text:
                    self.out.append((self.label, text))
                self.text = []
            if name == tag:
                break

    def handle_data(self, data):
        self.text.append(data)


def pairs_of(markup: str | None) -> list[tuple[str, str]]:
    parser = _Pairs()
    parser.feed(markup or "")
    parser.close()
    return parser.out


def label_values(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, position, label, value): a row for each labelled value of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, a, b) for k, m in zip(frame[key], frame[markup], strict=True) for i, (a, b) in enumerate(pairs_of(m))]
            yield pd.DataFrame(rows, columns=[key, "position", "label", "value"])

    return pages.select(key, markup).mapInPandas(run, f"`{key}` {kind}, position int, label string, value string")


def merged_fields(values: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, label, value): several values of a label joined by '; ' in order."""
    return values.groupBy(key, "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]), "; ").alias("value"))


def best_segment(words: dict[str, float]):
    """Of the blocks of a page the one whose words score highest, longer ones first among equals."""

    @F.pandas_udf(StringType())
    def pick(markup: pd.Series) -> pd.Series:
        def one(m: str) -> str | None:
            parser = _Blocks()
            parser.feed(m)
            parser.close()
            scored = [(sum(v for w, v in words.items() if w in b.lower()), len(b), b) for b in parser.blocks if b]
            return max(scored)[2] if scored else None

        return markup.map(one, na_action="ignore")

    return pick


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "div", "section", "li", "td", "h1", "h2", "h3", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("p", "div", "section", "li", "td", "h1", "h2", "h3", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] = " ".join((self.blocks[-1] + " " + data).split())


def as_json(pairs: list[tuple[str, str]]) -> str:
    return json.dumps(dict(pairs), ensure_ascii=False, sort_keys=True)
