"""Licence notices by fuzzy short-notice search.

Text becomes words (ASCII letters lower-cased, digits, everything beyond ASCII) joined by single spaces. A notice
of n characters may differ by k = n // 10 edits: cut into k + 1 pieces, one of them must occur unchanged, so an
Aho-Corasick pass over all pieces finds every place where a notice can be. Around places that hold enough of
the notice's grams the regex library's bounded-error matching decides and gives span and edits. Places of one notice that overlap are searched as one.

Base labels are exact phrases (`PHRASES`); the notices add labels of their own.

Defined cases: null or empty text has no words, no labels and score 0; equal starts are both reported; repeated
rows are returned each; an empty table gives no rows; extra columns are ignored; a text of any length is searched
whole, in time that grows with its length and its number of matches; of matches that overlap the one with the fewest
edits for its length stays, then the longest, the first, the smaller label. The score is 1 for an exact phrase, else
the best 1 - edits / length, else 0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import table

PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons zero public domain dedication": "cc0",
    "all rights reserved": "proprietary",
}
EDITS_PER = 10  #: characters of a notice for each edit that it may have
Q = 4  #: characters of the grams that screen a place before the regex

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """The words joined by single spaces, with a space at either end; a single space if there are none."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def phrase_places(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand."""
    out, seen, word = [], 0, 0
    at = norm.find(b" " + phrase + b" ")
    while at >= 0:
        word += norm.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = norm.find(b" " + phrase + b" ", at + 1)
    return out


class Search:
    """Finds the notices of a dictionary {notice: label}."""

    def __init__(self, notices: dict[str, str], per: int = EDITS_PER):
        self.notices = [(n, label, len(n) // per) for n, label in notices.items()]
        self.patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )") for n, _, k in self.notices]
        self.grams = [{n[j : j + Q] for j in range(len(n) - Q + 1)} for n, _, _ in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            cuts = [round(j * len(n) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(n[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def find(self, norm: bytes) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, edits, similarity), the words before a match counted from 0."""
        text = norm.decode("latin-1")
        where: dict[int, list[list[int]]] = {}
        for stop, (size, uses) in self.seeds.iter(text):
            for i, offset in uses:
                k, n = self.notices[i][2], len(self.notices[i][0])
                begin = max(0, stop - size + 1 - offset - k - 1)
                end = min(len(text), begin + n + 3 * k + 3)
                spans = where.setdefault(i, [])
                if spans and begin <= spans[-1][1]:
                    spans[-1] = [min(begin, spans[-1][0]), max(end, spans[-1][1])]
                else:
                    spans.append([begin, end])
        out = []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        for i, spans in where.items():
            notice, label, _ = self.notices[i]
            for begin, end in spans:
                # an edit breaks Q grams at most
                if len(self.grams[i] - {text[j : j + Q] for j in range(begin, end - Q + 1)}) > Q * self.notices[i][2]:
                    continue
                for m in self.patterns[i].finditer(text, begin, end):
                    edits = sum(m.fuzzy_counts)
                    first = int(np.searchsorted(spaces, m.start())) - 1
                    out.append((label, first, first + m[0].strip().count(" "), edits, 1 - edits / len(notice)))
        best: list = []  # by first word; none overlaps another, so that only the last that starts before a match ends can meet it
        for x in sorted(out, key=lambda x: (-x[4], x[1] - x[2], x[1], x[0])):  # of overlapping matches the closest, then the longest, the first, by label
            at = bisect_right(best, x[2], key=lambda y: y[1])
            if not at or best[at - 1][2] < x[1]:
                best.insert(at, x)
        return best


@lru_cache(8)
def _search(notices: tuple) -> Search:
    return Search(dict(notices))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) for each row; notices holds label, first and last word and edits of each match."""
    own, wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), tuple((NOTICES if notices is None else notices).items())
    found = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))

    def one(text: str | None, search: Search) -> tuple:
        norm = normal(text)
        places = [(at, label) for phrase, label in PHRASES.items() if phrase in norm for at in phrase_places(norm, phrase)]
        hits = search.find(norm)
        base = {label for _, label in places}
        starts = [at for at, _ in places]
        score = 1.0 if places else max((h[4] for h in hits), default=0.0)
        return norm.count(b" ") - 1 if len(norm) > 1 else 0, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[0] for h in hits})), score, [{"label": h[0], "first": h[1], "last": h[2], "edits": h[3]} for h in hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(wanted)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), found]
        for batch in batches:
            rows = [one(t.as_py(), search) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first:long,last:long,edits:long>>")


def op4_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
