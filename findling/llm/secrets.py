"""Secret scans with a linear-chain conditional random field.

All tokens of a text (runs of letters, digits and `+ / - _`, and single other characters but quotes and white space)
are one chain, tagged begin, inside or outside from their shape, the neighbouring words and features of the file.
A tag's score is a sum over a token and its neighbours, so scores are kept by word. Viterbi decoding is exact: it
runs over the stretches in which some path could beat the all-outside one, which running sums of each token's best
possible gain find; elsewhere outside is proven best.

Weights are fitted by gradient ascent on the conditional likelihood of at most `SAMPLE_RUNS` windows of about
`SAMPLE_DOCS` documents: around values that the base formats know, and elsewhere, `RUNS_PER_DOC` of either kind from
each document (a quarter as many of the latter) at places chosen by hash. In half of the former the neighbouring words
are hidden, and three of four values give way to random ones of the same alphabets, so that the field learns what
values look like without their cue or format. Values of more than `LONGEST` tokens are not learned from.

Base formats, leftmost and non-overlapping within a kind, stand whatever the field says: assignments (value of 12
or more characters), access keys (18 or more) and lower-case hex (16 or more). The field adds `secret` spans, but for
those that lie within one base span; each comes with its posterior. Positions are code points, ends exclusive.

Defined cases: null or empty text has no spans (its base digest is that of the empty string); ties in start go by
kind as listed, ties in score go to outside; without values to learn from nothing is added; repeated rows are returned
each; very long texts are read whole, in time that grows with their length; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.llm.shared import releasing, table

KINDS = ("assign", "access", "hex", "secret")
BASE = KINDS[:3]
SAMPLE_DOCS, SAMPLE_RUNS, RUNS_PER_DOC, LONGEST, BUCKETS = 16_000, 6_000, 8, 24, 1 << 14
OUT, BEGIN, INSIDE = 0, 1, 2
OWN, SIDES, FILE = 10, 4, 2  #: features of a token itself, of the tokens beside it (two before, one before as a sign, one after), of the file
CACHED = 200_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
_TOKEN = re.compile(r"[\w+/-]+|[^\w\s\"']")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [x[:3] for x in _known(text)]


def _known(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value)."""
    out = []
    if ":" in text or "=" in text:
        low, starts = text.lower(), []
        if len(low) != len(text):  # a character that lower-cases to two
            low = "".join(c.lower() if c < "\x80" else c for c in text)
        for word in _WORDS:
            at = low.find(word)
            while at >= 0:
                starts.append(at)
                at = low.find(word, at + 1)
        end = 0
        for at in sorted(starts):
            if at >= end and (m := _ASSIGN.match(text, at)):
                end = m.end()
                if m.end(2) - m.start(2) >= 12:
                    out.append(("assign", at, end, m.start(2)))
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return out


_KINDS = bytes(100 if 48 <= c <= 57 else 117 if 65 <= c <= 90 else 115 if c < 128 and not 97 <= c <= 122 else 108 for c in range(256))  #: d, u, l, s; all beyond ASCII is l
_RUNS, _HARD = re.compile(rb"d+|u+|l+|s+"), re.compile(rb"[^aeiouy\x80-\xff]+")


def _look(token: str) -> tuple:
    """Kinds of characters, size, hexadecimal, variety, changes between kinds, vowels, longest run without any, beginning."""
    raw = token.encode("utf-8", "replace")[:256]
    n, kinds, low = len(raw), raw.translate(_KINDS), raw.lower()
    if n == 1 and kinds == b"s":
        return token, 2, False, 8, 0, 0, 1, ""
    bits, some = n.bit_length(), "".join([k for k, c in zip("duls", b"duls", strict=True) if c in kinds])
    turns = len(_RUNS.findall(kinds)) - 1 if len(some) > 1 else 0
    vowels = (n - len(low.translate(None, b"aeiouy"))) * 8 // n
    hard = 12 if n > 12 and not vowels else min(12, max(map(len, _HARD.findall(low)), default=0))
    return some, bits * 2 + (n >= 3 << max(0, bits - 2)), not low.strip(b"0123456789abcdef"), len(set(raw)) * 8 // n, turns if turns < 6 else 6 + turns * 8 // n, vowels, hard, token[:4] if n > 15 and raw[:4].isalpha() and raw[:4].isupper() else ""


def _number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


@lru_cache(1 << 15)
def _own(look: tuple) -> tuple[int, ...]:
    some, size, hexadecimal, variety, turns, vowels, hard, begin = look
    return tuple(_number(f) for f in ("b", f"h{some}", f"l{some}{size}", f"x{hexadecimal}{size}", f"d{variety}{size}", f"t{turns}{some}", f"t{turns}{size}", f"v{vowels}{some}", f"r{hard}{size}", f"4{begin}"))


def _word(token: str) -> int:
    return zlib.crc32((token.lower() if len(token) <= 24 else "*").encode("utf-8", "replace"))


def _beside(words: list[int]) -> np.ndarray:
    """What words are to the tokens one, two and three after them and one before."""
    return ((np.array(words, np.uint64)[:, None] * np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)) >> np.uint64(20)).astype(np.int64) % BUCKETS


def _file(text: str) -> list[int]:
    return [_number(f"f:eq{min(4, text.count('=') * 400 // (len(text) + 1))}"), _number(f"f:nl{min(4, text.count(chr(10)) * 200 // (len(text) + 1))}")]


EDGE, HIDDEN = _beside([1, 2])


def features(tokens: list[str], file: list[int]) -> np.ndarray:
    """Feature numbers of each token: its own, those of the words one, two and three before and one after, the file's."""
    n, beside = len(tokens), np.concatenate([np.tile(EDGE, (3, 1)), _beside([_word(t) for t in tokens]), EDGE[None]])
    sides = [beside[2 : n + 2, 0], beside[1 : n + 1, 1], beside[:n, 2], beside[4:, 3]]
    return np.column_stack([np.array([_own(_look(t)) for t in tokens], np.int64).reshape(n, OWN), *sides, np.tile(file, (n, 1))])


class Field:
    """Weights of a linear-chain conditional random field over three tags, outside before and after each sequence."""

    def __init__(self):
        self.w = np.zeros((BUCKETS, 3))
        self.move = np.zeros((3, 3))  #: from, to; inside never follows outside
        self.move[OUT, INSIDE] = -1e4
        self.clear()

    def clear(self) -> None:
        self.names: dict[str, int] = {}
        self.scores = np.zeros((0, 5, 3))

    def __getstate__(self) -> dict:
        return {"w": self.w, "move": self.move}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def gradient(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-likelihood of sequences, grouped by length, and its slopes."""
        total, grad_w, grad_m = 0.0, np.zeros_like(self.w), np.zeros_like(self.move)
        for x, y in groups:
            length = x.shape[1]
            emit = self.w[x].sum(2)
            fore, back = np.empty_like(emit), np.zeros_like(emit)
            fore[:, 0] = self.move[OUT] + emit[:, 0]
            for t in range(1, length):
                fore[:, t] = _sum(fore[:, t - 1, :, None] + self.move, 1) + emit[:, t]
            back[:, -1] = self.move[:, OUT]
            for t in range(length - 2, -1, -1):
                back[:, t] = _sum(self.move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            norm = _sum(fore[:, -1] + back[:, -1], 1)
            path = np.take_along_axis(emit, y[:, :, None], 2).sum() + self.move[OUT, y[:, 0]].sum() + self.move[y[:, -1], OUT].sum() + self.move[y[:, :-1], y[:, 1:]].sum()
            total += float(path - norm.sum())
            miss = np.eye(3)[y] - np.exp(fore + back - norm[:, None, None])
            at = x.reshape(-1)
            for tag in range(3):
                grad_w[:, tag] += np.bincount(at, np.repeat(miss[:, :, tag].reshape(-1), x.shape[2]), BUCKETS)
            grad_m[OUT] += miss[:, 0].sum(0)
            grad_m[:, OUT] += miss[:, -1].sum(0)
            for t in range(1, length):
                pair = np.exp(fore[:, t - 1, :, None] + self.move + (emit[:, t] + back[:, t])[:, None, :] - norm[:, None, None])
                np.add.at(grad_m, (y[:, t - 1], y[:, t]), 1.0)
                grad_m -= pair.sum(0)
        grad_m[OUT, INSIDE] = 0
        return total, grad_w, grad_m

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> None:
        """sequences: (features of each token, tags). Full-batch Adagrad on the log-likelihood."""
        if not any(y.any() for _, y in sequences):
            self.w[:, OUT] = 1
            return
        by: dict[int, list] = {}
        for x, y in sequences:
            by.setdefault(len(x), []).append((x, y))
        groups = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for _, g in sorted(by.items())]
        n, seen_w, seen_m = len(sequences), np.full_like(self.w, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(rounds):
            _, grad_w, grad_m = self.gradient(groups)
            for v, g, s in ((self.w, (grad_w - decay * n * self.w) / n, seen_w), (self.move, grad_m / n, seen_m)):
                s += g * g
                v += rate * g / np.sqrt(s)

    def emissions(self, tokens: list[str], file: list[int]) -> np.ndarray:
        """Each token's score for each tag; what words add is kept for later texts."""
        names = self.names
        if len(names) > CACHED:
            self.clear()
            names = self.names
        new = [t for t in set(tokens) if t not in names]
        if new:
            rows = np.empty((len(new), 5, 3))
            rows[:, 0] = self.w[np.array([_own(_look(t)) for t in new])].sum(1)
            rows[:, 1:] = self.w[_beside([_word(t) for t in new])]
            names.update(zip(new, range(len(names), len(names) + len(new)), strict=True))
            at = len(names)
            if at > len(self.scores):
                more = np.empty((max(1024, 2 * at), 5, 3))
                more[: at - len(new)] = self.scores[: at - len(new)]
                self.scores = more
            self.scores[at - len(new) : at] = rows
        at = np.fromiter(map(names.__getitem__, tokens), np.int64, len(tokens))
        emit = self.scores[at, 0] + self.w[file].sum(0)
        for back in (1, 2, 3):
            emit[back:] += self.scores[at[:-back], back]
            emit[:back] += self.w[EDGE[back - 1]]
        emit[:-1] += self.scores[at[1:], 4]
        emit[-1] += self.w[EDGE[3]]
        return emit

    def stretches(self, emit: np.ndarray) -> list[tuple[int, int]]:
        """Where some path could beat the all-outside one: runs of tokens that lie in a sum above zero of best possible gains."""
        gain, move = emit[:, 1:] - emit[:, :1], self.move - self.move[OUT, OUT]
        into = np.array([move[:, BEGIN].max(), move[:, INSIDE].max()]) + max(0.0, move[BEGIN, OUT], move[INSIDE, OUT])
        best = (gain + into).max(1)
        if best.max(initial=0) <= 0:
            return []
        upto = np.concatenate([[0], np.cumsum(best)])
        fore = upto[1:] - np.minimum.accumulate(upto)[:-1]
        back = np.maximum.accumulate(upto[::-1])[::-1][1:] - upto[:-1]
        inside = np.concatenate([[False], fore + back - best > -1e-9, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))

    def decode(self, emit: np.ndarray) -> list[int]:
        """Viterbi's best tags of a stretch between outside tokens; ties go to the lower tag."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.move.tolist()
        rows = emit.tolist()
        o, b, i, back = oo + rows[0][0], ob + rows[0][1], -1e9, []
        for eo, eb, ei in rows[1:]:
            to_o, to_b, to_i = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib), (b + bi, i + ii)
            po, pb = to_o.index(max(to_o)), to_b.index(max(to_b))
            pi = BEGIN if to_i[0] >= to_i[1] else INSIDE
            back.append((po, pb, pi))
            o, b, i = to_o[po] + eo, to_b[pb] + eb, to_i[pi - 1] + ei
        last = (o + oo, b + bo, i + io)
        tags = [last.index(max(last))]
        for ways in reversed(back):
            tags.append(ways[tags[-1]])
        return tags[::-1]

    def posteriors(self, emit: np.ndarray, tags: list[int], found: list[tuple[int, int]]) -> list[float]:
        """The probability of each span of tokens to be tagged so and to end there, given outside tokens around the stretch."""
        n, fore, back = len(emit), np.empty_like(emit), np.empty_like(emit)
        fore[0], back[-1] = self.move[OUT] + emit[0], self.move[:, OUT]
        for t in range(1, n):
            fore[t] = _sum(fore[t - 1][:, None] + self.move, 0) + emit[t]
            back[n - 1 - t] = _sum(self.move + emit[n - t] + back[n - t], 1)
        norm, out = _sum(fore[-1] + back[-1], 0), []
        for a, b in found:
            own = emit[np.arange(a + 1, b), tags[a + 1 : b]].sum() + self.move[tags[a : b - 1], tags[a + 1 : b]].sum()
            ends = self.move[tags[b - 1], OUT] if b == n else _sum(self.move[tags[b - 1], :INSIDE] + emit[b, :INSIDE] + back[b, :INSIDE], 0)
            out.append(float(np.exp(min(0.0, fore[a, tags[a]] + own + ends - norm))))
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp(x)))."""
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


ALPHABETS = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)


def labelled(text: str | None, most: int = RUNS_PER_DOC, longest: int = LONGEST) -> list[tuple[np.ndarray, list[int]]]:
    """Windows of features and tags: up to `most` around values of the base formats and a quarter as many elsewhere, those with the smallest hashes of their first tokens. By the same hash neighbours are hidden in half of the former, and values of one token in three of four give way to random ones."""
    if not text:
        return []
    found = list(_TOKEN.finditer(text))
    tokens, file, starts = [m[0] for m in found], _file(text), [m.start() for m in found]
    values = set()
    for _, _, end, start in _known(text):
        a, b = bisect.bisect_right(starts, start) - 1, bisect.bisect_left(starts, end)
        if 0 <= a < b <= a + longest:
            values.add((a, b))
    tags = [OUT] * len(tokens)
    for a, b in sorted(values):
        tags[a:b] = [INSIDE] * (b - a)
        tags[a] = BEGIN if not a or tags[a - 1] == OUT else tags[a]
    mark = lambda i: zlib.crc32(" ".join(tokens[i : i + 4]).encode("utf-8", "replace"))
    windows = sorted((mark(a), a - 5, b + 4) for a, b in values)[:most]
    others = sorted((mark(i), i, i + 16) for i in range(0, len(tokens), 16) if not any(tags[i : i + 16]))[: max(1, most // 4)]
    out = []
    for turn, (m, lo, hi) in enumerate([*windows, *others]):
        lo = max(0, lo)
        hi = min(len(tokens), lo + -(-(hi - lo) // 8) * 8)
        while hi < len(tokens) and tags[hi] == INSIDE:
            hi += 1
        while lo and tags[lo] == INSIDE:
            lo -= 1
        at, own = max(0, lo - 3), tags[lo:hi]
        shown = tokens[at : hi + 1]
        if turn < len(windows) and m >> 1 & 3:
            r = random.Random(m)
            for i, tag in enumerate(own):
                if tag == BEGIN and own[i + 1 : i + 2] != [INSIDE]:
                    shown[lo - at + i] = "".join(r.choices(ALPHABETS[(m >> 1 & 3) - 1], k=r.randint(14, 44)))
        x = features(shown, file)[lo - at :][: hi - lo]
        if turn < len(windows) and m & 1:
            x[:, OWN : OWN + SIDES] = np.where(np.array(own)[:, None] > 0, HIDDEN, x[:, OWN : OWN + SIDES])
        out.append((x, own))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_runs: int = SAMPLE_RUNS, per_doc: int = RUNS_PER_DOC, longest: int = LONGEST) -> Field:
    """The field from about sample_docs documents (those whose keys hash to 0) and at most sample_runs windows of theirs, per_doc around values and a quarter as many elsewhere from each; values of more than `longest` tokens are passed over."""
    step = max(1, -(-docs.count() // sample_docs))
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(F.col(text).cast("string").alias("text"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.astype(np.uint16).tobytes(), len(y), bytes(y)) for t in batch.column(0) for x, y in labelled(t.as_py(), per_doc, longest)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary()), pa.array([any(f[2]) for f in found], pa.bool_())], ["x", "n", "y", "some"])

    each = some.mapInArrow(run, "x binary, n int, y binary, some boolean")
    # as many windows with values as without, where there are so many
    place = F.row_number().over(Window.partitionBy("some").orderBy("mark", "x", "y"))
    few = each.withColumn("mark", F.xxhash64("x", "y")).withColumn("place", place).where(F.col("place") <= sample_runs).orderBy("place", "some").limit(sample_runs).collect()
    field = Field()
    field.fit([(np.frombuffer(r["x"], np.uint16).astype(np.int64).reshape(r["n"], -1), np.frombuffer(r["y"], np.uint8).astype(np.int64)) for r in few if r["n"]])
    return field


def spans(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans and all spans, each by start and kind as listed; the latter with the field's posterior, null for base ones."""
    if not text:
        return [], []
    base = base_spans(text)
    every = [(*b, None) for b in base]
    tokens = _TOKEN.findall(text)
    emit = field.emissions(tokens, _file(text)) if tokens else np.zeros((0, 3))
    places = None
    for lo, hi in field.stretches(emit):
        tags = field.decode(emit[lo:hi])
        if not any(tags):
            continue
        places = places or [m.span() for m in _TOKEN.finditer(text)]
        found = []
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                found.append((i, i + 1))
            elif tag == INSIDE:
                found[-1] = (found[-1][0], i + 1)
        for (i, stop), p in zip(found, field.posteriors(emit[lo:hi], tags, found), strict=True):
            every.append(("secret", places[lo + i][0], places[lo + stop - 1][1], p))
    held = sorted((s, e) for _, s, e in base)
    upto = np.maximum.accumulate([e for _, e in held]) if held else []
    inside = lambda x: (at := bisect.bisect_right(held, (x[1], 1 << 60))) > 0 and upto[at - 1] >= x[2]
    every = [x for x in every if x[3] is None or not inside(x)]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(every, key=order)


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, added) for each row; added: kind:start:end:posterior of the field's spans."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(field)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t.as_py(), held.value) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            new = [[x for x in every if x[3] is not None] for _, every in both]
            added = [pa.array([len(x) for x in new], pa.int64()), pa.array([",".join(f"{k}:{s}:{e}:{p:.4f}" for k, s, e, p in x) for x in new], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_joined(x) for _, x in both], pa.string()), *added], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "added"])
        held.value.clear()

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, added string")


def op6_conditional_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
