"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's token ids (and its closing id) are cut into pieces of at most `length`; the histogram of the pieces'
lengths, in steps of `step` tokens (512 counts, however many documents), goes to the driver. There a linear program
over filling patterns is solved by column generation: a knapsack by dynamic programming prices new patterns until
none improves the bound by more than `gap`. Patterns are used as often as their rounded-down values say, the small
rest is packed first fit by decreasing length. Pieces are ranked within their length class, hash shard by hash
shard, and ranks are mapped to the patterns' slots; no class and no sequence set is held by one task.

Defined cases: null or blank text is the closing id alone; a document of any length is cut; ties and repeated rows
are separate pieces in a stable order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.llm.shared import cut, releasing, small_batches, table

LENGTH, STEP, CLOSING, GAP, SHARD = 4096, 8, 2, 2e-4, 20_000
CACHED, LONGEST_CACHED = 300_000, 16


class Encoder(dict):
    """Token ids as little-endian 32-bit bytes, by runs of a text that the tokenizer never joins, which are remembered.

    What the tokenizer joins is asked of the tokenizer itself, so any tokenizer file is right, if slower. Where it
    drops white space and parts ASCII letters and digits from ASCII symbols, runs between ASCII white space are encoded
    apart, and within them letters and digits from symbols. Runs with an apostrophe stay whole (it may begin a
    contraction), as do all of a text with a character beyond ASCII that, normalised, does not stand apart from symbols
    beside it: a mark, or a letter that decomposes into letter and mark. Texts that may hold an added token, and those
    for a tokenizer of other habits, are encoded whole. Words of letters that the tokenizer neither normalises nor splits
    go to its model at once. A full memory forgets its later half, for what is frequent comes early.
    """

    made: dict = {}
    RUNS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
    QUOTED = re.compile(rb"[^\s']*'\S*|[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart: dict[str, bool] = {}  #: whether a character stands apart from symbols beside it
        symbols = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
        self.parted = all(self._stands_apart(c, x) for c in string.ascii_letters + string.digits for x in symbols) and self._ids("Ab, c\n(d1") == b"".join(map(self._ids, ("ab", ",", "c", "(", "d1")))
        self.plain = self._ids("quality") == self._of_model("quality")
        self.letters = self._letters() if self.plain else {}
        self.simple = re.compile(f"[a-z{''.join(map(chr, self.letters))}]+")

    @classmethod
    def of(cls, text: str) -> Encoder:
        if text not in cls.made:
            cls.made = {text: cls(text)}
        return cls.made[text]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_model(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self) -> dict[int, str]:
        """What the model reads for each Latin letter beyond ASCII that stays as it is within a word."""
        out, normalizer, splitter = {}, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for c in filter(str.isalpha, map(chr, range(0x80, 0x250))):
            own = f"a{c}b"
            if splitter and (not normalizer or normalizer.normalize_str(own) == own):
                found = splitter.pre_tokenize_str(own)
                if len(found) == 1 and found[0][1] == (0, 3) and found[0][0][0] + found[0][0][-1] == "ab":
                    out[ord(c)] = found[0][0][1:-1]
        each = "a".join(map(chr, out)) + "".join(map(chr, out))
        return out if self._ids(each) == self._of_model(each.translate(out)) else {}

    def _stands_apart(self, c: str, symbol: str = ",") -> bool:
        """Whether the tokenizer parts c, normalised, from a symbol on either side."""
        own = symbol + c + symbol
        if self.tokenizer.normalizer:
            own = self.tokenizer.normalizer.normalize_str(own)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(own) if self.tokenizer.pre_tokenizer else []
        return len(found) > 2 and found[0][1] == (0, 1) and found[-1][1] == (len(own) - 1, len(own))

    def __missing__(self, run: bytes) -> bytes:
        word = run.decode()
        ids = self._of_model(word.translate(self.letters)) if self.plain and self.simple.fullmatch(word) else self._ids(word)
        if len(run) <= LONGEST_CACHED:
            self[run] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > CACHED:
            for run in list(self)[CACHED // 2 :]:
                del self[run]
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        if not self.parted or any(t in text for t in self.added):
            return self._ids(text)
        raw = text.encode("utf-8", "replace").lower()
        if not text.isascii():
            for c in {c for c in set(text) if c > "\x7f"}:
                if c not in self.apart:
                    self.apart[c] = self._stands_apart(c)
                if not self.apart[c]:  # a mark may compose with a capital as with no small letter
                    return b"".join(self[run.lower() if run.isascii() else run] for run in text.encode("utf-8", "replace").split())
        return b"".join(map(self.__getitem__, (self.QUOTED if "'" in text else self.RUNS).findall(raw)))


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids in pieces of at most length. tokenizer: its JSON."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind, model = own.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([closing], "<u4").tobytes()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, out = batch.slice(i, 512), ([], [], [], [], [])
                for k, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    for at in range(0, len(ids), 4 * length):
                        piece = ids[at : at + 4 * length]
                        for column, value in zip(out, (k, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(out[0], pa.int32())), *(pa.array(x, pa.int64()) for x in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.clear()

    return own.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def priced(worth: np.ndarray, sizes: np.ndarray, room: int, most: int = 32) -> tuple[float, list[np.ndarray]]:
    """The value of the most valuable pattern and up to `most` valuable patterns, the best first: an unbounded knapsack by dynamic programming, then the best pattern that holds each size."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ranked, value = sizes[order], worth[order]
    for c, n in enumerate(np.searchsorted(ranked, np.arange(room + 1), side="right")):
        if n:
            values = value[:n] + best[c - ranked[:n]]
            k = int(values.argmax())
            best[c], last[c] = (values[k], order[k]) if values[k] > best[c - 1] else (best[c - 1], -1)
    holding, out = worth + best[room - sizes], []
    for k in np.argsort(-holding, kind="stable")[:most]:
        pattern, c = np.zeros(len(sizes), np.int64), room - sizes[k]
        pattern[k] = 1
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                pattern[last[c]] += 1
                c -= sizes[last[c]]
        out.append(pattern)
    return float(best[room]), out


def generate(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their values: the linear program min sum(x), patterns @ x >= demand, by the revised simplex method with priced columns.

    It ends within gap of the bound, or after `most` pricings with columns that serve as well but may lie further from it.
    """
    columns = np.diag(room // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(columns)), demand / np.diag(columns)
    for _ in range(most):
        duals = inverse.sum(0)
        value, found = priced(np.maximum(duals, 0), sizes, room)
        if value <= 1 + gap:
            break
        for pattern in found:
            if duals @ pattern <= 1 + gap:  # at the prices that the columns before it have left
                continue
            step = inverse @ pattern
            rows = np.flatnonzero(step > 1e-9)
            out = rows[(x[rows] / step[rows]).argmin()]
            amount, row = x[out] / step[out], inverse[out] / step[out]
            x = np.maximum(x - amount * step, 0)
            x[out] = amount
            duals = duals + (1 - step.sum()) * row
            step[out] = 0
            rows = np.flatnonzero(step)
            inverse[rows] -= step[rows, None] * row
            inverse[out], columns[:, out] = row, pattern
    return np.rint(columns).astype(np.int64), x


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often): all demand exactly, first by rounded columns, the rest first fit."""
    found, x = generate(sizes, demand.astype(float), room, gap)
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        times = int(x[k] + 1e-9)
        own = found[:, k]
        some = own > 0
        times = min(times, int((left[some] // own[some]).min())) if some.any() else 0
        if times:
            out.append((own, times))
            left -= own * times
    while left.any():
        own, free = np.zeros_like(left), room
        for k in np.argsort(-sizes, kind="stable"):
            own[k] = min(left[k], free // sizes[k])
            free -= own[k] * sizes[k]
        some = own > 0
        times = int((left[some] // own[some]).min())
        out.append((own, times))
        left -= own * times
    return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, step: int = STEP, closing: int = CLOSING, gap: float = GAP, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    with small_batches(spark):
        cutup = cut(pieces(docs, tokenizer, key, text, length, closing).withColumn("size", F.ceil(F.col("length") / step).cast("int")))
    counts = {r["size"]: r["n"] for r in cutup.groupBy("size").agg(F.count("*").alias("n")).collect()}  # length / step rows at most
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[s] for s in sizes], np.int64)
    slots: dict[int, list] = {int(s): [] for s in sizes}
    used, base = np.zeros(len(sizes), np.int64), 0
    for own, times in patterns(sizes, demand, -(-length // step), gap) if len(sizes) else []:
        for k in np.flatnonzero(own):
            slots[int(sizes[k])].append((int(used[k]), int(used[k] + own[k] * times), int(own[k]), base))
        used += own * times
        base += times
    plan = spark.createDataFrame([(s, -(-counts[s] // shard), v) for s, v in slots.items()], "size int, shards long, slots array<struct<first:long,stop:long,each:long,base:long>>")
    plan = F.broadcast(plan)  # length / step rows at most

    rows = cutup.join(plan.select("size", "shards"), "size").withColumn("shard", F.expr("pmod(xxhash64(doc_id, start, ids_crc32), shards)")).drop("shards")
    before = rows.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("shard")) - F.col("n")).drop("n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("size", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    rows = rows.join(before, ["size", "shard"]).withColumn("place", F.col("place") - 1 + F.col("before"))
    rows = rows.join(plan.select("size", "slots"), "size").withColumn("slot", F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("place")) & (F.col("place") < s["stop"])), 1))
    rows = rows.withColumn("sequence_id", F.expr("slot.base + (place - slot.first) div slot.each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_json(path: str | None = None) -> str:
    """A tokenizer file's text; by default the public word-level one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_json())
