"""Quality by an interpolated modified Kneser-Ney bigram model of trusted text.

Words are keyed by `WORD` bits of a hash, so many that different words all but never share a key. Neither the bigram
counts nor what is kept by word (context totals, numbers of followers seen once, twice and more often, numbers of
left neighbours) is ever gathered, for both grow with the corpus. Trusted bigrams go to a shard by low bits of both
their words (a grid, so that no frequent word fills a shard; equal pairs share one, and the most frequent pair is a
few thousandths of a text; more text, more shards), packed by blocks of documents with the documents that have
bigrams there. A shard counts its bigrams and asks for each of its words: words are dealt into as many parts as
there are shards, a part sums what the shards have counted for a word and answers each shard that asked. Then the
shard joins its documents' bigrams with its counts and the answers, which gives the trusted documents' sums.

For other documents the logarithm of a probability falls apart: unseen bigrams have a share of the first word (its
backoff weight) and one of the second (the lower order); what a seen bigram has beyond these is its excess. Shares and
excesses are a table of `KEY` bits of a hash and a number, shard by shard. Documents send the keys of their bigrams
and words there and get sums back, in `ROUNDS` rounds of whole documents, so that only a part of the keys is on disk at
a time. The shares of at most `COMMON` words, the most frequent ones, are added up where the text is read. Shuffled
files are removed as each step ends. Sums are integers, so results do not depend on the order of arrival.

A trusted document is judged without its own counts (leave one out). Perplexities are pulled towards their
language's mean as if by `PRIOR` more words; a document is rejected when it lies above `SPREAD` times the distance
between the median and the `QUANTILE` quantile of its language's trusted documents, beyond the median.

Defined cases: null or empty text has no words and is kept; a language (null is one) without trusted documents
keeps everything; labels that are null or name no document are ignored; repeated rows are returned each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.llm.shared import cut, releasing, small_batches, table, tidied

CLASSES = 19  #: the uniform base of the lower order has 2^19 words, or the different words of all documents if they are more
WORD = 42  #: bits of a word's key; two more than a bigram's ten bytes hold, as shards tell at least two of each word
MIX = np.uint64(0x9E3779B97F4A7C15)
SHARD_CHARS, LEAST_SHARD_BITS = 2_500_000, 6
BLOCK_CHARS, CACHED = 2_000_000, 150_000
KEY = 40  #: bits of a key within a shard
WORDS, LAST = np.array([1 << 62], np.uint64), np.array([1 << 63], np.uint64)  #: in a key's first place: the second is a word's shares, or what a document's last word has too much
ROUNDS, COMMON = 3, 1 << 16
PRIOR, QUANTILE, SPREAD = 20, 0.99, 1.5
BROADCAST_IDS = 4_000_000  #: trusted keys that are broadcast (8 bytes each); more are joined
SCALE = 1 << 20


class Classes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = max(1, xxhash.xxh3_64_intdigest(word) >> (64 - WORD))
        return h


def grid(chars: int) -> tuple[int, int]:
    """Shard bits taken from the first and from the second word of a bigram."""
    bits = max(LEAST_SHARD_BITS, int(np.ceil(np.log2(max(1, chars / SHARD_CHARS)))))
    return bits - bits // 3, bits // 3


def bigrams(texts: list[str | None], cache: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both words of all bigrams of all texts (the first word follows 0), and each text's number of words."""
    if len(cache) > CACHED:
        cache.clear()
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    second = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    first = np.concatenate([np.zeros(1, np.uint64), second[:-1]]) if len(second) else second
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return first, second, sizes


def packed(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, bits: tuple[int, int]) -> Iterator[tuple[int, bytes]]:
    """(shard, the documents that have bigrams there, how many each, then the lower and the upper bits of the words that the shard does not tell)."""
    a, b = map(np.uint64, bits)
    one, low = np.uint64(1), np.uint64(0xFFFFFFFF)
    shard = ((first & ((one << a) - one)) << b | second & ((one << b) - one)).astype(np.uint16 if sum(bits) <= 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    doc, shard, v, w = np.repeat(np.arange(len(sizes)), sizes)[order], shard[order], first[order] >> a, second[order] >> b
    high = ((v >> np.uint64(32)) << np.uint64(8) | w >> np.uint64(32)).astype(np.uint16)
    v, w = (v & low).astype(np.uint32), (w & low).astype(np.uint32)
    ends = np.searchsorted(shard, np.arange((1 << sum(bits)) + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        at = slice(ends[s], ends[s + 1])
        own = doc[at]  # in order, as the sort is stable
        first_of = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        about = np.concatenate([[len(first_of)], own[first_of], np.diff(np.r_[first_of, len(own)])]).astype(np.uint32)
        yield s, b"".join(x.tobytes() for x in (about, v[at], w[at], high[at]))


class Shard:
    """The bigrams of one shard. packets: (trusted documents' bits, documents, packed bigrams)."""

    def __init__(self, shard: int, packets: list[tuple[bytes, int, bytes]], bits: tuple[int, int]):
        a, b = bits
        self.docs, self.trusted, v, w = [], [], [], []
        for trust, n, data in packets:
            some = int(np.frombuffer(data, np.uint32, 1)[0])
            docs, sizes = np.frombuffer(data, np.uint32, 2 * some, 4).reshape(2, some)
            t, head = int(sizes.sum()), 4 + 8 * some
            high = np.frombuffer(data, np.uint16, t, head + 8 * t).astype(np.uint64)
            v.append((np.frombuffer(data, np.uint32, t, head) | (high >> np.uint64(8)) << np.uint64(32)) << np.uint64(a) | np.uint64(shard >> b))
            w.append((np.frombuffer(data, np.uint32, t, head + 4 * t) | (high & np.uint64(255)) << np.uint64(32)) << np.uint64(b) | np.uint64(shard & ((1 << b) - 1)))
            self.docs.append((docs, sizes))
            self.trusted.append(np.repeat(np.unpackbits(np.frombuffer(trust, np.uint8), count=n).astype(bool)[docs], sizes))
        v, w, trusted = np.concatenate(v), np.concatenate(w), np.concatenate(self.trusted)
        self.key = v * MIX + w
        self.v, self.at_v = np.unique(v, return_inverse=True)  #: different words, and where each bigram's are among them
        self.w, self.at_w = np.unique(w, return_inverse=True)
        self.keys, some, self.counts = np.unique(self.key[trusted], return_index=True, return_counts=True)
        some = np.flatnonzero(trusted)[some]
        self.first, self.second = self.at_v[some], self.at_w[some]

    def count(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.counts[at], 0)


class Model:
    """The discounts; with a shard's answers, what is kept by word: `total` of each context, `seen` (followers seen once, twice, more often), `left` (different words before it)."""

    def __init__(self, sums: np.ndarray):
        """sums: bigrams seen once to four times; words with one to four and with more than two left neighbours; all left neighbours; words."""
        self.cut, self.lower_cut = self._discounts(sums[:4].astype(float)), self._discounts(sums[4:8].astype(float))
        self.pairs, n = float(sums[9]), max(1 << CLASSES, int(sums[10]))
        self.lower_rest = float(self.lower_cut[1:] @ sums[[4, 5, 8]]) / self.pairs / n if self.pairs else 1 / n

    def answered(self, of_v: np.ndarray, of_w: np.ndarray) -> Model:
        self.total, self.seen, self.left = of_v[0].astype(float), of_v[1:].astype(float), of_w[0].astype(float)
        return self

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """0 and the discounts of counts of 1, 2 and 3 or more from the numbers of things seen once to four times."""
        n1, n2, n3, n4 = np.maximum(n, 1)
        y = n1 / (n1 + 2 * n2)
        return np.array([0, np.clip(1 - 2 * y * n2 / n1, 0.1, 0.95), np.clip(2 - 3 * y * n3 / n2, 0.1, 1.9), np.clip(3 - 4 * y * n4 / n3, 0.1, 2.9)])

    def shares(self, total: np.ndarray, seen: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words: what they have, as first and as second ones, in the log probabilities of unseen bigrams; as second ones beyond words never seen."""
        known = total > 0
        back = np.log(np.where(known, np.minimum(self.cut[1:] @ seen / np.where(known, total, 1), 1), 1))
        return back, np.log(self.word(slice(None), 0, left) / self.lower_rest)

    def word(self, w: np.ndarray | slice, less: np.ndarray | int, left: np.ndarray | None = None) -> np.ndarray:
        """The lower order: how many different words it follows, interpolated with all words alike; less: own contributions."""
        n = np.maximum((self.left if left is None else left)[w] - less, 0)
        return np.maximum(n - self.lower_cut[np.minimum(n, 3).astype(int)], 0) / max(self.pairs, 1) + self.lower_rest

    def logs(self, v: np.ndarray, w: np.ndarray, count: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log probabilities of w after v. count: trusted count of the bigram; own: how much of it is the document's."""
        c = count - own
        gone = (own > 0) & (c == 0)
        total = self.total[v] - own
        rest = self.cut[1] * np.maximum(self.seen[0, v] - gone, 0) + self.cut[2] * self.seen[1, v] + self.cut[3] * self.seen[2, v]
        known = total > 0
        total = np.where(known, total, 1)
        low = self.word(w, gone)
        p = np.maximum(c - self.cut[np.minimum(c, 3)], 0) / total + np.minimum(rest / total, 1) * low
        return np.log(np.where(known & (rest > 0), p, np.where(known, np.maximum(p, low * 1e-2), low)))  # low is above 0


ZSTD = pa.Codec("zstd")


def shrunk(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each laid out by bytes of equal weight and compressed."""
    out = []
    for x in arrays:
        data = ZSTD.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True) if len(x) else b""
        out += [np.array([len(x), len(data)], np.uint32).tobytes(), data]
    return b"".join(out)


def grown(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of shrunk()."""
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        n, m = np.frombuffer(data, np.uint32, 2, at).tolist()
        at += 8 + m
        raw = ZSTD.decompress(data[at - m : at], n * kind.itemsize, asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def coded(data: bytes) -> bytes:
    """What packed() yields, with each different word once."""
    some = int(np.frombuffer(data, np.uint32, 1)[0])
    docs, sizes = np.frombuffer(data, np.uint32, 2 * some, 4).reshape(2, some)
    t, head = int(sizes.sum()), 4 + 8 * some
    v, w = np.frombuffer(data, np.uint32, 2 * t, head).reshape(2, t).astype(np.uint64)
    high = np.frombuffer(data, np.uint16, t, head + 8 * t).astype(np.uint64)
    (v, at_v), (w, at_w) = (np.unique(x, return_inverse=True) for x in (v | (high >> np.uint64(8)) << np.uint64(32), w | (high & np.uint64(255)) << np.uint64(32)))
    return shrunk(_steps(docs), sizes, _steps(v), at_v.astype(np.uint32), _steps(w), at_w.astype(np.uint32))


def decoded(data: bytes) -> bytes:
    """The inverse of coded()."""
    docs, sizes, v, at_v, w, at_w = grown(data, np.uint32, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32)
    v, w = np.cumsum(v, dtype=np.uint64)[at_v], np.cumsum(w, dtype=np.uint64)[at_w]
    high = ((v >> np.uint64(32)) << np.uint64(8) | w >> np.uint64(32)).astype(np.uint16)
    about = np.concatenate([[len(docs)], np.cumsum(docs), sizes]).astype(np.uint32)
    return b"".join(x.tobytes() for x in (about, v.astype(np.uint32), w.astype(np.uint32), high))


def keyed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """KEY bits for two words (or a mark and a word)."""
    x = v * MIX ^ w * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * MIX >> np.uint64(64 - KEY)


def entries(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A part of a shard's table."""
    order = np.argsort(keys)
    return shrunk(_steps(keys[order]), values[order].astype(np.float32))


class Common:
    """The shares of frequent words, in order of words: `whole` of both places, `back` of the first. start: that of a text's start."""

    def __init__(self, words: np.ndarray, back: np.ndarray, follow: np.ndarray, start: float, unheard: float):
        self.words, self.whole, self.back, self.start, self.unheard = words, back + follow, back, start, unheard

    def found(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are, and whether they are there."""
        at = np.minimum(np.searchsorted(self.words, w), max(len(self.words) - 1, 0))
        return at, self.words[at] == w if len(self.words) else np.zeros(len(w), bool)


def asked_keys(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, bits: tuple[int, int], common: Common) -> tuple[np.ndarray, Iterator[tuple[int, bytes]]]:
    """Each text's sum over what needs no table, and for each shard (shard, texts and their keys there)."""
    a, b = bits
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    last = (np.cumsum(sizes) - 1)[sizes > 0]
    at, there = common.found(second)
    value = np.zeros(len(second))
    value[there] = common.whole[at[there]]
    own = last[there[last]]
    value[own] -= common.back[at[own]]
    base = np.bincount(doc, value, len(sizes)) + sizes * common.unheard + (sizes > 0) * common.start
    rare, ends = ~there, last[~there[last]]
    low = np.uint64((1 << a + b) - 1)
    grid = (first & np.uint64((1 << a) - 1)) << np.uint64(b) | second & np.uint64((1 << b) - 1)
    shard = np.concatenate([grid, second[rare] & low, second[ends] & low]).astype(np.uint16 if a + b <= 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    keys = np.concatenate([keyed(first, second), keyed(WORDS, second[rare]), keyed(LAST, second[ends])])[order]
    doc, shard = np.concatenate([doc, doc[rare], doc[ends]])[order], shard[order]

    def by_shard() -> Iterator[tuple[int, bytes]]:
        limits = np.searchsorted(shard, np.arange((1 << a + b) + 1))
        for s in np.flatnonzero(np.diff(limits)).tolist():
            here = slice(limits[s], limits[s + 1])
            new = np.flatnonzero(np.r_[True, doc[here][1:] != doc[here][:-1]])  # three runs of texts in order
            runs = shrunk(_steps(doc[here][new]), np.diff(np.r_[new, limits[s + 1] - limits[s]]).astype(np.uint32))
            yield s, b"".join([np.uint32(len(runs)).tobytes(), runs, keys[here].astype(np.uint32).tobytes(), (keys[here] >> np.uint64(32)).astype(np.uint8).tobytes()])

    return base, by_shard()


def looked_up(tables: list[bytes], data: bytes | list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each packet of asked_keys() texts and the scaled sums of their keys' numbers in a shard's table."""
    parts = [grown(x, np.uint64, np.float32) for x in tables]
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(k, dtype=np.uint64) for k, _ in parts)])
    order = np.argsort(keys)
    keys, values = keys[order], np.concatenate([np.zeros(0), *(x for _, x in parts)])[order]
    for x in data:
        head = 4 + int(np.frombuffer(x, np.uint32, 1)[0])
        docs, sizes = grown(x[4:head], np.uint32, np.uint32)
        t = int(sizes.sum())
        key = np.frombuffer(x, np.uint32, t, head) | np.frombuffer(x, np.uint8, t, head + 4 * t).astype(np.uint64) << np.uint64(32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            value = np.where(keys[at] == key, values[at], 0)
            yield np.cumsum(docs, dtype=np.uint32), np.rint(np.add.reduceat(value, np.cumsum(sizes, dtype=np.int64) - sizes) * SCALE).astype(np.int64)


def _parts(words: np.ndarray, bits: tuple[int, int]) -> np.ndarray:
    """The part of each word, of as many as there are shards."""
    return (words & np.uint64((1 << sum(bits)) - 1)).astype(np.int64)


def _asks(shard: Shard, bits: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(part, side, words, what the shard has counted of them): contexts are side 0, followers 1."""
    c = shard.counts
    of_v = np.stack([np.bincount(shard.first, weights, len(shard.v)) for weights in (c, c == 1, c == 2, c > 2)]).astype(np.int32)
    of_w = np.bincount(shard.second, minlength=len(shard.w)).astype(np.int32)[None]
    for side, words, own in ((0, shard.v, of_v), (1, shard.w, of_w)):
        parts = _parts(words, bits)
        for k in np.unique(parts).tolist():
            yield k, side, words[parts == k], own[:, parts == k]


def _summed(asks: list[tuple[int, np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words, their sums over shards, and the place of each asked word among them."""
    words, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in asks)]), return_inverse=True)
    own = np.concatenate([np.zeros((rows, 0), np.int32), *(x for _, _, x in asks)], axis=1)
    return words, np.stack([np.bincount(back, x, len(words)) for x in own]).astype(np.int64), back


def _told(asks: dict[int, list]) -> Iterator[tuple[str, int, int, bytes]]:
    """Of one part, by side: answers for the shards that asked, the part's sums (Model takes them added up), its words with what is kept of them."""
    (v, of_v, at_v), (w, of_w, at_w) = _summed(asks[0], 4), _summed(asks[1], 1)
    for side, sums, at in ((0, of_v, at_v), (1, of_w, at_w)):
        done = 0
        for number, words, _ in asks[side]:
            yield "answer", number, side, shrunk(sums[:, at[done : done + len(words)]].ravel())
            done += len(words)
    left = of_w[0]
    sums = np.concatenate([np.zeros(4, np.int64), np.bincount(np.minimum(left, 5), minlength=6)[1:5], [np.count_nonzero(left > 2), left.sum(), len(left), of_v[0].sum()]])
    yield "sums", 0, 0, sums.astype(np.int64).tobytes()
    words = np.union1d(v, w)
    kept = np.zeros((5, len(words)), np.int64)
    kept[:4, np.searchsorted(words, v)], kept[4, np.searchsorted(words, w)] = of_v, left
    yield "words", 0, 0, shrunk(_steps(words), *kept)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, totals, followers seen once, twice and more often, left neighbours."""
    words, total, *seen, left = grown(data, np.uint64, *[np.int64] * 5)
    return np.cumsum(words, dtype=np.uint64), total, np.stack(seen), left


def _answered(shard: Shard, answers: list[tuple[int, int, bytes]], model: Model, bits: tuple[int, int]) -> Model:
    """model with the answers (part, side, sums) for a shard's words."""
    tables = [np.zeros((4, len(shard.v)), np.int64), np.zeros((1, len(shard.w)), np.int64)]
    parts = _parts(shard.v, bits), _parts(shard.w, bits)
    for part, side, data in answers:
        tables[side][:, parts[side] == part] = grown(data, np.int64)[0].reshape(len(tables[side]), -1)
    return model.answered(*tables)


def _scores(shard: Shard, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each packet its documents and the scaled log probabilities of their bigrams in this shard."""
    at = 0
    for (docs, sizes), mine in zip(shard.docs, shard.trusted, strict=True):
        doc, here = np.repeat(np.arange(len(sizes)), sizes), slice(at, at + len(mine))
        at += len(mine)
        key = shard.key[here]
        own = np.zeros(len(key), np.int64)
        if mine.any():
            order = np.lexsort((key[mine], doc[mine]))
            k, d = key[mine][order], doc[mine][order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            group = np.cumsum(new) - 1
            times = np.empty(len(k), np.int64)
            times[order] = np.bincount(group)[group]
            own[mine] = times
        yield docs, np.bincount(doc, np.rint(model.logs(shard.at_v[here], shard.at_w[here], shard.count(key), own) * SCALE), len(sizes)).astype(np.int64)


def _excess(shard: Shard, model: Model) -> bytes:
    """The shard's trusted bigrams as a part of the table: what their log probabilities have beyond both words' shares."""
    v, w, none = shard.first, shard.second, np.zeros(len(shard.keys), np.int64)
    back, follow = model.shares(model.total, model.seen, np.zeros(len(model.total)))[0], np.log(model.word(slice(None), 0))
    return entries(keyed(shard.v[v], shard.w[w]), model.logs(v, w, shard.counts, none) - back[v] - follow[w])


@contextmanager
def _light(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches, and shuffled files removed when the query that made them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        with small_batches(spark):
            yield
    finally:
        spark.conf.set(name, before)


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


#: Packets: what of, shard, block, number of the block's documents, their trusted bits, data. Numbers: what of, where to, and from which part and side.
PACKETS = pa.schema([("what", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("trust", pa.binary()), ("data", pa.binary())])
TOLD = pa.schema([("what", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("data", pa.binary())])
FOUND = pa.schema([("what", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
PACKETS_SQL, TOLD_SQL, FOUND_SQL = "what string, shard int, block long, n int, trust binary, data binary", "what string, shard int, part int, side int, data binary", "what string, shard int, block long, data binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", trust: str = "quality", common_words: int = COMMON) -> DataFrame:
    """(doc_id, h, lang, n_words, trusted, log_p) for each row; trusted: the label says 1; h is Spark's xxhash64 of the text."""
    with _light(docs.sparkSession):
        return tidied(lambda: _score(docs, labels, key, text, lang, trust, common_words))


def _score(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, trust: str, common_words: int) -> DataFrame:
    spark = docs.sparkSession
    trusted = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(trust).alias("_q")).where("_q = 1").select("_id")
    own = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    ids = None
    whole_numbers = isinstance(docs.schema[key].dataType, T.IntegralType) and isinstance(labels.schema[key].dataType, T.IntegralType)
    if whole_numbers and trusted.count() <= BROADCAST_IDS:
        ids = spark.sparkContext.broadcast(np.sort(trusted.toArrow().column(0).to_numpy()))
        own = own.withColumn("trusted", F.lit(None).cast("boolean"))
    else:
        own = own.join(trusted.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("_id"), "left").drop("_id")
        own = own.sortWithinPartitions("doc_id", "h", "lang")  # blocks are named by the order of rows, which a recomputed task must repeat
    lengths = docs.select(F.col(key).alias("_k"), F.length(text).alias("_n")).join(trusted, F.col("_k") == F.col("_id"), "left")
    chars, good = (x or 0 for x in lengths.agg(F.sum("_n"), F.sum(F.when(F.col("_id").isNotNull(), F.col("_n")))).first())
    bits = grid(max(good, chars // ROUNDS))
    shards = 1 << sum(bits)

    def flags(batch: pa.RecordBatch) -> np.ndarray:
        if ids is None:
            return np.array([bool(x) for x in batch.column(4).to_pylist()], bool)
        wanted = batch.column(0).cast(pa.int64())
        there, wanted = wanted.is_valid().to_numpy(zero_copy_only=False), wanted.fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(ids.value, wanted), max(len(ids.value) - 1, 0))
        return there & (ids.value[at] == wanted) if len(ids.value) else np.zeros(len(wanted), bool)

    def packer(kind: bool, common=None, about: bool = True):
        """Packets of the trusted documents' bigrams, or of the others' keys; about: with a packet of each block's rows."""

        @releasing
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache, number, part, of_key = Classes(), 0, TaskContext.get().partitionId(), None

            def block(rows: list) -> Iterator[pa.RecordBatch]:
                nonlocal number
                name = part << 32 | number
                number += 1
                keys, h, langs, texts, _ = zip(*rows, strict=True)
                first, second, sizes = bigrams(texts, cache)
                bit = np.packbits(np.full(len(rows), kind)).tobytes()
                if kind:
                    base, packets = np.zeros(len(rows)), ((s, coded(x)) for s, x in packed(first, second, sizes, bits))
                else:
                    base, packets = asked_keys(first, second, sizes, bits, common.value)
                out = [("packet", s, name, len(rows), bit, x) for s, x in packets]
                if about:
                    of = pa.RecordBatch.from_arrays([pa.array(keys, of_key), pa.array(h), pa.array(langs, pa.string()), pa.array(sizes), pa.array(np.rint(base * SCALE).astype(np.int64))], ["doc_id", "h", "lang", "n", "base"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, of.schema) as to:
                        to.write_batch(of)
                    out.append(("about", name % shards, name, len(rows), bit, sink.getvalue().to_pybytes()))
                if out:
                    yield _batch(out, PACKETS)

            rows, size = [], 0
            for batch in batches:
                of_key = batch.schema.field(0).type
                batch = batch.filter(pa.array(flags(batch) == kind))
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows.append(row)
                    size += len(row[3] or "")
                    if size >= BLOCK_CHARS:
                        yield from block(rows)
                        rows, size = [], 0
            if rows:
                yield from block(rows)

        return pack

    def by_shard(rows: Iterable[dict]) -> dict[int, list[dict]]:
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        return by

    def shard_of(number: int, packets: list[dict]) -> Shard:
        return Shard(number, [(r["trust"], r["n"], decoded(r["data"])) for r in packets], bits)

    @releasing
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, packets in by_shard(_rows(batches)).items():
            shard = shard_of(s, packets)
            yield _batch([("ask", s, part, side, shrunk(_steps(words), counted.ravel())) for part, side, words, counted in _asks(shard, bits)], TOLD)
            tally = np.concatenate([np.bincount(np.minimum(shard.counts, 5), minlength=6)[1:5], np.zeros(8, np.int64)])
            yield _batch([("sums", s, s, 0, tally.astype(np.int64).tobytes())], TOLD)

    @releasing
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(lambda: {0: [], 1: []})
        for r in _rows(batches):
            if r["what"] == "sums":
                yield _batch([tuple(r.values())], TOLD)
                continue
            words, counted = grown(r["data"], np.uint64, np.int32)
            by[r["part"]][r["side"]].append((r["shard"], np.cumsum(words, dtype=np.uint64), counted.reshape(-1, len(words))))
        for part, asked in by.items():
            yield _batch([(what, number, part, side, data) for what, number, side, data in _told(asked)], TOLD)

    good_packets = own.mapInArrow(packer(True, about=False), PACKETS_SQL)
    counted = good_packets.repartitionById(shards, F.col("shard")).mapInArrow(asks, TOLD_SQL).repartitionById(shards, F.col("part")).mapInArrow(told, TOLD_SQL)
    counted = cut(counted)
    sums = sum((np.frombuffer(r["data"], np.int64) for r in counted.where("what = 'sums'").toLocalIterator()), np.zeros(12, np.int64))
    model, least = Model(sums), int(sums[11]) / common_words
    words = counted.where("what = 'words'").select("part", "data")

    def frequent(total: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (total >= least) | (of == 0)  # a text's start among them

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            of, total, seen, left = _words(r["data"])
            here = frequent(total, of)
            back, follow = model.shares(total[here], seen[:, here], left[here])
            yield pa.RecordBatch.from_arrays([pa.array(of[here].astype(np.int64)), pa.array(back), pa.array(follow)], ["word", "back", "follow"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            of, total, seen, left = _words(r["data"])
            here = ~frequent(total, of)
            of, (back, follow) = of[here], model.shares(total[here], seen[:, here], left[here])
            yield _batch([("table", r["part"], 0, entries(np.concatenate([keyed(WORDS, of), keyed(LAST, of)]), np.concatenate([back + follow, -back])))], FOUND)

    found = words.mapInArrow(common, "word long, back double, follow double").toArrow().sort_by("word")
    of, back, follow = (found.column(i).to_numpy() for i in range(3))
    start = float(back[0]) if len(of) and of[0] == 0 else 0.0
    common_of = spark.sparkContext.broadcast(Common(of.astype(np.uint64), back, follow, start, float(np.log(model.lower_rest))))

    @releasing
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_shard(_rows(batches)).items():
            yield from _passed(rows)
            if packets := [r for r in rows if r["what"] == "packet"]:
                shard = shard_of(s, packets)
                full = _answered(shard, [(r["n"], r["block"], r["data"]) for r in rows if r["what"] == "answer"], model, bits)
                yield _batch([("sums", s, r["block"], shrunk(docs.astype(np.uint32), x)) for r, (docs, x) in zip(packets, _scores(shard, full), strict=True)], FOUND)
                yield _batch([("table", s, 0, _excess(shard, full))], FOUND)

    @releasing
    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_shard(_rows(batches)).items():
            yield from _passed(rows)
            packets = [r for r in rows if r["what"] == "packet"]
            sums = looked_up([r["data"] for r in rows if r["what"] == "table"], [r["data"] for r in packets])
            if out := [("sums", s, r["block"], shrunk(docs, x)) for r, (docs, x) in zip(packets, sums, strict=False)]:  # no table, no sums
                yield _batch(out, FOUND)

    def _passed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if out := [("about", r["shard"], r["block"], r["data"]) for r in rows if r["what"] == "about"]:
            yield _batch(out, FOUND)

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("log_p", T.LongType())])

    def whole(block: pa.Table) -> pa.Table:
        """The rows of a block with their sums."""
        pieces = block.to_pylist()
        rows = pa.ipc.open_stream(next(r["data"] for r in pieces if r["what"] == "about")).read_all()
        total = rows.column("base").to_numpy().copy()
        for r in pieces:
            if r["what"] == "sums":
                np.add.at(total, *grown(r["data"], np.uint32, np.int64))
        return pa.table([*rows.columns[:4], pa.array(total)], ["doc_id", "h", "lang", "n_words", "log_p"])

    def rows_of(pieces: DataFrame, kind: bool) -> DataFrame:
        rows = pieces.where("what <> 'table'").select("what", "block", "data").groupBy("block").applyInArrow(whole, schema)
        return cut(rows.select("doc_id", "h", "lang", "n_words", F.lit(kind).alias("trusted"), "log_p"))

    def together(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).repartitionById(shards, F.col("shard"))

    answers = counted.where("what = 'answer'").select("what", "shard", F.col("side").cast("long").alias("block"), F.col("part").alias("n"), F.lit(None).cast("binary").alias("trust"), "data")
    judged = cut(together(own.mapInArrow(packer(True), PACKETS_SQL), answers).mapInArrow(scores, FOUND_SQL))
    out = [rows_of(judged, True)]
    numbers = judged.where("what = 'table'").unionByName(words.mapInArrow(rare, FOUND_SQL))
    numbers = numbers.select("what", "shard", "block", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("trust"), "data")
    for k in range(ROUNDS):
        packets = own.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(ROUNDS)) == k).mapInArrow(packer(False, common_of), PACKETS_SQL)
        out.append(rows_of(together(packets, numbers).mapInArrow(lookups, FOUND_SQL), False))
    return reduce(DataFrame.unionByName, out)


def judge(scored: DataFrame, prior: int = PRIOR, quantile: float = QUANTILE, spread: float = SPREAD) -> DataFrame:
    """Adds perplexity, threshold and kept. Quantiles are exact to 1/1000 of the log perplexity and come from counts by language and step."""
    mean = scored.where("n_words > 0").groupBy(F.col("lang").alias("_l")).agg((-F.sum(F.when(F.col("trusted"), F.col("log_p"))) / SCALE / F.sum(F.when(F.col("trusted"), F.col("n_words")))).alias("mean"))
    x = scored.join(F.broadcast(cut(mean)), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")  # a row for each language
    x = x.withColumn("log", F.when(F.col("n_words") > 0, (-F.col("log_p") / SCALE + prior * F.col("mean")) / (F.col("n_words") + prior)))
    steps = cut(x.where("trusted and log is not null").groupBy("lang", F.floor(F.col("log") * 1000).alias("step")).agg(F.count("*").alias("n")))
    at = "sum(n) over (partition by lang order by step)"
    run = steps.selectExpr("lang", "step", f"{at} as upto", "sum(n) over (partition by lang) as total")
    limits = run.groupBy(F.col("lang").alias("_l")).agg(F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("step"))).alias("mid"), F.min(F.when(F.col("upto") >= quantile * F.col("total"), F.col("step"))).alias("high"))
    limits = limits.select("_l", ((F.col("mid") + spread * (F.col("high") - F.col("mid")) + 1) / 1000).alias("limit"))
    x = x.join(F.broadcast(cut(limits)), F.col("lang").eqNullSafe(F.col("_l")), "left")
    kept = F.coalesce(F.col("log") <= F.col("limit"), F.lit(True))
    return x.select("doc_id", "h", "lang", "n_words", "trusted", F.round(F.exp("log"), 6).alias("perplexity"), F.round(F.exp("limit"), 6).alias("threshold"), kept.alias("kept"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("h")
