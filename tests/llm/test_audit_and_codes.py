"""Divergence audit, byte pairs and vector codes against brute force, the tokenizer library and odd tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.llm import bytepairs, codes, divergence

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("term", "n", "docs", "size", "kept", "ids", "ends", "_text", "decoded", "vec", "v", "rank", "value")


# Source divergence audit


def slow_audit(rows, least=3, most=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [(s, w) for of, s, w in words if of == lang]
        seen = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter(t for of, w in own if of == s for t in w) for s in {s for s, _ in own}}
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the Cat sat", "en", "a", 0), (4, "the cat, THE dog", "en", "b", 0), (5, "the cat the É é Ünï", "en", "c", 0),
    (6, "one two", None, None, 0), (6, "one two", None, "", 0), (6, "one two", "", "z", 0), (None, "x" * 50_000 + " the", "en", "d", 0), (8, "the " * 30_000, "en", "a", 0),
    (9, "日本 日本", "ja", "a", 0), (10, "日本 é", "ja", "b", 0), (11, "日本 é 𝒜", "ja", "é", 0), (12, "z 𝒜 ﬀ", "ja", "𝒜", 0), (13, "𝒜 ﬀ z", "ja", "ﬀ", 0), (14, "𝒜 ﬀ z", "ja", "b", 0),
    (15, "alone", "xx", "a", 0), (16, "never", "yy", "a", 0), (17, "again", "yy", "b", 0),
]


def test_audit_of_odd_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)
    assert rows_of(divergence.audit(odd)) == slow_audit([r[1:4] for r in ODD])
    empty = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and dict(empty.dtypes)["value"] == "bigint" and dict(empty.dtypes)["rank"] == "int"


def test_audit_in_chunks_and_parts_is_the_same(spark, monkeypatch):
    """Ties among many terms, sums sent early and chunks of few terms change nothing."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyzé") for _ in range(rng.randrange(40))), rng.choice(["en", "de"]), rng.choice("pqrs"), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = slow_audit([r[1:4] for r in rows], most=7)
    parts = divergence.term_counts(docs, held=10)
    assert parts.count() > parts.select("lang", "source", "term").distinct().count()
    assert rows_of(divergence.audit(docs, most=7)) == want
    kept, groups = chunked(spark, docs)
    few = divergence.compared(kept, groups, most=7, cells=20)
    pairs = {tuple(r) for r in few.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value")).collect()}
    assert pairs == {(r[0], r[1], r[3], r[4]) for r in want if r[2] == "pair"}
    top = collections.defaultdict(list)
    for r in few.where("part = 'term'").collect():
        top[r["lang"], r["source"]].append((-r["value"], r["item"].encode()))
    assert {(lang, s, t.encode(), v) for lang, s, part, t, v, _ in want if part == "term"} == {(*k, t, -v) for k, found in top.items() for v, t in sorted(found)[:7]}


def chunked(spark, docs):
    counts = divergence.term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")).where("docs >= 3").select("lang", "term", "counts")
    sizes = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("size"))
    return kept, sizes.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang").select("lang", "source", "size", "kept")


def test_shares_of_very_large_counts():
    counts = np.array([[0, 5, 10**15 - 1, 9 * 10**15 - 1]], np.int64)
    got = divergence.shares(counts, np.array([9 * 10**15], np.int64))[0].tolist()
    assert got == [1 + 10**9 * (c + 1) // (9 * 10**15) for c in counts[0].tolist()]


# Byte-level byte pairs


@pytest.fixture(scope="module")
def known():
    import public_tokenizers
    import tiktoken

    file = bytepairs.rank_file()
    ranks = bytepairs.read_ranks(file)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return file, plain, bytepairs.Codec(ranks, bytepairs.classes_of(public_tokenizers.PATTERN))


def test_ids_are_the_librarys_on_random_texts(known):
    _, plain, codec = known
    rng = random.Random(5)
    some = ["'", "'s", "'re", "'ll", "'ve", "'t", "'S", " ", "  ", "\n", "\t", "a", "s", "re", "ll", "é", "1", "²", "٣", "!", "?", "\xa0", "　", "\x85", "\x1c", "日", "𝒜", "😀", "́", "T", "\r\n", "l", "m", "d"]
    texts = ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(20_000)]
    assert [i.tolist() for i in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_ids_are_the_librarys_on_every_code_point(known):
    _, plain, codec = known
    texts = [f"a{c} {c}1{c}{c}'{c}" for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000, 7)))]
    assert [i.tolist() for i in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_windows_hand_on_their_state(known):
    codec = known[2]
    points = bytepairs._points("it's  'll\n\n x'l 're!'s " * 5 + "\n")
    whole = bytepairs.starts_of(points, codec.kinds, np.array([40, len(points) - 1]))
    for window in (1, 2, 3, 7, 64):
        assert (bytepairs.starts_of(points, codec.kinds, np.array([40, len(points) - 1]), window) == whole).all()


def test_composition_is_associative():
    _, then = bytepairs._monoid()
    n = np.arange(len(then))
    a, b, c = np.meshgrid(n, n, n)
    assert (then[then[a, b], c] == then[a, then[b, c]]).all()


def test_merges_with_and_without_heap_agree(known, monkeypatch):
    _, plain, codec = known
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choices("abcdethé", k=rng.randrange(1, 60))).encode()
        with monkeypatch.context() as m:
            m.setattr(bytepairs, "SHORT", 0)
            by_heap = bytepairs.merged(piece, codec.ranks)
        assert by_heap == (bytepairs.merged_short(piece, codec.ranks) if piece not in codec.ranks else by_heap) == tuple(plain.encode_ordinary(piece.decode()))


@pytest.mark.parametrize("text", ["x" * 100_000, "ab" * 50_000, " " * 100_000 + "a", "日" * 30_000, "word " * 40_000])
def test_long_texts_and_pieces(known, text):
    codec, start = known[2], time.perf_counter()
    ids = codec.encode([text])[0]
    assert codec.decode(ids) == text.encode() and codec.offsets(ids)[-1] == len(text.encode())
    assert time.perf_counter() - start < 5


def test_round_trip_of_tables(spark, known):
    file, plain, _ = known
    rows = [*ODD, (20, "don't  stop\n", None, None, 0), (20, "don't  stop\n", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})
    got = bytepairs.decode(bytepairs.encode(docs, file, keep=("doc_id", "text", "n")), file).collect()
    assert sorted((r["text"] or "", tuple(r["ids"])) for r in got) == sorted((t or "", tuple(plain.encode_ordinary(t or ""))) for _, t, *_ in rows)
    for r in got:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["n"] == "clash"
        assert r["ends"] == np.cumsum([len(plain.decode_single_token_bytes(i)) for i in r["ids"]], dtype=int).tolist()
    assert bytepairs.encode(spark.createDataFrame([], SCHEMA), file).collect() == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_op12_equals_the_library(spark, known):
    plain = known[1]
    want = set()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in bytepairs.op12_byte_pairs(spark, DIR).collect()} == want


# Vector codes


def slow_codes(rows, rounds=4, entries=256):
    """rows: (vec_id, label, vector) of one length."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    cut = [k * d // 4 for k in range(5)]
    parts = [[r[2][a:b] for r in kept] for a, b in itertools.pairwise(cut)]
    books = [p[:entries] for p in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k, part in enumerate(parts):
            own = collections.defaultdict(list)
            for x in part:
                own[near(x, books[k])[1]].append(x)
            books[k] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else entry for e, entry in enumerate(books[k])]
    found = [[near(x, books[k]) for x in part] for k, part in enumerate(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = [(i, "".join(f"{f[n][1]:02x}" for f in found), sum(f[n][0] for f in found), label) for n, (i, label, _) in enumerate(kept)]
    sums = collections.Counter()
    for *_, error, label in out:
        sums[label] += error
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=repr)


def coded(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize(("d", "n", "spread"), [(8, 400, 0.3), (10, 60, 3.0), (3, 20, 1.0), (64, 300, 0.001)])
def test_codes_equal_brute_force(spark, d, n, spread):
    rng = np.random.default_rng(d)
    vectors = rng.normal(0, spread, (n, d)).round(3).tolist()
    vectors[5] = vectors[4]
    rows = [(int(i) if i % 17 else None, f"l{i % 3}" if i % 4 else None, v) for i, v in zip(rng.permutation(n), vectors, strict=True)]
    rows += [(1, "l1", None), (2, "l1", [None] * d), (3, "l1", [math.nan] * d), (-5, "l1", [math.inf] * d), rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)
    assert coded(codes.compress(table)) == slow_codes(rows)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, "a", None), (2, "a", [1e30, 0.0])], schema)).collect() == []
    rows = [(1, "a", []), (2, "a", [0.5, -0.0001]), (3, None, [1.0] * 8), (4, None, [2.0] * 8), (4, None, [2.0] * 8)]
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "00000000", 0, 0), (4, "01010101", 0, 0)}


def test_screening_keeps_near_ties():
    """Large components, where a float32 product alone picks other entries."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(10**7), 10**7, 16)
    book = base + rng.integers(-2, 3, (256, 16))
    x = base + rng.integers(-2, 3, (2000, 16))
    exact = ((x[:, None] - book) ** 2).sum(2)
    at, far = codes.nearest(x, book)
    assert (at == exact.argmin(1)).all() and (far == exact.min(1)).all()
    plain = ((book.astype(np.float64) ** 2).sum(1) - 2.0 * (x.astype(np.float32) @ book.astype(np.float32).T)).argmin(1)
    assert (plain != at).any()
    assert (codes.nearest(np.zeros((3, 16), int), np.zeros((5, 16), int))[0] == 0).all()


def test_codes_approximate_their_vectors(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    kept = codes.integers(table, "vec_id", "embedding", "label").cache()
    books = codes.fit(kept)
    got = codes.decode(codes.encode(kept, books), books).join(table.select("vec_id", "embedding"), "vec_id").collect()
    errors = {r["vec_id"]: ((np.array(r["vector"]) - np.array(r["embedding"])) ** 2).sum() for r in got}
    assert all(abs(errors[r["vec_id"]] * 1024**2 - r["error"]) <= 64 + 2 * (64 * r["error"]) ** 0.5 for r in got)
    kept.unpersist()


# Earlier operators: what their mends must keep


def test_capitals_before_marks_have_the_tokenizers_ids():
    """Every ASCII letter before every combining mark, and marks in longer texts: composed as the tokenizer composes them."""
    import string
    import unicodedata

    from findling.llm import packing

    encoder = packing.Encoder.of(packing.tokenizer_json())
    marks = [chr(c) for c in range(0x300, 0x370)] + [c for c in map(chr, range(0x370, 0x110000)) if unicodedata.combining(c)][::9]
    texts = [f"{a}{m}" for a in string.ascii_letters for m in marks]
    rng = random.Random(4)
    texts += ["".join(rng.choices("YJWTHabc ,'12" + "".join(marks[:20]), k=rng.randrange(1, 25))) for _ in range(5000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


def test_many_notices_take_linear_time():
    from findling.llm import licences

    search, took = licences.Search(licences.NOTICES), []
    for n in (4_000, 16_000):
        norm = licences.normal("all rights reserved xx yy zz " * n)
        start = time.perf_counter()
        found = search.find(norm)
        took.append(time.perf_counter() - start)
        assert [f[1] for f in found] == list(range(0, 6 * n, 6))
    assert took[1] < 8 * took[0] + 0.5


def _distances(notice: str, text: str) -> int:
    """The fewest edits that turn the notice into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edited_notices_are_found():
    """As many random edits as a notice may have: found, and with no more edits than a full table of distances allows."""
    from findling.llm import licences

    search, rng = licences.Search(licences.NOTICES), random.Random(9)
    for notice, _, most in search.notices:
        for _ in range(4):
            text = list(notice)
            for _ in range(rng.randrange(most + 1)):
                at = rng.randrange(1, len(text) - 1)
                text[at : at + rng.randrange(2)] = rng.choice(["", "q", "z"])
            norm = licences.normal("before it " + "".join(text) + " behind it")
            found = search.find(norm)
            assert found or _distances(notice, norm.decode()) > most
            for f in found:
                assert f[3] >= min(_distances(n, norm.decode()) for n, own, _ in search.notices if own == f[0])


def _few_directions(n, d, seed=0):
    """Half of n vectors that vary in d directions, and for each a neighbour at a cosine of 0.90 to 0.91."""
    rng = np.random.default_rng(seed)
    frame, _ = np.linalg.qr(rng.normal(size=(64, d)))
    x = rng.normal(size=(n // 2, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.91, (n // 2, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * e]) @ frame.T


def test_links_count_at_both_ends_beyond_the_sample(spark):
    """A small sample, so that many lists are split and links are found from one end only."""
    from findling.llm import product

    x = _few_directions(3000, 8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in product.near_vectors(rows, sample=600, lists=40).collect()}
    want = (x @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and found.sum() % 2 == 0


@pytest.mark.parametrize(("n", "d"), [(60_000, 8), (60_000, 12), (60_000, 16), (60_000, 24), (60_000, 64)])
def test_reach_is_wide_enough(n, d):
    """The rule of the calibration on held-out vectors: 0.99 of their links, probed from either side."""
    from findling.llm import product

    x = _few_directions(n, d)
    order = np.random.default_rng(1).permutation(n)
    index = product.Index(x[order[:8192]], n // product.PER_LIST // 2)
    lists = product.nearest(x, index.coarse)
    needs = lambda asks: np.concatenate([index.missed(asks, x[i : i + 2048], lists[i : i + 2048])[1] for i in range(0, n, 2048)])
    seen = np.sort(needs(x[order[: product.ASKED]]))
    reach = max(product.REACH * 1000, seen[int((1 - product.LOST) * (len(seen) - 1)) + 1 if len(seen) > 1 else 0] + 1)
    assert (needs(x[order[-500:]]) <= reach).mean() >= 0.99
