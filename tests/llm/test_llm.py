"""Brute-force versions, round trips, held-out accuracy and odd tables for the training-data operators."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findling.llm import fluency, licences, minhash, mixing, packing, personal, product, secrets, toxicity, transport
from findling.llm.shared import components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", None, "b", 3), (4, "one two", "de", None, 7), (None, "one two three four five six", None, None, 27), (5, "x" * 50_000 + " mail a@b.co token=abcdefghijkl12", "en", "b", 50_030), (6, "w " * 30_000, "en", "a", 60_000), (7, "same words here again and more", "en", "a", 30), (7, "same words here again and more", "en", "a", 30), (8, "same words here again and more", "en", "z", 30), (9, " \n\t ", "en", "a", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit("clash") for c in ("digest", "feature", "size", "bucket", "root", "shard", "h", "kept", "label", "_id")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 1), (7, 1, 0), (None, 1, 1), (99, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# Transport streams


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4607, 4608, 4609, 100_001])
def test_streams_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = data.ljust(max(576, -(-n // 576) * 576), b"\xff")
    found = transport.demux(transport.mux(payload))
    assert found.payload() == payload and (found.gaps, found.repeats, found.skipped, found.bad_sections) == (0, 0, 0, 0)
    assert found.programs == {1: transport.PMT_PID} and found.streams == {transport.STREAM_PID: 6}
    assert [u.pts for u in found.units] == [3600 * (k + 1) for k in range(len(found.units))] and found.units[0].access


def test_streams_with_faults():
    stream = transport.mux(b"a" * 576 * 24)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert transport.demux(b"".join(packets[:6] + packets[7:])).gaps == 1
    twice = transport.demux(b"".join(packets[:6] + [packets[5]] + packets[6:]))
    assert twice.repeats == 1 and twice.payload() == b"a" * 576 * 24
    assert transport.demux(b"\x00" * 7 + stream).skipped == 7
    broken = bytearray(stream)
    broken[9] ^= 1
    assert transport.demux(bytes(broken)).bad_sections == 1 and transport.demux(b"").packets == 0


def test_streams_of_odd_rows(odd):
    got = transport.read_streams(transport.store_streams(odd), keep=("doc_id", "n_bytes")).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for d, t, *_ in ODD if d == r["doc_id"])
        n, payload = transport.padded(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


# Personal data and secrets


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_personal(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and personal.luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((kind, *m.span()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a1@.+-4 (2)é", "0123456789- ", "a@.b", "+0123456789() -."])
def test_personal_base_spans(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
        assert slow_personal(text) == sorted(personal.base_spans(text)), text


def test_personal_candidates_in_capitals():
    text = "MAIL JOHN.SMITH [AT] EXAMPLE [DOT] COM"
    assert [(k, text[s:e]) for k, s, e, *_ in personal.candidates(text)[1]] == [("email", text[5:])]


def test_personal_huge_parts_are_no_addresses():
    assert personal.base_spans("0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1") == [("ip", 0, 5006)]


def test_personal_reliabilities_raise_the_likelihood():
    """Expectation-maximisation against a plain count: labelers that agree with the truth are found reliable."""
    r, seen = random.Random(5), collections.Counter()
    for _ in range(4000):
        yes = r.random() < 0.5
        say = lambda right: (1 if yes else -1) if r.random() < right else (-1 if yes else 1)  # noqa: B023, E731
        seen["email", (say(0.95), say(0.9), say(0.6), 0, say(0.8))] += 1
    model = personal.Model([(*k, n) for k, n in seen.items()], [(*k, 0, n) for k, n in seen.items()])
    for voter, right in zip(personal.VOTERS, (0.95, 0.9, 0.6, None, 0.8), strict=True):
        assert right is None or abs(model.reliability[voter][0] - right) < 0.04


def test_personal_finds_spelt_addresses(spark, docs):
    """Addresses with their signs spelt out, among sentences of the same form: most are found, and little else is."""
    r, tlds = random.Random(6), ["com", "org", "net", "de"]
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(4, 9)))
    texts, wanted = [], []
    for i in range(300):
        if i % 2:
            wanted.append(f"{name()}.{name()} [at] {name()} [dot] {r.choice(tlds)}")
            texts.append(f"{name()} {name()} {r.choice(['mail', 'contact', 'write to', ''])} {wanted[-1]} {name()}")
        else:
            wanted.append(None)
            texts.append(f"{name()} {name()} invoice {name()} (at) {name()}. {name().capitalize()} {name()}")
    own = spark.createDataFrame([(10**6 + i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    every = docs.select("doc_id", "text").unionByName(own.select("doc_id", "text"))
    got = {x["doc_id"]: x for x in personal.find(every, personal.fit(every)).where("doc_id >= 1000000").collect()}
    hit = sum(bool(w) and f"email:{t.index(w)}:{t.index(w) + len(w)}" in got[10**6 + i]["spans"] for i, (t, w) in enumerate(zip(texts, wanted, strict=True)))
    assert hit >= 0.8 * 150 and hit >= 0.9 * sum(x["n_added"] for x in got.values())


def test_personal_model_adds_and_keeps(spark, docs):
    rows = [(i, f"call me at +1 (555) 010-{1000 + i} or mail p{i}@x.org, card 4111 1111 1111 1111", "en", "a", 1) for i in range(40)] + [(100 + i, f"item {i} order 123456789012{i % 10}", "en", "a", 1) for i in range(40)] + [(200, "phone: (555) 010 2233 and name is Maria Lopez", "en", "a", 1)]
    own = spark.createDataFrame(rows, SCHEMA)
    model = personal.fit(own)
    base, found = model.spans(rows[0][1])
    assert set(base) <= set(found) and {k for k, *_ in base} == {"phone", "email", "card"}
    red = {r["doc_id"]: r["text"] for r in personal.redact(own, model, chars="n_chars").collect()}
    assert red[0] == "call me at <PHONE> or mail <EMAIL>, card <CARD>"
    assert personal.masked("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<CARD>f" and personal.masked(None, []) is None


def test_personal_and_secrets_of_odd_rows(spark, odd):
    for got in (personal.find(odd, personal.fit(odd)), secrets.find(odd, secrets.fit(odd))):
        rows = got.collect()
        assert len(rows) == len(ODD) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (1, 2, 3, 9))
        assert got.where("doc_id = 5").first()["spans"]
    empty = spark.createDataFrame([], SCHEMA)
    assert personal.find(empty, personal.fit(empty)).count() == 0 and secrets.find(empty, secrets.fit(empty)).count() == 0


SECRET = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)}


def test_secret_base_spans():
    r = random.Random(5)
    words = ["token", "ToKEN", " ", ":", "=", '"', "api_key", "apikey", "secret", "password", "passwd", "a1b2", "0123456789abcdef", "AKIA", "ABCD1234", "İ", "K", "/", "-", "x" * 5]
    for _ in range(8000):
        text = "".join(r.choice(words) for _ in range(r.randint(0, 14)))
        assert sorted((k, *m.span()) for k, (p, f) in SECRET.items() for m in p.finditer(text) if f(m)) == sorted(secrets.base_spans(text)), text


def _random_field(r):
    field = secrets.Field()
    field.w[:] = r.normal(size=field.w.shape)
    field.move += np.where(field.move < -1, 0, r.normal(size=(3, 3)))
    return field


def _paths(field, emit):
    """Every path's score."""
    return {tags: field.move[0, tags[0]] + sum(emit[i, t] for i, t in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:], strict=False)) + field.move[tags[-1], 0] for tags in np.ndindex(*[3] * len(emit))}


def test_field_decodes_best_path():
    r = np.random.default_rng(1)
    for turn in range(200):
        field, n = _random_field(r), int(r.integers(1, 8))
        emit = r.normal(size=(n, 3)) - [0, turn % 5, turn % 3]
        paths = _paths(field, emit)
        got = [0] * n
        for lo, hi in field.stretches(emit):
            got[lo:hi] = field.decode(emit[lo:hi])
        assert paths[tuple(got)] == pytest.approx(max(paths.values()))
        tags = field.decode(emit)
        begun = [(i, next((j for j in range(i + 1, n) if tags[j] != 2), n)) for i, t in enumerate(tags) if t == 1]
        norm = sum(np.exp(x) for x in paths.values())
        for (a, b), p in zip(begun, field.posteriors(emit, tags, begun), strict=True):
            assert p == pytest.approx(sum(np.exp(x) for t, x in paths.items() if list(t[a:b]) == tags[a:b] and (b == n or t[b] != 2)) / norm)


def test_field_gradient_and_likelihood():
    r = np.random.default_rng(2)
    field = _random_field(r)
    x, y = r.integers(0, 40, (3, 5, 4)), np.array([[0, 1, 2, 0, 1], [1, 2, 2, 2, 0], [0, 0, 0, 0, 0]])
    total, grad_w, grad_m = field.gradient([(x, y)])
    want = 0.0
    for own, tags in zip(x, y, strict=True):
        paths = _paths(field, field.w[own].sum(1))
        want += paths[tuple(tags)] - np.log(sum(np.exp(v) for v in paths.values()))
    assert total == pytest.approx(want)
    for target, grad, at in ((field.w, grad_w, (int(x[0, 1, 2]), 1)), (field.w, grad_w, (int(x[1, 0, 0]), 0)), (field.move, grad_m, (1, 2)), (field.move, grad_m, (0, 0))):
        target[at] += 1e-6
        assert (field.gradient([(x, y)])[0] - total) / 1e-6 == pytest.approx(grad[at], abs=1e-3)
        target[at] -= 1e-6


def test_field_scores_words_as_in_training():
    field = _random_field(np.random.default_rng(3))
    tokens = "let token = aB3dE9fG2h1Jk0 be x".split()
    assert np.allclose(field.emissions(tokens, [1, 2]), field.w[secrets.features(tokens, [1, 2])].sum(1))
    assert np.allclose(field.emissions(tokens[:1], [1, 2]), field.w[secrets.features(tokens[:1], [1, 2])].sum(1))


def test_field_finds_secrets_without_cue(spark, docs):
    """Random strings beside no cue word, in texts of the tables: most are found, and little else is."""
    r = random.Random(3)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    cued = docs.limit(400).withColumn("text", F.concat(F.col("text"), F.lit(" api_key = "), F.substring(F.sha2(F.col("text"), 256), 1, 32), F.lit(" and so on")))
    field = secrets.fit(docs.unionByName(cued))
    texts = [x["text"] for x in docs.where("length(text) between 200 and 2000").limit(300).collect()]
    hit = added = 0
    for i, text in enumerate(texts):
        words = text.split(" ")
        value = "".join(r.choice(alphabet) for _ in range(r.randint(20, 40)))
        if i % 2:
            words.insert(len(words) // 2, value)
        text = " ".join(words)
        base, every = secrets.spans(text, field)
        new = [text[s:e] for _, s, e, p in every if p is not None]
        assert [x[:3] for x in every if x[3] is None] == base
        added += len(new)
        hit += i % 2 and value in new
    assert hit >= 0.8 * len(texts) // 2 and hit >= 0.9 * added


@pytest.mark.parametrize("text", ["中" * 100_000, "https://a.b/c?x=1;" * 6000, "0123456789abcdefA " * 6000, "aB3" * 40_000, "Mr James Smith, " * 7000, "a@b.co " * 15_000, "4111 1111 1111 1111 " * 5000])
def test_long_texts_in_linear_time(text):
    field, model = _random_field(np.random.default_rng(4)), personal.Model([], [])
    field.w *= 0.01
    for call in (lambda: secrets.spans(text, secrets.Field()), lambda: secrets.base_spans(text), lambda: secrets.labelled(text), lambda: model.spans(text)):
        began = time.perf_counter()
        call()
        assert time.perf_counter() - began < 3


# Licences


def test_licence_base_places():
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice(["MIT ", "license ", "mit license", "\x85", "é", "-", "apache", "General Public License ", "  ", "1"]) for _ in range(r.randint(0, 12)))
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        norm = licences.normal(text)
        assert (norm.count(b" ") - 1 if len(norm) > 1 else 0) == len(words)
        for phrase in licences.PHRASES:
            own = phrase.decode().split()
            assert licences.phrase_places(norm, phrase) == [i for i in range(len(words)) if words[i : i + len(own)] == own]


def test_licence_edits():
    search = licences.Search(licences.NOTICES)
    find = lambda t: [(h[0], h[3]) for h in search.find(licences.normal(t))]
    assert find("x Relesed under the MIT Licence. y Licensd under CC BY-NC 4.0") == [("mit", 2), ("cc-by-nc", 1)]
    assert find("Licensed under CC BY-NC 4.0") == [("cc-by-nc", 0)] and find("released over there") == [] and find("") == []


def test_licences_of_odd_rows(spark, odd):
    got = licences.scan(odd).collect()
    assert len(got) == len(ODD) and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in got)
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0


# Near-duplicates


def slow_groups(rows, k=3, percent=85):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r[0])
    return sorted((str(r[0]), len(sets[i]), str(min((x for x in ids[top(i)] if x is not None), default=None))) for i, r in enumerate(rows))


def _near(df, **named):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(df, **named).collect())


def test_near_duplicates_of_odd_rows(spark, odd):
    assert _near(odd) == slow_groups(ODD)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 20)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(4)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            words[r.randrange(len(words))] = f"n{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    assert _near(df) == slow_groups(rows)
    assert _near(df, words=5, percent=80, bands=32) == slow_groups(rows, 5, 80)


def test_bbit_estimate(spark):
    r = np.random.default_rng(0)
    common, a, b = r.integers(0, 2**63, 800, np.uint64), r.integers(0, 2**63, 100, np.uint64), r.integers(0, 2**63, 100, np.uint64)
    h = np.concatenate([common, a, common, b])
    _, packed = minhash.signatures(minhash._mixed(h), np.array([900, 900]), 512, 2, 24, 4)
    x = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "a array<long>, b array<long>")
    got = x.select(minhash.estimate(minhash.equal_fields(F.col("a"), F.col("b"), 512, 2), 512, 2)).first()[0]
    assert abs(got - 0.8) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and len(got) == 71
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Embeddings


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[100:160] = x[:60] + r.normal(size=(60, 16)) * 0.08
    x[160:200] = x[0] + r.normal(size=(40, 16)) * 0.05
    x[200:210] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0] + [None] * 15), (405, [1.0, 2.0]), (None, x[2].tolist()), (3, x[3].tolist())]
    got = collections.Counter((str(a), n, str(c)) for a, n, c, _ in product.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect())
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = product.spanning(len(good), *np.nonzero(near))
    want = collections.Counter()
    for k, (i, _) in enumerate(good):
        want[str(i), int(near[k].sum()), str(min(good[j][0] for j in np.flatnonzero(root == root[k]) if good[j][0] is not None))] += 1
    for i in (400, 401, 402, 403, 404, 405):
        want[str(i), 0, str(i)] += 1
    assert sum((want & got).values()) >= 0.98 * sum(want.values()) and sum(got.values()) == len(rows)
    assert product.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [2, 4, 8])
def test_no_link_of_a_crowded_group_is_lost(spark, spread):
    """A large group that varies in few of 64 directions: every link is found."""
    r = np.random.default_rng(spread)
    basis = np.linalg.qr(r.normal(size=(64, spread + 1)))[0]
    group = basis[:, 0] + 0.4 * (r.normal(size=(900, spread)) @ basis[:, 1:].T)
    x = np.concatenate([group, r.normal(size=(1100, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = product.spanning(len(u), *np.nonzero(near))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (128, product.BLOCK):
        got = {a: (n, c) for a, n, c, _ in product.near_vectors(rows, block=block).collect()}
        assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(u))}


@pytest.mark.parametrize("spread", [3, 64])
def test_recall_beyond_the_sample(spark, spread):
    """24,000 vectors, a third in one group and a sixth near others: links found and components against all pairs."""
    r = np.random.default_rng(spread)
    basis = np.linalg.qr(r.normal(size=(64, 64)))[0]
    group = basis[:, 0] + 0.4 * (r.normal(size=(8000, spread)) @ basis[:, 1 : spread + 1].T) if spread < 64 else basis[:, 0] + 0.06 * r.normal(size=(8000, 64))
    free = r.normal(size=(12_000, 64))
    near = free[r.integers(0, 12_000, 4000)] + 0.42 * r.random((4000, 1)) * r.normal(size=(4000, 64))
    x = np.concatenate([group, free, near])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(1) - 1 for i in range(0, len(u), 2000)])
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(u)), "embedding": x.tolist()}))
    got = product.near_vectors(rows).orderBy("vec_id").toPandas()
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.99 * want.sum() and ((got.n_links.to_numpy() > 0) == (want > 0)).mean() > 0.999


def test_asymmetric_distances_bound_exact_ones():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = product.Index(x, 10)
    own, codes, errors = index.add(x)
    at = np.flatnonzero(own == 3)
    far = index.distances(x[:50], 3, codes[at])
    exact = np.linalg.norm(x[:50, None] - x[at][None], axis=2)
    assert (np.abs(far - exact) <= errors[at] + 1e-6).all()


# Mixing


def test_mixing_meets_targets(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 400)), "en", r.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for g in got:
        assert g["size"] == size[g["doc_id"]] and 0 <= g["taken"] <= 2 * g["size"]
        s = by[rows[g["doc_id"]][3]]
        s[0] += g["taken"]
        s[1], s[2] = g["target"], g["source_size"]
    assert sum(s[1] for s in by.values()) == pytest.approx(1.5 * sum(size.values()))
    for taken, target, own in by.values():
        assert abs(taken - target) <= 0.01 * target + 64 and target <= 2 * own + 1e-6


def test_mix_and_take_agree(spark, odd):
    x = odd.dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(x).collect()}
    made = collections.Counter()
    out = mixing.take(x, chars="n_chars")
    assert out.columns == x.columns
    for r in out.collect():
        made[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(made)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sainte_lague_equals_highest_quotients(spark):
    r = random.Random(8)
    sizes = [r.randint(0, 1000) for _ in range(12)]
    df = spark.createDataFrame([(1, i, s, 137) for i, s in enumerate(sizes)], "g int, i int, size long, seats long")
    got = {x["i"]: x["quota"] for x in mixing.apportion(df, ["g"], "size", "seats", "i").collect()}
    ranked = sorted(((-s / (2 * q - 1), i) for i, s in enumerate(sizes) for q in range(1, 400)))[:137]
    assert got == {i: sum(j == i for _, j in ranked) for i in range(12)}


# Packing


def test_packing_holds_every_token_once(spark, odd):
    json_text = packing.tokenizer_json()
    got = packing.pack(odd, json_text).toPandas()
    tok = packing.Encoder(json_text).tokenizer
    want = collections.Counter()
    for d, text, *_ in ODD:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            want[str(d), at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()), len(ids)] += 1
    have = collections.Counter((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    assert have == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert packing.pack(spark.createDataFrame([], SCHEMA), json_text).count() == 0


def test_encoder_equals_tokenizer():
    encoder = packing.Encoder(packing.tokenizer_json())
    texts = ["a\x1cb c\x85d e\xa0f", "x<|endoftext|>y", "ΑΣ Σ ΟΔΟΣ", "don't I'll 'S it's a.'s '.. x'y.z", "́ x", "", "   ", "1234 ½ ² 1.5e3 a1b2 ..a..", "﻿hi", "a b　c​d", "İI ı", "foo,. bar!! x%%% -- été, ñ. é̀.", "a—. “x”,. é.b", "z" * 60 + ". "]
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_tokenizer_beside_every_letter():
    encoder = packing.Encoder(packing.tokenizer_json())
    own = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] in "LM"]
    pool, r = [*"abcXYZ019 \n\t,.!'-_()@#<|>", *"İıéक़ßſKﬁ½²中—“😀Σς가가١\xa0\u3000\x1c\x85", "e\u0301", "\u0307", "\u200d", "<|endoftext|>"], random.Random(1)
    texts = [f"a{c}, {c}!x .{c} {c}'s (ab{c})" for c in own] + ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(30_000)]
    assert encoder.parted and encoder.plain
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, got, e in zip(texts, encoder.encode(texts), want, strict=True) if got != np.array(e.ids, "<u4").tobytes()] == []


def test_encoder_gives_whole_words_to_the_model_and_forgets_its_later_half(monkeypatch):
    encoder, r = packing.Encoder(packing.tokenizer_json()), random.Random(2)
    letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()]
    texts = ["".join(r.choice([*"abcdefg", *letters, *"éßñ"]) for _ in range(r.randint(1, 14))) for _ in range(5_000)]
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder, asked = packing.Encoder(packing.tokenizer_json()), []
    monkeypatch.setattr(encoder, "_ids", lambda run, f=encoder._ids: (asked.append(run), f(run))[1])
    monkeypatch.setattr(packing, "CACHED", 6)
    assert encoder.encode(["the élève naïve straße"]) and asked == []
    encoder.encode(["one two three four"])
    want = np.array(encoder.tokenizer.encode("the nine", add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(["the nine"]) == [want] and list(encoder) == [w.encode() for w in ("the", "élève", "naïve", "nine")]


def test_encoder_of_another_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a,": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    encoder = packing.Encoder(other.to_str())
    assert not encoder.parted and encoder.encode(["a, b c"]) == [np.array([0, 1, 2], "<u4").tobytes()]


def test_patterns_are_near_the_bound():
    r = np.random.default_rng(2)
    sizes, demand = np.unique(np.minimum(r.geometric(0.01, 5000), 512), return_counts=True)
    found = packing.patterns(sizes, demand, 512)
    assert (sum(own * n for own, n in found) == demand).all() and all(own @ sizes <= 512 for own, _ in found)
    assert sum(n for _, n in found) <= 1.01 * (sizes @ demand) / 512 + 2


# Toxicity and quality


def test_toxicity_on_held_out_labels(spark):
    r = random.Random(9)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "awful", "nasty"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [r.choice(words) for _ in range(60)]
        for _ in range(r.randint(2, 12) if toxic else 0):
            text[r.randrange(60)] = r.choice(bad) + r.choice(["", ".", "!"])
        rows.append((i, " ".join(text), "en", "a", 1))
        marks.append((i, 1, int(toxic)))
    own = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(own, spark.createDataFrame([m for m in marks if m[0] % 2 == 0 or m[0] % 4 == 1], "doc_id long, quality int, toxic int"))
    got = {g["doc_id"]: g for g in toxicity.grade(own, model).collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in marks]) > 0.98 and list(model.t) == sorted(model.t)
    heavy = [g["expected_severity"] for i, g in got.items() if sum(w.strip(".!") in bad for w in rows[i][1].split()) >= 9]
    light = [g["expected_severity"] for i, g in got.items() if 0 < sum(w.strip(".!") in bad for w in rows[i][1].split()) <= 3]
    assert np.mean(heavy) > np.mean(light) > 0.5


def test_toxicity_and_quality_of_odd_rows(spark, odd, labels):
    got = toxicity.grade(odd, toxicity.fit(odd, labels))
    assert got.count() == len(ODD) and got.where("toxic").count() == 0
    judged = fluency.judge(fluency.score(odd, labels)).collect()
    assert len(judged) == len(ODD) and all(r["kept"] for r in judged if r["doc_id"] in (1, 2, 9))
    empty, none = spark.createDataFrame([], SCHEMA), labels.limit(0)
    assert fluency.judge(fluency.score(empty, none)).count() == 0 and fluency.judge(fluency.score(odd, none)).where("not kept").count() == 0
    assert toxicity.grade(empty, toxicity.fit(empty, none)).count() == 0


def test_quality_against_a_plain_model(spark):
    """Log probabilities equal those of one dictionary-based model with the same discounts."""
    r = random.Random(10)
    vocab = [f"v{int(r.paretovariate(0.6))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 60))), "en", "a", 1) for i in range(120)]
    marks = [(i, int(i % 3 > 0), 0) for i in range(120)]
    got = {g["doc_id"]: g["log_p"] / fluency.SCALE for g in fluency.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    cache, pairs = fluency.Classes(), {}
    for i, text, *_ in rows:
        ids = [0, *(cache[w] for w in text.encode().split())]
        pairs[i] = list(zip(ids, ids[1:], strict=False))
    count = collections.Counter(p for i, q, _ in marks if q for p in pairs[i])
    total, seen, left = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter(w for _, w in count)
    for (v, _), n in count.items():
        total[v] += n
        seen[v][min(n, 3) - 1] += 1
    tally = collections.Counter(count.values())
    cut = fluency.Model._discounts(np.array([tally[k] for k in (1, 2, 3, 4)], float))
    parts = collections.Counter(left.values())
    low_cut = fluency.Model._discounts(np.array([parts[k] for k in (1, 2, 3, 4)], float))
    rest_low = (low_cut[1] * parts[1] + low_cut[2] * parts[2] + low_cut[3] * sum(n for k, n in parts.items() if k > 2)) / len(count) / (1 << fluency.CLASSES)
    for i, q, _ in marks:
        own, logp = collections.Counter(pairs[i]) if q else collections.Counter(), 0.0
        for v, w in pairs[i]:
            c = count[v, w] - own[v, w]
            gone = own[v, w] > 0 and c == 0
            n = max(left[w] - gone, 0)
            low = max(n - low_cut[min(n, 3)], 0) / len(count) + rest_low
            t = total[v] - own[v, w]
            rest = cut[1] * max(seen[v][0] - gone, 0) + cut[2] * seen[v][1] + cut[3] * seen[v][2]
            if t <= 0:
                p = low
            elif rest > 0:
                p = max(c - cut[min(c, 3)], 0) / t + min(rest / t, 1) * low
            else:
                p = max(max(c - cut[min(c, 3)], 0) / t, low * 1e-2)
            logp += np.log(max(p, 1e-12))
        assert got[i] == pytest.approx(logp, abs=1e-3)


def test_packets_grow_with_the_text_and_not_with_the_shards():
    """One block in 64 and in 4096 shards holds the same bigrams in about as many bytes."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 600, 800)
    words = r.zipf(1.3, int(sizes.sum())).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(22)
    first = np.concatenate([[np.uint64(0)], words[:-1]])
    held = {}
    for bits in ((4, 2), (8, 4)):
        packets = list(fluency.packed(first, words, sizes, bits))
        held[bits] = sum(len(d) for _, d in packets)
        trust = np.packbits(np.ones(len(sizes), bool)).tobytes()
        counts = sum(sum(fluency.Shard(s, [(trust, len(sizes), d)], bits).counts) for s, d in packets)
        assert counts == len(words)
    assert held[8, 4] < 2 * held[4, 2]


def test_different_words_never_share_a_count(spark):
    """Two words that 2^19 classes cannot tell apart: text of the one does not make the other known."""
    import xxhash

    seen = {}
    for i in range(20_000):
        h = xxhash.xxh3_64_intdigest(b"w%d" % i) >> 45
        if h in seen:
            break
        seen[h] = i
    x, y = f"w{seen[h]}", f"w{i}"
    rows = [(k, f"{x} and {x} or {x} not {k}", "en", "a", 1) for k in range(20)] + [(50, x, "en", "a", 1), (51, y, "en", "a", 1), (52, "unheard", "en", "a", 1)]
    marks = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["log_p"] for r in fluency.score(spark.createDataFrame(rows, SCHEMA), marks).collect()}
    assert got[51] == got[52] < got[50]


def test_quality_keeps_little_on_disk(spark):
    """A packet takes under 7 bytes a bigram (ten before) and comes back whole; shuffled files go as score ends."""
    r = np.random.default_rng(3)
    sizes = r.integers(1, 900, 400)
    words = np.array([fluency.Classes()[b"w%d" % x] for x in np.minimum(r.zipf(1.2, int(sizes.sum())), 10**6).tolist()], np.uint64)
    first = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
    packets = [d for _, d in fluency.packed(first, words, sizes, (4, 2))]
    coded = [fluency.coded(d) for d in packets]
    assert [fluency.decoded(x) for x in coded] == packets and sum(map(len, coded)) < 7 * len(words)
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.4, 50).tolist()), "en", "a", 1) for i in range(60)]
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs, before = spark.createDataFrame(rows, SCHEMA), files()
    fluency.score(docs, marks)
    end = time.time() + 20
    while files() > before and time.time() < end:  # they are removed behind the query's back
        time.sleep(0.2)
    assert files() <= before


@pytest.mark.parametrize("common_words", [1, 30])
def test_quality_whichever_words_are_common(spark, common_words):
    """Sums are the same, to rounding, whether a word's shares are added up where the text is read or asked for."""
    r = random.Random(12)
    rows = [(i, " ".join(f"v{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 50))), "en", "a", 1) for i in range(150)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    want = {x["doc_id"]: x["log_p"] for x in fluency.score(docs, marks).collect()}
    got = {x["doc_id"]: x["log_p"] for x in fluency.score(docs, marks, common_words=common_words).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 200 for i in want) and len(set(want.values())) > 50


def test_quality_passes_small_batches_of_text(spark, monkeypatch):
    """Each step of the score runs with small Arrow batches (whole texts pass outside the heap); the session's own setting returns."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, cut = spark.conf.get(name), fluency.cut
    monkeypatch.setattr(fluency, "cut", lambda df: (seen.append(spark.conf.get(name)), cut(df))[1])
    fluency.score(spark.createDataFrame([(1, "a b c", "en", "a", 1)], SCHEMA), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert seen and set(seen) == {"512"} and spark.conf.get(name) == before


# The pipeline


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_stages_keep_columns_and_take_effect(spark, docs):
    import corpus_pipeline
    from findling.llm.shared import cut

    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, cut(stage(spark, now, DIR))
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == docs.columns
    before, after = seen["near-duplicates"]
    rows = [tuple(r) for r in before.collect()]
    groups = slow_groups(rows, 5, 80)
    assert after.count() == len({c if n else d for d, n, c in groups}) and {str(r["doc_id"]) for r in after.collect()} == {c if n else d for d, n, c in groups}
    before, after = seen["personal data"]
    assert before.count() == after.count() and after.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
    before, after = seen["source mixture"]
    taken = mixing.mix(before).agg(F.sum("taken")).first()[0]
    assert taken == after.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_pipeline_of_odd_and_of_empty_tables(spark, odd):
    """Clashing column names, nulls and repeated rows go through all stages; an empty table stays empty."""
    import corpus_pipeline
    from findling.llm.shared import cut

    for rows in (odd.withColumns({"_0": F.lit("x"), "_H": F.lit("y"), "_text_h": F.lit("z")}), spark.createDataFrame([], SCHEMA)):
        now, empty = rows, rows.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, DIR))
            assert name == "packing" or now.columns == rows.columns
            assert now.isEmpty() == empty
            if name == "near-duplicates" and not empty:
                assert [r["doc_id"] for r in now.where("text = 'same words here again and more'").collect()] == [7]


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from findling.llm.shared import shared_dir

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context))
