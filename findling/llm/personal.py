"""Personal data by weak supervision.

Loose patterns propose spans; regex, checksum, gazetteer, context and boundary labelers vote on each (yes, no or
abstain). The votes of all documents are counted by pattern (a bounded table), expectation-maximisation estimates
each labeler's reliability and a posterior for each pattern, and a logistic span classifier is trained on these. Beside
the votes it sees what no labeler looks at: the word before the span, the span's character shape and its size. It is
trained on the `SAMPLE` most frequent kinds of candidates at most (candidates alike in all of this are one kind, with
their number), the reliabilities on all of them. Spans in the base formats stand whatever the classifier says; it
decides on the other candidates, and its probability comes with every span that it adds.

Base formats, leftmost and non-overlapping within a kind: mail addresses, internet addresses (parts up to 255),
cards (12 to 19 digits, Luhn) and international phone numbers (9 to 15 digits). Positions are code points, ends exclusive.

Defined cases: null or empty text has no spans (its base digest is that of the empty string); ties in start go by
kind as listed; repeated rows are counted and returned each; a table without candidates gets a model that adds
nothing; very long texts are read whole, in time that grows with their length; an empty table gives no rows; extra columns are ignored (`redact` passes them on).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import cut, releasing, table

KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE = KINDS[:4]
SAMPLE, LOOKS = 20_000, 64  #: kinds of candidates that train the classifier; buckets of words before and of character shapes

# The base formats written so that no start is tried twice: a digit run is entered at its first digit only, a mail address from its @.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser candidates.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,63}(?: ?[\[(]? ?(?:dot|\.) ?[\])]? ?[A-Za-z]{2,24})+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(?<![0-9+)(.-] )(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{3,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9.-])")
_ID = re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "name is", "named", "ich heiße", "je m'appelle", "me llamo")
_NAME = re.compile(r"(?:\.? )((?:[A-ZÀ-Þ][a-zà-ÿ'-]+)(?: [A-ZÀ-Þ][a-zà-ÿ'-]+){0,2})")

CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "schreib", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "client"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "account", "konto"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "anruf", "appel", "llam", "contact"),
    "id": ("ssn", "social", "iban", "passport", "id", "ausweis", "konto", "account"),
    "name": ("name", "signed", "contact", "dear", "heiß", "appelle", "llamo"),
}
AGAINST = ("order", "invoice", "version", "isbn", "page", "build", "item", "total", "lot", "nr.", "no.", "#")
GAZETTEER = {
    "email": ("com", "org", "net", "de", "fr", "es", "edu", "io", "info", "eu"),
    "ip": (),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38"),
    "phone": ("1", "34", "33", "44", "49", "39", "41", "43", "0"),
    "id": ("DE", "FR", "ES", "GB", "NL", "IT", "AT", "CH", "BE"),
    "name": ("james", "john", "robert", "michael", "mary", "anna", "maria", "peter", "paul", "hans", "karl", "sophie", "marie", "jean", "pierre", "jose", "juan", "carmen", "david", "sarah"),
}
VOTERS = ("regex", "checksum", "gazetteer", "context", "boundary")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_parts(quad: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in quad.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans in the base formats, by kind."""
    out, end = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            back = max(end, m.start() - 1)
            while back > end and (c := text[back - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                back -= 1
            local = _LOCAL.search(text, back, m.start()) if m.start() > end else None
            if local and local.start() < m.start():
                out.append(("email", local.start(), m.end()))
                end = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _small_parts(m[0])] if "." in text else []
    out += [("card", *m.span()) for m in _CARD.finditer(text) if luhn(_digits(m[0]))]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def loose_spans(text: str, digits: bool) -> list[tuple[str, int, int]]:
    out = []
    if digits:
        out += [("card", *m.span()) for m in _CARD.finditer(text)]
        out += [("ip", *m.span()) for m in _IP.finditer(text)]
        out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        out += [("id", *m.span()) for m in _ID.finditer(text)]
    if ("(" in text or "[" in text) and "at" in text.lower():
        out += [("email", *m.span()) for m in _SPELT.finditer(text)]
    for title in TITLES:
        at = text.find(title)
        while at >= 0:
            if (m := _NAME.match(text, at + len(title))) and (at == 0 or not text[at - 1].isalnum()):
                out.append(("name", *m.span(1)))
            at = text.find(title, at + len(title))
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """What each labeler says: 1, -1 or 0."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 1]
    if kind == "card":
        sum_ok = luhn(digits) and len(set(digits)) > 2
    elif kind == "ip":
        sum_ok = max(map(len, span.split("."))) <= 3 and _small_parts(span)
    elif kind == "phone":
        sum_ok = 9 <= len(digits) <= 15
    elif kind == "id" and "-" in span:
        sum_ok = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    elif kind == "id":
        plain = span.replace(" ", "")
        sum_ok = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    else:
        sum_ok = None
    if kind == "email":
        listed = span.rpartition(".")[2].lower() in GAZETTEER[kind] or span.lower().split()[-1] in GAZETTEER[kind]
    elif kind == "name":
        listed = span.split()[0].lower() in GAZETTEER[kind]
    elif kind == "ip":
        listed = None if not sum_ok else not span.startswith(("0.", "127."))
    elif kind == "id":
        listed = span[:2] in GAZETTEER[kind] if span[0].isalpha() else None
    else:
        listed = digits.startswith(GAZETTEER[kind])
    said = 1 if any(w in before for w in CONTEXT[kind]) else -1 if any(w in before for w in AGAINST) else 0
    apart = not (start and text[start - 1].isalnum()) and not after.isalnum()
    sign = lambda x: 0 if x is None else 1 if x else -1
    return 1 if base else 0, sign(sum_ok), sign(listed), said, 1 if apart else -1


_LAST_WORD = re.compile(r"(\w{1,24})\W*\Z")


def _shape(span: str) -> str:
    """Digits, capitals and small letters as 0, A, a, each run as one."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub("[0-9]", "0", span))
    return re.sub(r"(.)\1+", r"\1", kinds, flags=re.S)


def looks(text: str, start: int, end: int) -> int:
    """Size, symbols, character shape and the word before a span, each in buckets, as one number."""
    span, before = text[start : min(end, start + 96)], _LAST_WORD.search(text, max(0, start - 32), start)
    word = before[1].lower() if before else ""
    size = min(7, (end - start) // 4) * 8 + min(7, sum(not c.isalnum() for c in span))
    return (size * LOOKS + zlib.crc32(_shape(span).encode("utf-8", "replace")) % LOOKS) * LOOKS + zlib.crc32(word.encode("utf-8", "replace")) % LOOKS


def candidates(text: str | None) -> tuple[list, list]:
    """Base spans, and all candidates as (kind, start, end, is base, votes, looks)."""
    if not text:
        return [], []
    digits = re.search("[0-9]", text) is not None
    base = base_spans(text) if digits or "@" in text else []
    starts, ends = [], []  # of the base spans' union
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    every, seen = [(*b, True) for b in base], set()
    for x in loose_spans(text, digits):
        if x not in seen and ends[(at := bisect.bisect_right(ends, x[1])) : at + 1] and starts[at] < x[2]:
            continue
        if x not in seen:
            seen.add(x)
            every.append((*x, False))
    return base, [(kind, s, e, is_base, votes(text, kind, s, e, is_base), looks(text, s, e)) for kind, s, e, is_base in every]


class Model:
    """Labeler reliabilities and the span classifier; a few hundred numbers."""

    SIZES = len(KINDS) + 3 * len(VOTERS)

    def __init__(self, cast: list[tuple[str, tuple[int, ...], int]], rows: list[tuple[str, tuple[int, ...], int, int]]):
        """cast: (kind, votes, count) of all candidates; rows: (kind, votes, looks, count) of those that train the classifier."""
        self.weights = np.zeros(self.SIZES + 16 + 2 * LOOKS + 1)
        self.weights[-1] = -1.0
        self.reliability = {v: (0.5, 0.5) for v in VOTERS}
        self.posterior: dict[tuple, float] = {}
        if cast:
            self._estimate(cast)
            self._fit(rows)

    def features(self, kind: str, cast: tuple[int, ...], seen: int) -> list[int]:
        """Those that are 1."""
        size, shape, word = seen // LOOKS**2, seen // LOOKS % LOOKS, seen % LOOKS
        return [KINDS.index(kind), *(len(KINDS) + 3 * i + v + 1 for i, v in enumerate(cast)), self.SIZES + size // 8, self.SIZES + 8 + size % 8, self.SIZES + 16 + shape, self.SIZES + 16 + LOOKS + word, len(self.weights) - 1]

    def _estimate(self, rows: list) -> None:
        """Expectation-maximisation."""
        n = np.array([r[2] for r in rows], float)
        cast = np.array([r[1] for r in rows]) + 1
        kinds = np.array([KINDS.index(r[0]) for r in rows])
        # labelers start as better than chance, with a pseudo-count that keeps a labeler that never votes there
        p = np.stack([np.tile([0.1, 0.3, 0.6], (len(VOTERS), 1)), np.tile([0.6, 0.3, 0.1], (len(VOTERS), 1))])
        prior, start = np.full(len(KINDS), 0.5), p * 20
        for _ in range(200):
            like = np.stack([np.log(np.stack([prior, 1 - prior])[c][kinds]) + np.log(p[c][np.arange(len(VOTERS)), cast]).sum(1) for c in (0, 1)])
            yes = 1 / (1 + np.exp(np.clip(like[1] - like[0], -60, 60)))
            old, p = p, np.empty_like(p)
            for c, w in ((0, yes * n), (1, (1 - yes) * n)):
                for v in range(3):
                    p[c, :, v] = start[c, :, v] + (w[:, None] * (cast == v)).sum(0)
                p[c] /= p[c].sum(1, keepdims=True)
            total = np.bincount(kinds, n, len(KINDS)) + 4
            prior = (np.bincount(kinds, yes * n, len(KINDS)) + 2) / total
            if np.abs(p - old).max() < 1e-6:
                break
        self.reliability = {v: (round(float(p[0, i, 2]), 4), round(float(p[1, i, 0]), 4)) for i, v in enumerate(VOTERS)}
        self.posterior = {r[:2]: float(q) for r, q in zip(rows, yes, strict=True)}

    def _fit(self, rows: list, decay: float = 1e-3) -> None:
        """Newton steps on the classifier's cross entropy with the posteriors, each looks alike weighing as often as it was seen."""
        x = np.zeros((len(rows), len(self.weights)))
        for i, r in enumerate(rows):
            x[i, self.features(r[0], r[1], r[2])] = 1
        n = np.array([r[3] for r in rows], float)
        yes, share, w = np.array([self.posterior[r[0], r[1]] for r in rows]), n / n.sum(), np.zeros(x.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (share * (q - yes)) + decay * w
            hessian = (x * (share * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def probability(self, kind: str, cast: tuple[int, ...], seen: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.features(kind, cast, seen)].sum(), -30, 30))))

    def scored(self, text: str | None) -> tuple[list, list]:
        """Base spans and all spans, each by start and kind as listed; the latter with the classifier's probability, null for base ones."""
        base, every = candidates(text)
        found = [(k, s, e, None if is_base else self.probability(k, cast, seen)) for k, s, e, is_base, cast, seen in every]
        order = lambda x: (x[1], KINDS.index(x[0]), x[2])
        return sorted(base, key=order), sorted((x for x in found if x[3] is None or x[3] > 0.5), key=order)

    def spans(self, text: str | None) -> tuple[list, list]:
        base, every = self.scored(text)
        return base, [x[:3] for x in every]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """The model from the candidates of all documents, counted by kind, votes and looks. To the driver come the counts by kind and votes (6 * 3^5 rows at most) and `sample` kinds of candidates."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"kind": pa.array([k[0] for k in seen], pa.string()), "cast": pa.array([",".join(map(str, k[1])) for k in seen], pa.string()), "looks": pa.array([k[2] for k in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                for kind, _, _, _, cast, look in candidates(t.as_py())[1]:
                    key = (kind, cast, look)
                    seen[key] = seen.get(key, 0) + 1
            if len(seen) > 100_000:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "kind string, cast string, looks int, n long")
    counted = cut(counted.groupBy("kind", "cast", "looks").agg(F.sum("n").alias("n")))
    cast = counted.groupBy("kind", "cast").agg(F.sum("n").alias("n")).orderBy("kind", "cast").collect()
    rows = counted.orderBy(F.desc("n"), "kind", "cast", "looks").limit(sample).collect()
    of = lambda r: (r["kind"], tuple(map(int, r["cast"].split(","))))
    return Model([(*of(r), r["n"]) for r in cast], [(*of(r), r["looks"], r["n"]) for r in rows])


def find(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, added) for each row; added: kind:start:end:probability of the spans that the classifier adds."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind, held = own.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [held.value.scored(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            new = [[x for x in every if x[3] is not None] for _, every in both]
            added = [pa.array([len(x) for x in new], pa.int64()), pa.array([",".join(f"{k}:{s}:{e}:{p:.4f}" for k, s, e, p in x) for x in new], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined([x[:3] for x in every]) for _, every in both], pa.string()), *added], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "added"])

    return own.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, added string")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += text[at:start], f"<{kind.upper()}>"
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text: str = "text", chars: str | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind; chars names a column that then holds the text's length."""
    names, held = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [masked(t := x.as_py(), held.value.spans(t)[1]) for x in batch.column(at)]
            columns = batch.columns
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    if chars:
        out = out.withColumn(chars, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType))
    return out


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
