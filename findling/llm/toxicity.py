"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their prefixes of four to six characters, hashed; those that the labels tell apart (by
chi-square over the training documents) are kept, `FEATURES` at most. Training documents are the `SAMPLE` labelled
ones with the smallest key hashes. Labelled toxic documents get a severity grade from how many telling tokens they
hold (thirds of the training documents), the others grade 0. The model has one weight for each feature,
shared by all thresholds, and ordered thresholds: P(grade > k) = s(w x - t_k). A document's expected severity is
the sum of these probabilities over k, and it counts as toxic when P(grade > 0) reaches one half.

Defined cases: null or empty text has no features; labels that are null or name no document are ignored, repeated
labels count as toxic if one of them does; without both kinds of labels nothing is toxic; repeated rows are
returned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import table

SAMPLE, FEATURES, HASHES, LEAST_DOCS, GRADES, CACHED = 20_000, 4_096, 1 << 18, 5, 3, 200_000
_EDGE = ".,;:!?%&*$#|()[]{}\"'<>-_=+/\\~`^@"


def features(token: str) -> tuple[int, ...]:
    word = token.strip(_EDGE)
    names = [f"w{word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)] if word else []
    return tuple(xxhash.xxh32_intdigest(n) % HASHES for n in names)


class Tokens(dict):
    """The wanted features of tokens; all are wanted if none are named."""

    def __init__(self, wanted: dict[int, int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = features(token)
        if self.wanted is not None:
            found = tuple(self.wanted[f] for f in found if f in self.wanted)
        self[token] = found
        return found

    def of(self, text: str | None) -> tuple[int, list[tuple[int, ...]]]:
        """The number of words, and the features of those that have any."""
        if len(self) > CACHED:
            self.clear()
        words = text.lower().split() if text else []
        return len(words), list(filter(None, map(self.__getitem__, words)))


class Ordinal:
    """Cumulative-link regression."""

    def __init__(self, wanted: dict[int, int], grades: int = GRADES):
        self.wanted, self.w, self.t = wanted, np.zeros(len(wanted)), np.arange(grades, dtype=float) + 3

    def fit(self, rows: list[dict[int, float]], y: np.ndarray, rounds: int = 600, rate: float = 0.2, decay: float = 1e-4) -> None:
        """Full-batch Adagrad on the likelihood; thresholds are kept in order by their gaps."""
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.array([f for r in rows for f in r], np.int64)
        value = np.array([v for r in rows for v in r.values()])
        k = len(self.t)
        part = np.concatenate([[self.t[0]], np.log(np.diff(self.t))])
        seen_w, seen_p = np.full_like(self.w, 1e-8), np.full_like(part, 1e-8)
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for _ in range(rounds):
            t = np.concatenate([[part[0]], part[0] + np.cumsum(np.exp(part[1:]))])
            z = np.bincount(doc, value * self.w[at], len(rows))
            over = np.hstack([np.ones((len(rows), 1)), s(z[:, None] - t), np.zeros((len(rows), 1))])
            slope = over * (1 - over)
            p = np.maximum(over[np.arange(len(rows)), y] - over[np.arange(len(rows)), y + 1], 1e-12)
            up, down = slope[np.arange(len(rows)), y] / p, slope[np.arange(len(rows)), y + 1] / p
            grad_w = np.bincount(at, value * (up - down)[doc], len(self.w)) / len(rows) - decay * self.w
            grad_t = np.array([(down[y == i]).sum() - (up[y == i + 1]).sum() for i in range(k)]) / len(rows)
            grad_p = np.concatenate([[grad_t.sum()], [np.exp(part[i]) * grad_t[i:].sum() for i in range(1, k)]])
            for v, g, seen in ((self.w, grad_w, seen_w), (part, grad_p, seen_p)):
                seen += g * g
                v += rate * g / np.sqrt(seen)
        self.t = np.concatenate([[part[0]], part[0] + np.cumsum(np.exp(part[1:]))])

    def over(self, counts: dict[int, float]) -> list[float]:
        """P(grade > k) for each k."""
        z = sum(self.w[f] * v for f, v in counts.items())
        return (1 / (1 + np.exp(-np.clip(z - self.t, -40, 40)))).tolist()


def scaled(hits: list[tuple[int, ...]]) -> dict[int, float]:
    counts = Counter(f for h in hits for f in h)
    return {f: 1 + float(np.log(n)) for f, n in sorted(counts.items())}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most: int = FEATURES, grades: int = GRADES) -> Ordinal:
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # sample rows at most
    train = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(marks, "_id").select("_y", "text")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, tokens = np.zeros((2, HASHES), np.int64), np.zeros(2, np.int64), Tokens()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[int(y > 0)] += 1
                if found := {f for h in tokens.of(t.as_py())[1] for f in h}:
                    counts[int(y > 0), list(found)] += 1
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n[0], *counts[0, some]], pa.int64()), pa.array([n[1], *counts[1, some]], pa.int64())], ["f", "no", "yes"])

    counted = train.mapInArrow(present, "f long, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).persist()
    total = counted.where("f = -1").first()
    no, yes = (total["no"], total["yes"]) if total else (0, 0)
    if not no or not yes:
        counted.unpersist()
        return Ordinal({}, grades)
    odds = F.log(((F.col("yes") + 0.5) / (yes + 1)) / ((F.col("no") + 0.5) / (no + 1)))
    expected = (F.col("yes") + F.col("no")) * yes / (no + yes)
    telling = counted.where((F.col("f") >= 0) & (F.col("yes") + F.col("no") >= LEAST_DOCS)).select("f", odds.alias("odds"), ((F.col("yes") - expected) ** 2 / expected).alias("chi"))
    chosen = telling.where("chi > 20 and abs(odds) > 0.7").orderBy(F.desc("chi"), "f").limit(most).collect()
    counted.unpersist()
    wanted = {r["f"]: i for i, r in enumerate(chosen)}
    strong = np.array([r["odds"] > 1.5 for r in chosen], bool)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(wanted)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, hits = tokens.of(t.as_py())
                counts = scaled(hits)
                for column, v in zip(out, (int(y > 0), float(sum(any(strong[f] for f in h) for h in hits)), list(counts), list(counts.values())), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.float64()))], ["y", "burden", "at", "value"])

    seen = train.mapInArrow(rows, "y int, burden double, at array<int>, value array<double>").collect()  # of the sample
    seen.sort(key=lambda r: (r["y"], r["burden"], r["at"], r["value"]))
    burden = np.array([r["burden"] for r in seen])
    y = np.array([r["y"] for r in seen])
    bounds = np.quantile(burden[y > 0], np.arange(1, grades) / grades)
    model = Ordinal(wanted, grades)
    model.fit([dict(zip(r["at"], r["value"], strict=True)) for r in seen], np.where(y > 0, 1 + np.searchsorted(bounds, burden, side="right"), 0))
    return model


def grade(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for each row; grade is the most likely one."""
    own, held = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(held.value.wanted)
        for batch in batches:
            over = [held.value.over(scaled(tokens.of(t.as_py())[1])) for t in batch.column(1)]
            likely = [int(np.argmax(-np.diff([1.0, *p, 0.0]))) for p in over]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(sum(p), 9) for p in over], pa.float64()), pa.array(likely, pa.int32()), pa.array([round(p[0], 9) for p in over], pa.float64()), pa.array([p[0] >= 0.5 for p in over], pa.bool_())], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, expected_severity double, grade int, p_toxic double, toxic boolean")


def op5_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
