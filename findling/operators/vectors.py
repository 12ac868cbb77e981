"""Exact vector search: normalisation, top-k cosine in blocks, candidate regrouping, identities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_FLOATS = 8_000_000  #: of either side in one task


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is null, empty, zero or not finite."""
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm(v) > 0)
    return F.when(good, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, candidate_id, score): the k nearest by cosine, ties by id. Both sides are dealt into blocks of a bounded size by hash; each pair of blocks is one task, which keeps k for each query, and these are merged."""
    fixed = corpus.select(F.col(key).alias("id"), unit(F.col(vector)).alias("u")).where("u is not null")
    asked = queries.select(F.col(key).alias("id"), unit(F.col(vector)).alias("u")).where("u is not null")
    size = lambda rows: rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("u")), F.lit(1)).alias("d")).first()
    held, asking = size(fixed), size(asked)
    if k <= 0 or not held["n"]:
        raise ValueError("k must be positive and the corpus not empty")
    blocks, chunks = (max(1, -(-s["n"] * s["d"] // BLOCK_FLOATS)) for s in (held, asking))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "u", dealt(chunks).alias("i")).select("*", every(blocks).alias("j"))
    right = fixed.select("id", "u", dealt(blocks).alias("j")).select("*", every(chunks).alias("i"))

    def nearest(asks: pa.Table, own: pa.Table) -> pa.Table:
        ids, x, y = own.column("id").to_numpy(), _rows(own), _rows(asks)
        out: tuple[list, list, list] = ([], [], [])
        take = min(k, len(ids)) if len(y) else 0
        for at in range(0, len(y) if take else 0, 512):
            scores = y[at : at + 512] @ x.T
            cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
            for q, row, edge in zip(asks.column("id")[at : at + 512].to_pylist(), scores, cut, strict=True):
                near = np.flatnonzero(row >= edge)
                near = near[np.lexsort((ids[near], -row[near]))[:take]]
                for column, values in zip(out, ([q] * len(near), ids[near], row[near]), strict=True):
                    column.extend(values)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "candidate_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(nearest, "query_id long, candidate_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("candidate_id")))), 1, k)  # k of each block
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.candidate_id").alias("candidate_id"), (-F.col("x.s")).alias("score"))


def _rows(block: pa.Table) -> np.ndarray:
    return block.column("u").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1) if block.num_rows else np.zeros((0, 0))


def regrouped(ranking: DataFrame) -> DataFrame:
    """(query_id, candidates): each query's candidates in rank order."""
    return ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("candidates"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def set_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the digest of a set of identities, whatever their order, from the digests of parts of about a thousand; the parts' digests are joined in groups of 256 until one is left."""
    each = rows.select(F.sha2(F.concat_ws("\x1f", *columns), 256).alias("h"))
    size, digits = each.count(), 2
    while size > 1000 * 16**digits:
        digits += 2
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], x["d"])), ""), 256)
    parts = each.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    while digits > 2:
        digits -= 2
        parts = parts.groupBy(F.substring("p", 1, digits).alias("q")).agg(joined.alias("d")).withColumnRenamed("q", "p")
    return parts.agg(joined.alias("digest"))
