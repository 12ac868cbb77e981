"""A training corpus from documents: stages that each read all that the one before kept.

Each stage is written as Parquet and read again by the next; all but the last return the columns of documents.
Null or empty texts pass the quality stage, are nobody's duplicates and leave at mixing, which takes words; an
empty table gives no rows; repeated rows are one document from the second stage on; extra columns, whatever their
names, are kept up to the last stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm import fluency, minhash, mixing, packing, personal
from findling.llm.shared import cut, sized, small_batches, table, tidied


def free(docs: DataFrame, n: int) -> list[str]:
    """n names that no column has."""
    taken = {c.lower() for c in docs.columns}
    return [k for k in (f"_{i}" for i in range(n + len(taken))) if k not in taken][:n]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    judged = fluency.judge(fluency.score(docs, table(spark, sf_dir, "labels")))
    i, h, lang = names = free(docs, 3)
    bad = cut(judged.where("not kept").select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("lang").alias(lang)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)) & F.col("lang").eqNullSafe(F.col(lang))
    return docs.join(sized(bad.select(*names)), same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the smallest doc_id stays."""
    i, h, own = free(docs, 3)
    with small_batches(spark):
        found = cut(minhash.near_duplicates(docs, words=5, percent=80, bands=32).where("root is not null").select("doc_id", "h", "root"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    spare = found.join(first, "root").where(~F.struct("doc_id", "h").eqNullSafe(F.col("first")))
    spare = cut(spare.select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    kept = docs.join(sized(spare), same, "left_anti")
    again = cut(found.groupBy(F.col("doc_id").alias(i), F.col("h").alias(h)).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    keyed = kept.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h))
    rest, repeated = keyed.join(again, same, "left_anti"), keyed.join(again, same, "left_semi")
    return rest.union(repeated.dropDuplicates(["doc_id", own])).drop(own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    with small_batches(spark):
        model = personal.fit(docs)
    return personal.redact(docs, model, chars="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and partial passes over the documents so that sources meet their targets."""
    return mixing.take(docs, chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_json())


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("source mixture", mixture), ("packing", packed)]
ORACLE_SQL = None  #: SQL expresses neither the fitted models nor the packing; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = tidied(partial(stage, spark, docs, sf_dir)) if k < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
