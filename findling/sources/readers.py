"""Readers: dictionaries, hand-off records, image inputs, rankings, directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKING = "auction_file_id string, lost_file_id string, auction_content_version long, lost_content_version long, lost_content_revision long, auction_content_sha256 string, lost_content_sha256 string, rank short, blocking_score float"
REQUIRED = ("auction_file_id", "lost_file_id", "rank", "blocking_score")
IMAGE_INPUT = "file_id string, file_path string, role string, content_version long, content_sha256 string"


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon table with a header; blank fields are null."""
    rows = spark.read.csv(path, sep=";", header=True)
    return rows.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in rows.columns))


def variants(rows: DataFrame, name: str, raw: str) -> DataFrame:
    """(key, names): lower-cased raw spellings with the dictionary names they stand for, each once."""
    x = rows.where(F.col(name).isNotNull() & F.col(raw).isNotNull()).select(F.lower(F.trim(raw)).alias("key"), F.trim(name).alias("name"))
    return x.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def image_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of an image list: ids once, known roles, positive versions, hexadecimal digests."""
    rows = spark.read.schema(IMAGE_INPUT).csv(path, header=True)
    bad = F.when(~F.col("role").isin("lost", "auction") | F.col("role").isNull(), "role").when(F.col("content_version") <= 0, "version").when(F.col("content_sha256").isNotNull() & ~F.col("content_sha256").rlike("^[0-9a-f]{64}$"), "digest")
    twice = rows.groupBy("file_id").count().where("count > 1").select("file_id", F.lit("repeated").alias("fault"))
    return rows, rows.select("file_id", bad.alias("fault")).where("fault is not null").unionByName(twice)


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rankings; optional columns may be missing, required ones may not."""
    have = spark.read.parquet(path)
    if missing := [c for c in REQUIRED if c not in have.columns]:
        raise ValueError(f"ranking without {', '.join(missing)}")
    return spark.read.schema(RANKING).parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of a directory tree, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
