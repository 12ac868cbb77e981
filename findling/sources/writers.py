"""Writers: validated rankings, canonical JSON pages, match lists; sharded tables are in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.operators.inventory import byte_pages


def ranking_faults(rows: DataFrame) -> DataFrame:
    """Rows whose rank or score is out of range, and queries with a rank twice."""
    bad = rows.where("rank is null or rank < 1 or blocking_score is null or abs(blocking_score) > 1.000001").select("auction_file_id", F.lit("range").alias("fault"))
    twice = rows.groupBy("auction_file_id", "rank").count().where("count > 1").select("auction_file_id", F.lit("repeated rank").alias("fault"))
    return bad.unionByName(twice).distinct()


def write_ranking(rows: DataFrame, path: str) -> None:
    if not ranking_faults(rows).isEmpty():
        raise ValueError("ranking with faults")
    rows.write.mode("overwrite").parquet(path)


def write_pages(rows: DataFrame, keys: list[str], path: str, most: int) -> None:
    """Compressed JSON lines, a directory for each page of at most about `most` bytes."""
    paged = byte_pages(rows, keys, most)
    paged.select("page", F.to_json(F.struct(*sorted(rows.columns))).alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(path, compression="gzip")


def write_matches(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
