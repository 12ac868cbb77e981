"""Whole dumps, their loads over what is there, and replays.

A dump is a folder with a Parquet table for each of the tables given, parents before children, and `tables`, which
says for each its place, columns and number of rows, observed while it was written. It is written aside and renamed, so
that a failing job leaves no half of it. A load adds what is missing and overwrites nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from findling.operators.inventory import running_sum
from findling.sources.scratch import cut
from findling.sources.shards import Folder

CONTENTS = "name string, place int, n_rows long, columns array<string>"


def dump(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all tables at path, which must be new, in order; returns (name, place, n_rows, columns). Empty tables are kept with their columns."""
    spark = next(iter(tables.values())).sparkSession
    parent, name = path.rstrip("/").rsplit("/", 1)
    folder, aside, rows = Folder(spark, parent), f".{name}-{uuid.uuid4().hex}", []
    try:
        for place, (table, df) in enumerate(tables.items()):
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{parent}/{aside}/data/{table}")
            rows.append((table, place, seen.get["n"], df.columns))
        spark.createDataFrame(rows, CONTENTS).coalesce(1).write.parquet(f"{parent}/{aside}/tables")  # a row for each table
        if not folder.rename(aside, name):
            raise FileExistsError(path)
    finally:
        folder.remove(aside)
    return contents(spark, path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENTS).parquet(f"{path}/tables")


def dumped(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The dump's tables in order; ValueError if one has not the rows that were written."""
    out = {}
    for row in contents(spark, path).orderBy("place").collect():  # a row for each table
        df = spark.read.parquet(f"{path}/data/{row['name']}").select(*row["columns"])
        if df.count() != row["n_rows"]:
            raise ValueError(f"{row['name']} of {path} has not the {row['n_rows']} rows that were dumped")
        out[row["name"]] = df
    return out


def loaded(there: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """there, and the rows of new whose key it lacks; a key that new has twice comes once (its smallest row). Rows of new without a key are left out; columns that only new has are dropped, those that it lacks null."""
    own = new.where(F.col(key).isNotNull())
    own = own.select(*(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema))
    rest = [c for c in there.columns if c != key]
    if rest:
        own = own.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))
    else:
        own = own.distinct()
    return there.unionByName(own.join(there.select(key), key, "left_anti").select(*there.columns))


def paths_as_images(works: DataFrame, files: DataFrame, key: str = "lost_id", paths: str = "img_paths") -> tuple[DataFrame, DataFrame]:
    """Lists of paths as files and links: (image_id, file_path, is_embedded) of the files that are new, and (key, image_id) of all.

    files: image_id, file_path. Of several files of one path the smallest id is linked; new ids count on from the largest
    in order of paths. Null and empty lists, and nulls in lists, link nothing; a path named twice links once.
    """
    named = cut(works.select(key, F.explode(paths).alias("file_path")).where("file_path is not null").distinct())
    known = files.where("file_path is not null").groupBy("file_path").agg(F.min("image_id").alias("image_id"))
    missing = cut(named.select("file_path").distinct().join(known, "file_path", "left_anti"))
    top = files.agg(F.coalesce(F.max("image_id"), F.lit(0)).alias("_top"))  # one row
    fresh = cut(running_sum(missing, ["file_path"], F.lit(1), "_at").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_at")).cast("long").alias("image_id"), "file_path"))
    links = named.join(known.select("file_path", F.col("image_id").cast("long")).union(fresh.select("file_path", "image_id")), "file_path").select(key, "image_id")
    return fresh.withColumn("is_embedded", F.lit(False)), links


def replayed(links: DataFrame, images: DataFrame, works: DataFrame, live: Column | str, done: str = "processed", fine: str = "error_free", at: str = "image_at") -> tuple[DataFrame, DataFrame]:
    """links and works as they stand when all images that are still there are to be matched again.

    live: over images, whether one has a file and is not cleaned up. Links of live images lose both flags; works that have
    such a link lose their flag and its time. Everything else stays, and so do works whose flag is not set.
    """
    alive = images.where(live).select("image_id", F.lit(True).alias("_live")).distinct()
    met = links.join(alive, "image_id", "left")
    reset = F.col("_live") & (F.coalesce(done, F.lit(False)) | F.coalesce(fine, F.lit(False)))
    out = met.withColumn("_reset", F.coalesce(reset, F.lit(False))).withColumns({c: F.when(F.col("_reset"), F.lit(False)).otherwise(F.col(c)) for c in (done, fine)})
    named = met.where("_live").select("auction_id", F.lit(True).alias("_hit")).distinct()
    again = F.coalesce(F.col("_hit") & F.col(done), F.lit(False))
    owners = works.join(named, "auction_id", "left").withColumn("_again", again)
    owners = owners.withColumns({done: F.when(F.col("_again"), F.lit(False)).otherwise(F.col(done)), at: F.when(~F.col("_again"), F.col(at))})
    return out.select(*links.columns), owners.select(*works.columns)


def variants_added(new: DataFrame, there: DataFrame, name: str, raw: str) -> DataFrame:
    """(name, raw) of the variants to insert: each pair once, without those that are there, and without null or empty parts."""
    own = new.where((F.coalesce(name, F.lit("")) != "") & (F.coalesce(raw, F.lit("")) != "")).select(name, raw).distinct()
    return own.join(there.select(name, raw), [name, raw], "left_anti")


def backfilled(rows: DataFrame, column: str, found: str) -> DataFrame:
    """rows with a list taken from another where it is null or empty; filled ones stay. The other list goes."""
    empty = F.coalesce(F.size(column) <= 0, F.lit(True))
    return rows.withColumn(column, F.when(empty, F.col(found)).otherwise(F.col(column))).drop(found)
