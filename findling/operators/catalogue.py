"""Catalogue states: relations from parameters, inventories of files and sources, requests, clean-up and display picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.functions import values
from findling.operators import trees


def from_arrays(spark: SparkSession, schema: str, *arrays: list) -> DataFrame:
    """Parallel parameter arrays as rows; they must be of one length."""
    return spark.createDataFrame(list(zip(*arrays, strict=True)), schema)


def tagged_union(**tables: DataFrame) -> DataFrame:
    """(kind, ...) of all tables, each row with its table's name; columns a table lacks are null."""
    out = None
    for kind, rows in tables.items():
        own = rows.select(F.lit(kind).alias("kind"), "*")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def distinct_ids(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(id): the ids that any of (table, column) names, each once, nulls left out."""
    out = None
    for rows, column in sources:
        own = rows.select(F.col(column).alias("id")).where("id is not null")
        out = own if out is None else out.union(own)
    return out.distinct()


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def ranking_summary(ranking: DataFrame, part: str, auction: str) -> DataFrame:
    """One row: parts, rows and different auction ids of a ranking."""
    return ranking.agg(F.countDistinct(part).alias("parts"), F.count("*").alias("n_rows"), F.countDistinct(auction).alias("auctions"))


def storage_paths(links: DataFrame, images: DataFrame, works: DataFrame, platforms: DataFrame) -> DataFrame:
    """(platform, file_path) of every linked image that has a file. links: auction_id, image_id; works: auction_id, platform_id; platforms: platform_id, platform."""
    x = links.join(images.where("file_path is not null").select("image_id", "file_path"), "image_id")
    return x.join(works.select("auction_id", "platform_id"), "auction_id").join(platforms, "platform_id").select("platform", "file_path")


def storage_stats(paths: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """(by, files, bytes): different files that exist, each counted once for each group. files: file_path, bytes."""
    return paths.select(by, "file_path").distinct().join(files, "file_path").groupBy(by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def entry_counts(lost: DataFrame, auctions: DataFrame, platform: str) -> DataFrame:
    """(source, entries): all lost works as one source, auction works by platform."""
    own = lost.agg(F.count("*").alias("entries")).select(F.lit("lost").alias("source"), "entries")
    return own.union(auctions.groupBy(F.col(platform).cast("string").alias("source")).agg(F.count("*").alias("entries")))


def not_advertised(requested: DataFrame, advertised: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that were never advertised; a request is valid if there are none."""
    return requested.select(*keys).distinct().join(advertised.select(*keys), keys, "left_anti")


def cleaned(images: DataFrame, done: DataFrame, now: Column, key: str = "image_id") -> DataFrame:
    """images with no path and the time of cleaning where done names them. cleaned_at is added if it is missing."""
    before = F.col("cleaned_at") if "cleaned_at" in images.columns else F.lit(None).cast("timestamp_ntz")
    x = images.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left")
    return x.withColumns({"file_path": F.when(F.col("_done"), F.lit(None)).otherwise(F.col("file_path")), "cleaned_at": F.when(F.col("_done"), now).otherwise(before)}).drop("_done")


def without(rows: DataFrame, column: str, value: object) -> DataFrame:
    """rows but those of one value, as in the purge of a platform; null is no value."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))


def image_only_pairs(scores: DataFrame, batch: DataFrame) -> DataFrame:
    """(lost_id, auction_id) of a batch's pairs that have an image score and no metadata score."""
    return scores.where("metadata_final_score is null and image_final_score is not null").join(batch.select("auction_id"), "auction_id", "left_semi").select("lost_id", "auction_id")


def invalidated_metadata(works: DataFrame, pairs: DataFrame, flag: str = "processed") -> DataFrame:
    """works with the flag taken back where an image-only pair names them."""
    hit = pairs.select("auction_id", F.lit(True).alias("_hit")).distinct()
    return works.join(hit, "auction_id", "left").withColumn(flag, F.coalesce(~F.col("_hit"), F.col(flag))).drop("_hit")


def claimed(claims: DataFrame, day: Column, keys: DataFrame, key: str) -> DataFrame:
    """claims and one for each key that has none of that day."""
    new = keys.select(key, day.alias("day")).distinct()
    return claims.select(key, "day").union(new.join(claims, [key, "day"], "left_anti"))


def history(runs: DataFrame, newest: int, name: str | None = None, column: str = "source", at: str = "run_at") -> DataFrame:
    """The newest runs, of one name if it is given; ties by name."""
    own = runs if name is None else runs.where(F.col(column).cast("string") == name)
    return own.orderBy(F.desc(at), column).limit(newest)


def primary_first(entries: Column, is_primary: str = "is_primary", place: str = "place") -> Column:
    """An array of structs with the primary ones before all others, else in their places."""
    key = lambda x: F.struct((~F.coalesce(x[is_primary], F.lit(False))).alias("k"), x[place].alias("p"))
    return F.transform(F.array_sort(F.transform(entries, lambda x: F.struct(key(x).alias("key"), x.alias("x")))), lambda s: s["x"])


def label_or(fallback: str | None, *columns: Column) -> Column:
    """The first text that is not blank, trimmed, else the fallback, which may be null."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(fallback))


def clamped(value: Column, least: float, most: float, otherwise: float) -> Column:
    """A parameter kept in its range; what is no number counts as otherwise."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(value.try_cast("double"), F.lit(otherwise))))


def rescaled(coordinates: Column, scale: Column) -> Column:
    """Pixel centres in an image scaled by scale, in the original's coordinates."""
    return F.transform(coordinates, lambda k: (k + 0.5) / scale - 0.5)


def dictionary_names(rows: DataFrame, raw: str, variants: DataFrame, root: str, out: str = "names") -> DataFrame:
    """rows with the dictionary names of a text's tokens, each once, in order; [root] for a null or blank text or one without a hit.

    variants: (key, names), a key once and in lower case. Each different text is looked up once.
    """
    texts = rows.select(F.col(raw).alias("_raw")).where("_raw is not null").distinct()
    parts = texts.select("_raw", F.posexplode(values.tokens(F.col("_raw"))).alias("_at", "_key"))
    hits = parts.join(variants.select(F.col("key").alias("_key"), F.col("names").alias("_names")), "_key")
    found = hits.groupBy("_raw").agg(F.array_sort(F.collect_list(F.struct("_at", "_names"))).alias("_hits"))
    found = found.select("_raw", F.array_distinct(F.flatten(F.col("_hits._names"))).alias("_found"))
    own = rows.join(found, F.col(raw) == F.col("_raw"), "left").drop("_raw")
    return own.withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit(root)))).drop("_found")


def extra_entities(requested: DataFrame, kind: str, matches: DataFrame, column: str) -> DataFrame:
    """(kind, id) of requested entities of a kind that no requested match implies."""
    return requested.where(F.col("kind") == kind).join(matches.select(F.col(column).alias("id")), "id", "left_anti").select("kind", "id")


def latest_applied(ledger: DataFrame, order: str, status: str = "status", applied: str = "applied") -> DataFrame:
    """The ledger's last applied row; no row where none is."""
    return ledger.where(F.col(status) == applied).orderBy(F.desc(order)).limit(1)


def linked_by_path(rows: DataFrame, images: DataFrame, path: str = "file_path", key: str = "image_id") -> DataFrame:
    """rows with the smallest id of the image at their path, null without one."""
    first = images.where(F.col(path).isNotNull()).groupBy(path).agg(F.min(key).alias(key))
    return rows.join(first, path, "left")


def preferred_row(rows: DataFrame, table: DataFrame, key: str, own: str, group: str) -> DataFrame:
    """rows with the table row of their group that bears their own key, else the group's smallest: one row of each group is joined, never the group."""
    same = table.select(F.col(own).alias(key), F.col(group), F.col(own).alias("_same")).distinct()
    first = table.groupBy(group).agg(F.min(own).alias("_first"))
    return rows.join(first, group).join(same, [key, group], "left").withColumn(own, F.coalesce("_same", "_first")).drop("_same", "_first")


def shaped(rows: DataFrame, kinds: dict[str, str], most: int | None = None) -> DataFrame:
    """Columns cast to kinds; lists are text, empty for null, and hold `most` entries at most."""

    def column(name: str, kind: str) -> Column:
        if kind != "list":
            return F.col(name).try_cast(kind)
        own = F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
        return F.slice(own, 1, most) if most else own

    return rows.withColumns({n: column(n, k) for n, k in kinds.items()})


def tree_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, parent, step, what) that a dictionary's load does, parents before children: inserts of new names and updates of those whose parent differs; the rest is left alone. step: how deep a name stands below its root."""
    depth = trees.root_paths(new).select("name", (F.size("path") - 1).alias("step"))
    was = old.select("name", F.col("parent").alias("_was"), F.lit(True).alias("_there"))
    met = new.select("name", "parent").join(was, "name", "left").join(depth, "name")
    what = F.when(F.col("_there").isNull(), "insert").when(~F.col("parent").eqNullSafe(F.col("_was")), "update")
    return met.withColumn("what", what).where("what is not null").select("name", "parent", "step", "what")
