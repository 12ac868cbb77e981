"""A part of one catalogue taken over into another: what scored works lead to, ids translated by identity and name.

The tables are works (auction_id, artist_id, platform_id, lot_id, lot_url, names), artists (artist_id, complete_name),
platforms (platform_id, name), dictionary (name, parent), images (image_id, file_path) and links (auction_id, image_id);
further columns come along. Everything is an equi-join on a key, a folded name or a path, none is gathered; what must not
be is counted before anything is given out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.operators import loads, trees
from findling.sources.scratch import cut


def portable_path(path: Column, root: str, prefix: str) -> Column:
    """A path below the prefix: what lies under the root moves there, relative paths are put under it, other absolute ones stay."""
    root, prefix = root.rstrip("/"), prefix.removeprefix("./").rstrip("/")
    own = F.regexp_replace(F.trim(path), r"^\./", "")
    moved = F.when(own.startswith(root + "/"), F.concat(F.lit(prefix), F.substr(own, F.lit(len(root) + 1)))) if root else F.lit(None).cast("string")
    return F.when((own == prefix) | own.startswith(prefix + "/"), own).otherwise(F.coalesce(moved, F.when(~own.startswith("/"), F.concat(F.lit(prefix + "/"), own)), own))


def exported(tables: dict[str, DataFrame], scores: DataFrame, root: str, prefix: str) -> dict[str, DataFrame]:
    """The works that have a score and all that they refer to: artists, platforms, dictionary names with those above them, images and links. ValueError if no work has a score."""
    works = cut(tables["works"].join(scores.select("auction_id"), "auction_id", "left_semi"))
    if works.isEmpty():
        raise ValueError("no work has a score")
    links = tables["links"].join(works.select("auction_id"), "auction_id", "left_semi")
    images = tables["images"].join(links.select("image_id"), "image_id", "left_semi")
    named = works.select(F.explode("names").alias("name")).where("name is not null").distinct()
    above = trees.ancestors(named, tables["dictionary"])  # with the names themselves
    return {
        "artists": tables["artists"].join(works.select("artist_id"), "artist_id", "left_semi"),
        "platforms": tables["platforms"].join(works.select("platform_id"), "platform_id", "left_semi"),
        "dictionary": tables["dictionary"].join(above, "name", "left_semi"),
        "works": works,
        "images": images.withColumn("file_path", portable_path(F.col("file_path"), root, prefix)),
        "links": links,
    }


def added(source: DataFrame, there: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of source whose key and name (whatever its case) there has not, and (source_id, target_id) for all of source: the same key, else the smallest key of the same name.

    ValueError if a key stands for another name there. Null names are equal to none.
    """
    other = source.select(key, F.lower(name).alias("_a")).join(there.select(key, F.lower(name).alias("_b")), key).where("_a <> _b")
    if not other.isEmpty():
        raise ValueError(f"{key} stands for different names")
    mine = there.select(key, F.lower(name).alias("_n"))
    own = source.withColumn("_n", F.lower(name))
    new = own.join(mine.select(key), key, "left_anti").join(mine.select("_n").where("_n is not null"), "_n", "left_anti").select(*source.columns)
    every = mine.union(new.select(key, F.lower(name)))
    same = every.select(F.col(key).alias("_same")).distinct()
    alike = every.where("_n is not null").groupBy("_n").agg(F.min(key).alias("_alike"))
    ids = own.select(key, "_n").join(same, F.col(key) == F.col("_same"), "left").join(alike, "_n", "left")
    return new, ids.select(F.col(key).alias("source_id"), F.coalesce("_same", "_alike").alias("target_id")).distinct()


def translated(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """A reference in the other catalogue's ids; null where the map has none."""
    m = ids.select(F.col("source_id").alias(column), F.col("target_id").alias("_to"))
    return rows.join(m, column, "left").withColumn(column, F.col("_to")).select(*rows.columns)


def folded_path_clashes(new: DataFrame, there: DataFrame, path: str = "file_path") -> DataFrame:
    """(path_key, spellings): paths that differ in case alone, of both sides together, if one of them is new."""
    both = new.select(path, F.lit(True).alias("_new")).union(there.select(path, F.lit(False))).where(F.col(path).isNotNull())
    seen = both.groupBy(path).agg(F.bool_or("_new").alias("_new"))
    return seen.groupBy(F.lower(path).alias("path_key")).agg(F.count("*").alias("spellings"), F.bool_or("_new").alias("_new")).where("spellings > 1 and _new").drop("_new")


@dataclass(frozen=True)
class Additions:
    """What is to be inserted, by table."""

    artists: DataFrame
    platforms: DataFrame
    dictionary: DataFrame
    works: DataFrame
    images: DataFrame
    links: DataFrame


def imported(export: dict[str, DataFrame], there: dict[str, DataFrame]) -> Additions:
    """What an export adds to a catalogue; taking it over twice adds nothing the second time.

    A work is there if its id is, or its lot's number or address on the platform that its own translates to. Works that
    are there are left alone, and so are their links. Files are known by their paths.
    """
    if not (clashes := folded_path_clashes(export["images"], there["images"])).isEmpty():
        raise ValueError(f"paths that differ in case alone, such as {clashes.first()['path_key']}")
    artists, artist_ids = added(export["artists"], there["artists"], "artist_id", "complete_name")
    platforms, platform_ids = added(export["platforms"], there["platforms"], "platform_id", "name")
    works = translated(translated(export["works"], "artist_id", artist_ids), "platform_id", platform_ids)
    works = works.join(there["works"].select("auction_id"), "auction_id", "left_anti")
    for column in ("lot_id", "lot_url"):
        known = there["works"].select("platform_id", column).where(f"platform_id is not null and {column} is not null")
        works = works.join(known, ["platform_id", column], "left_anti").select(*export["works"].columns)
    works = cut(works)
    dictionary = export["dictionary"].join(there["dictionary"].select("name"), "name", "left_anti")
    named = export["links"].join(works.select("auction_id"), "auction_id", "left_semi").join(export["images"].select("image_id", "file_path"), "image_id")
    lists = named.select("auction_id", F.array("file_path").alias("img_paths"))
    images, links = loads.paths_as_images(lists, there["images"], "auction_id")
    return Additions(artists, platforms, dictionary, works, images, links)
