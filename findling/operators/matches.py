"""Queries over the match table: groups, filters, search, sorting, pages, neighbours, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.functions import scoring

NEW, OLD, BEST = "newest", "oldest", "similarity"


def groups(scores: DataFrame, lost: DataFrame, now: Column, image_weight: float = 50.0) -> DataFrame:
    """Visible matches with the scores that lists show."""
    x = scores.where(scoring.visible(now)).join(lost.select("lost_id", "institution_classification"), "lost_id")
    return x.select(
        scoring.match_key().alias("match_id"), "lost_id", "auction_id", "institution_classification", scoring.combined(image_weight).alias("final_score"), F.col("image_final_score").cast("double").alias("image_similarity"), scoring.metadata_similarity().alias("metadata_similarity"),
        F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("bookmarked", F.lit(False)).alias("bookmarked"), scoring.match_date().alias("match_date"),
    )


def order(mode: str) -> list[Column]:
    if mode == NEW:
        return [F.desc_nulls_last("match_date"), F.asc("match_id")]
    if mode == OLD:
        return [F.asc_nulls_last("match_date"), F.asc("match_id")]
    return [F.desc_nulls_last("final_score"), F.desc_nulls_last("match_date"), F.asc("match_id")]


def page(matches: DataFrame, mode: str, number: int, size: int = 20, details: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """One page, cut before its details are joined."""
    cut = matches.orderBy(*order(mode)).offset((number - 1) * size).limit(size)
    return cut if details is None else cut.join(details, on)


def page_count(matches: DataFrame, size: int = 20) -> DataFrame:
    return matches.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def neighbours(matches: DataFrame, match_id: str, mode: str) -> DataFrame:
    """(previous_id, next_id) of a match in a list's order, by two top-1 queries rather than a window over all rows."""
    keys = {NEW: ("match_date", False), OLD: ("match_date", True), BEST: ("final_score", False)}
    at = matches.where(F.col("match_id") == match_id)
    score, up = keys[mode]

    def rank(prefix: str) -> Column:
        if mode == BEST:
            return F.struct(F.col(prefix + score).isNull().alias("a"), (-F.col(prefix + score)).alias("b"), F.col(prefix + "match_date").isNull().alias("c"), (-F.unix_micros(F.col(prefix + "match_date").cast("timestamp"))).alias("d"), F.col(prefix + "match_id").alias("e"))
        stamp = F.unix_micros(F.col(prefix + score).cast("timestamp"))
        return F.struct(F.col(prefix + score).isNull().alias("a"), (stamp if up else -stamp).alias("b"), F.col(prefix + "match_id").alias("e"))

    here = at.select(*(F.col(c).alias(f"h_{c}") for c in ("match_id", "match_date", "final_score")))
    x = matches.crossJoin(F.broadcast(here)).select("match_id", rank("").alias("r"), rank("h_").alias("h"))
    return x.agg(F.max_by("match_id", F.when(F.col("r") < F.col("h"), F.col("r"))).alias("previous_id"), F.min_by("match_id", F.when(F.col("r") > F.col("h"), F.col("r"))).alias("next_id"))


def directory_counts(scores: DataFrame, now: Column, expire_seconds: int) -> DataFrame:
    x = scores.where(scoring.visible(now)).withColumns({"_r": F.coalesce("rating", F.lit(0)), "_b": F.coalesce("bookmarked", F.lit(False)), "_d": scoring.match_date()})
    old = F.col("_d") < now - F.expr(f"interval {int(expire_seconds)} seconds")
    return x.agg(F.count("*").alias("all_count"), F.count_if((F.col("_r") == 0) & ~F.col("_b")).alias("new_count"), F.count_if(F.col("_b")).alias("bookmarked_count"), F.count_if(F.col("_r") > 0).alias("accepted_count"), F.count_if(old).alias("expired_count"), F.count_if(F.col("_r") < 0).alias("discarded_count"))


def braces(array: Column) -> Column:
    """An array as search text: {a,b}."""
    return F.concat(F.lit("{"), F.array_join(array, ","), F.lit("}"))


def searched(matches: DataFrame, texts: DataFrame, columns: list[str], wanted: str) -> DataFrame:
    """Matches whose joined texts hold the wanted words, in either case; % and _ keep their meaning."""
    hit = texts.where(F.concat_ws(" ", *columns).ilike(f"%{wanted}%")).select("match_id").distinct()
    return matches.join(hit, "match_id", "left_semi")


def best_per_auction(matches: DataFrame, n: int) -> DataFrame:
    """The n best matches after keeping each auction work's best."""
    w = Window.partitionBy("auction_id").orderBy(F.desc_nulls_last("final_score"), F.desc_nulls_last("match_date"), "match_id")
    first = matches.where("final_score is not null").withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
    return first.orderBy(*order(BEST)).limit(n)


def source_options(lost: DataFrame) -> DataFrame:
    """Classifications to filter by, null first; none if there is only one."""
    all_ = lost.select("institution_classification").distinct()
    return all_.join(all_.agg(F.count("*").alias("_n")).where("_n > 1"), how="cross").drop("_n").orderBy(F.asc_nulls_first("institution_classification"))


def ordered_names(works: DataFrame, people: DataFrame, ids: str = "artist_ids", key: str = "lost_id") -> DataFrame:
    """Works with the ordered names of their artists; array membership as an equi-join on exploded ids."""
    named = works.select(key, F.explode(ids).alias("artist_id")).join(people.select("artist_id", "complete_name"), "artist_id")
    names = named.groupBy(key).agg(F.array_sort(F.collect_list("complete_name")).alias("artist_names"))
    return works.join(names, key, "left").withColumn("artist_names", F.coalesce("artist_names", F.array().cast("array<string>")))


def next_to_label(matches: DataFrame, match_id: str, mode: str) -> DataFrame:
    """The next match to look at: the one behind, else the first other of the list, else the one before."""
    first = matches.where(F.col("match_id") != match_id).orderBy(*order(mode)).limit(1).select(F.col("match_id").alias("first_id"))
    x = neighbours(matches, match_id, mode)
    return x.join(first.agg(F.max("first_id").alias("first_id")), how="cross").select(F.coalesce("next_id", "first_id", "previous_id").alias("match_id"))
