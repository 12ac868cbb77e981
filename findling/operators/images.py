"""Image matches: statistics of match scores, fan-out to works, best row of a pair, upserts, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions.scoring import image_final


def score_statistics(scores: Column) -> Column:
    """The sixteen summary statistics of a score vector: count, mean, variance, deviation, least, most, deciles 10 to 90, sum. No scores count as a single 0."""
    v = F.array_sort(F.transform(F.when(F.size(scores) > 0, scores).otherwise(F.array(F.lit(0.0))), lambda x: x.cast("double")))
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n

    def decile(q: float) -> Column:
        at = (n - 1) * q
        low = F.floor(at).cast("int")
        a, b = F.element_at(v, low + 1), F.element_at(v, F.least(low + 2, n))
        return a + (b - a) * (at - low)

    named = {"n": n.cast("double"), "mean": mean, "var": var, "std": F.sqrt(var), "min": F.element_at(v, 1), "max": F.element_at(v, -1)}
    named |= {f"p{q}": decile(q / 100) for q in range(10, 100, 10)} | {"sum": total}
    return F.struct(*(c.alias(k) for k, c in named.items()))


def fanned_out(accepted: DataFrame, auction_links: DataFrame, lost_links: DataFrame) -> DataFrame:
    """Accepted image pairs as pairs of works: every link of the one image with every link of the other."""
    return accepted.join(auction_links, "auction_file_id").join(lost_links, "lost_file_id")


def unlinked(accepted: DataFrame, auction_links: DataFrame, lost_links: DataFrame) -> DataFrame:
    """Accepted pairs of which an image belongs to no work; must be empty."""
    return accepted.join(auction_links, "auction_file_id", "left_anti").unionByName(accepted.join(lost_links, "lost_file_id", "left_anti")).distinct()


def best_of_pair(pairs: DataFrame) -> DataFrame:
    """One row for each pair of works: the best by final score, confidence and blocking score (null lowest); among equals the first position."""
    x = pairs.withColumn("final_score", image_final(F.col("confidence"), F.col("blocking_score")))
    order = F.struct("final_score", "confidence", F.coalesce("blocking_score", F.lit(-2.0)), (-F.col("position")).alias("p"))
    held = F.struct("final_score", "confidence", "blocking_score", "auction_file_id")
    return x.groupBy("lost_id", "auction_id").agg(F.max_by(held, order).alias("b")).select("lost_id", "auction_id", F.col("b.final_score").alias("image_final_score"), F.col("b.confidence").alias("image_matching_confidence"), F.col("b.blocking_score").alias("image_blocking_similarity"), F.col("b.auction_file_id").alias("best_image_file_id"))


IMAGE_COLUMNS = ("image_final_score", "image_matching_confidence", "image_blocking_similarity", "best_image_file_id")


def upsert_if_better(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new image scores: a pair's image columns change together, and only where the new ones are at least as good."""
    marks = ((IMAGE_COLUMNS[0], -2.0), (IMAGE_COLUMNS[1], -1.0), (IMAGE_COLUMNS[2], -2.0))
    key = lambda t: F.struct(*(F.coalesce(F.col(f"{t}.{c}").cast("double"), F.lit(d)).alias(c) for c, d in marks))
    x = old.alias("o").join(new.alias("n"), ["lost_id", "auction_id"], "full_outer")
    added, kept = F.col("o._there").isNull(), F.col("n._there").isNull() | (key("n") < key("o"))
    take = F.when(added | ~kept, True).otherwise(False)
    rest = [c for c in old.columns if c not in (*IMAGE_COLUMNS, "lost_id", "auction_id", "_there")]
    return x.select("lost_id", "auction_id", *(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in IMAGE_COLUMNS), *(F.col(f"o.{c}") for c in rest))


def completed_works(works: DataFrame, links: DataFrame, done: DataFrame, work: str = "auction_id", image: str = "image_id") -> DataFrame:
    """Works that are complete once the images in done are: those without links, and those whose links are all processed without error."""
    x = links.join(done.select(F.col(image), F.lit(True).alias("_done")).distinct(), image, "left")
    ready = F.coalesce("_done", F.lit(False)) | (F.coalesce("processed", F.lit(False)) & F.coalesce("error_free", F.lit(False)))
    open_ = x.groupBy(work).agg(F.bool_and(ready).alias("ready"), F.count("*").alias("links"))
    return works.where("not processed").select(work).join(open_, work, "left").where("ready or links is null").select(work, F.coalesce("links", F.lit(0)).alias("links"))
