"""What a change makes stale: pure functions from a state to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = ("image_final_score", "image_matching_confidence", "image_blocking_similarity", "best_image_file_id", "image_match_date")


def without_image_scores(scores: DataFrame, auctions: DataFrame | None = None) -> DataFrame:
    """Image columns null for the affected auction works (all without a list), rows that were image-only gone."""
    x = scores if auctions is None else scores.join(auctions.select("auction_id").distinct().withColumn("_hit", F.lit(True)), "auction_id", "left")
    hit = F.lit(True) if auctions is None else F.coalesce("_hit", F.lit(False))
    x = x.where(~hit | F.col("metadata_final_score").isNotNull())
    types = dict(scores.dtypes)
    return x.select(*(F.when(hit, F.lit(None).cast(types[c])).otherwise(F.col(c)).alias(c) if c in IMAGE else F.col(c) for c in scores.columns))


def requeued(works: DataFrame, changed: DataFrame | None, flags: list[str], key: str = "auction_id") -> DataFrame:
    """Flags back to false for the changed works (all without a list)."""
    if changed is None:
        return works.withColumns({f: F.lit(False) for f in flags})
    x = works.join(changed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return x.withColumns({f: F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(f)) for f in flags}).drop("_hit").select(*works.columns)


def corpus_changed(state: DataFrame, scores: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A change of the lost side: the revision goes up, all image scores go, all works queue again."""
    return state.withColumn("revision", F.col("revision") + 1), without_image_scores(scores), requeued(works, None, ["processed"])
