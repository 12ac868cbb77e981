"""Confidence, fusion, visibility and display expressions over scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"title": 0.35, "artist": 0.25, "dating": 0.15, "dimensions": 0.15, "material": 0.05, "technique": 0.05}
THRESHOLD, CONFIDENCE = 0.7, 0.5


def rarity(count: Column, total: Column) -> Column:
    """ln(total / count) / ln(total) in [0, 1]; 1 where nothing is known or nothing repeats."""
    idf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(total / count) / F.log(total)))
    return F.when(count.isNull() | (count <= 1) | (total <= 1), F.lit(1.0)).otherwise(idf)


def mean_of_both(a: Column, b: Column, known: Column) -> Column:
    return F.when(known, (a + b) / 2).otherwise(F.lit(0.0))


def fused(similarities: dict[str, Column]) -> Column:
    """The weighted mean over the components that are not null; 0 without any."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        top = top + F.when(similarities[k].isNotNull(), w * similarities[k]).otherwise(0.0)
        bottom = bottom + F.when(similarities[k].isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def trusted(confidences: dict[str, Column]) -> Column:
    """The weighted sum of confidences; a missing one adds nothing."""
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = out + w * F.coalesce(confidences[k], F.lit(0.0))
    return out


def image_known() -> Column:
    return F.col("image_final_score").isNotNull() | F.col("image_matching_confidence").isNotNull()


def match_date() -> Column:
    both = F.greatest("metadata_match_date", "image_match_date")
    return F.when(F.col("metadata_final_score").isNotNull() & image_known(), both).when(image_known(), F.col("image_match_date")).otherwise(F.col("metadata_match_date"))


def visible(now: Column) -> Column:
    """All but image-only matches of the last day; a null image date is visible."""
    young = F.coalesce(F.col("image_match_date") > now - F.expr("interval 1 day"), F.lit(False))
    return ~(F.col("metadata_final_score").isNull() & image_known() & young)


def combined(image_weight: float) -> Column:
    """Weighted sum of image and metadata scores (a missing one counts 0); null if both are missing."""
    image, meta = F.col("image_final_score").cast("double"), F.col("metadata_final_score").cast("double")
    return F.when(image.isNull() & meta.isNull(), F.lit(None)).otherwise(F.coalesce(image, F.lit(0.0)) * (image_weight / 100.0) + F.coalesce(meta, F.lit(0.0)) * ((100.0 - image_weight) / 100.0))


def metadata_similarity() -> Column:
    return ((F.col("metadata_final_score") + F.col("metadata_confidence_score")) / 2.0).cast("double")


def match_key(lost: str = "lost_id", auction: str = "auction_id") -> Column:
    return F.concat_ws(":", F.col(lost).cast("string"), F.col(auction).cast("string"))


def image_final(confidence: Column, blocking: Column) -> Column:
    return F.coalesce(confidence * blocking, confidence)


def percent(score: Column, digits: int = 2) -> Column:
    text = F.format_string(f"%.{digits}f%%", score * 100)
    return F.when(score.isNull(), F.lit("--")).otherwise(F.replace(text, F.lit("."), F.lit(",")))


def bar_width(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("0")).otherwise(F.format_string("%.2f", F.greatest(F.lit(0.0), F.least(score * 100, F.lit(100.0)))))


def bar_segment(score: Column, share: float) -> Column:
    held = F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))) * max(0.0, min(share, 1.0)) * 100
    return F.when(score.isNull(), F.lit("0")).otherwise(F.format_string("%.2f", held))


def rating_filter(rating: str | None, now: Column, expire_seconds: float, bookmarked: str | None = None, source: str | None = None) -> Column:
    """Unknown values filter nothing; `expired` overrides the bookmark filter."""
    kept = F.lit(True)
    expired = F.col("match_date") < now - F.expr(f"interval {int(expire_seconds)} seconds")
    by_rating = {"unrated": F.col("rating") == 0, "accepted": F.col("rating") > 0, "discarded": F.col("rating") < 0, "expired": expired}
    if rating in by_rating:
        kept = kept & by_rating[rating]
    if rating != "expired" and bookmarked in ("true", "false"):
        kept = kept & (F.col("bookmarked") == F.lit(bookmarked == "true"))
    if source not in (None, "all"):
        kept = kept & (F.col("institution_classification") == source)
    return F.coalesce(kept, F.lit(False))
