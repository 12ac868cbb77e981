"""What a page shows, worked out beside the data: line geometry, keypoint payloads, a list's default filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = (48.0, 16.0, 704.0, 216.0)  #: left, top, right and bottom of the plot


def nice_max(value: Column) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that the value does not pass; 1 for what is not positive."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    first = F.coalesce(*(F.when(step * size >= value, step * size) for step in (1, 2, 5)), 10 * size)
    return F.when(value > 0, first).otherwise(F.lit(1.0))


def label_places(count: Column, most: int = 6) -> Column:
    """At most so many places of 0 to count - 1, evenly apart, both ends among them; halves go to the even place."""
    every = F.sequence(F.lit(0), count - 1)
    some = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (count - 1) / F.lit(float(most - 1)), 0).cast("int"))))
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= most, every).otherwise(some)


def line(values: Column, top: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    """array<struct<x, y>> of a series under a common greatest value; a single point stands in the middle."""
    left, upper, right, lower = box
    n = F.size(values)
    x = lambda i: F.when(n > 1, F.lit(left) + (right - left) / (n - 1) * i).otherwise((left + right) / 2)
    return F.transform(values, lambda v, i: F.struct(F.round(x(i), 2).alias("x"), F.round(lower - F.coalesce(v, F.lit(0)).cast("double") / top * (lower - upper), 2).alias("y")))


def keypoint_payload(own: Column, other: Column, pairs: Column, scores: Column) -> Column:
    """JSON of matched points: own and other are arrays of [x, y], pairs of their places, scores by place in pairs (missing ones are left out). A place that no point has is an error."""
    inside = F.forall(pairs, lambda p: (p[0] >= 0) & (p[0] < F.size(own)) & (p[1] >= 0) & (p[1] < F.size(other)))
    row = lambda p, i: F.struct(p[0].alias("auction_keypoint_index"), p[1].alias("lost_keypoint_index"), F.get(own, p[0]).alias("auction"), F.get(other, p[1]).alias("lost"), F.get(scores, i).alias("score"))
    text = F.to_json(F.struct(F.lit("image_pixels").alias("coordinate_space"), F.size(pairs).alias("match_count"), F.transform(pairs, row).alias("matches")))
    return F.when(pairs.isNotNull(), F.when(inside, text).otherwise(F.raise_error(F.lit("a match names a point that is not there")).cast("string")))


def pairs_of_first(other_places: Column) -> Column:
    """Pairs out of one side's list of the other side's places, of which negative ones are none."""
    return F.filter(F.transform(other_places, lambda p, i: F.array(i, p)), lambda x: x[1] >= 0)


def list_defaults(search: Column, rating: Column, sort: Column, bookmarked: Column) -> Column:
    """struct(rating, sort, bookmarked, new_matches) that a list is shown with: a search looks everywhere; nothing asked is the new matches; rated and bookmarked lists have the newest first."""
    searched = F.coalesce(F.trim(search) != "", F.lit(False))
    nothing = rating.isNull() & sort.isNull() & bookmarked.isNull()
    given = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), otherwise)
    shown = F.when(rating == "expired", "all").otherwise(bookmarked)
    newest = F.coalesce(shown == "true", F.lit(False)) | F.coalesce(rating.isin("accepted", "discarded"), F.lit(False))
    by = F.when(newest, "newest").otherwise("similarity")
    r = F.when(searched, given(rating, F.lit("all"))).when(nothing, "unrated").otherwise(rating)
    s = F.when(searched, given(sort, F.lit("similarity"))).when(nothing, "similarity").otherwise(given(sort, by))
    b = F.when(searched, given(bookmarked, F.lit("all"))).when(nothing, "false").otherwise(shown)
    return F.struct(r.alias("rating"), s.alias("sort"), b.alias("bookmarked"), F.coalesce(~searched & (r == "unrated") & (b == "false"), F.lit(False)).alias("new_matches"))
