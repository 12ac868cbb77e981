"""Rarity indexes over the lost side: titles, artists, years, sizes. Each is one small aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from findling.functions.scoring import rarity
from findling.functions.similarity import squeeze
from findling.functions.values import names_of

BROADCAST_POINTS = 50_000  #: different sizes that go to every task; beyond that they are joined by cells

# Names that stand for no artist.
UNKNOWN_ARTISTS = ("unknown", "unbekannt", "unidentified", "anoniem", "anonyme", "anonymus", "anonym")


def title_index(lost: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """((title_key, n) of repeated titles, one row with the number of titled works). Spellings that collapse to one key: the rarer, then later one counts."""
    named = lost.where(F.trim(F.col(title)) != "")
    raw = named.groupBy(title).agg(F.count("*").alias("n")).where("n > 1")
    keyed = raw.groupBy(squeeze(F.col(title)).alias("title_key")).agg(F.max_by("n", F.struct(-F.col("n"), F.col(title))).alias("n"))
    return keyed, named.agg(F.count("*").alias("total"))


def artist_index(lost: DataFrame, names: str = "artists", key: str = "lost_id") -> tuple[DataFrame, DataFrame]:
    """((artist_key, n) counted once a work, one row with the number of works that name an artist). names: an array of name fields."""
    each = lost.select(key, F.explode(names).alias("field")).select(key, F.explode(names_of(F.col("field"))).alias("name"))
    each = each.select(key, F.lower(F.col("name")).alias("artist_key")).where(~F.col("artist_key").isin(*UNKNOWN_ARTISTS)).distinct()
    return each.groupBy("artist_key").agg(F.count("*").alias("n")), each.agg(F.countDistinct(key).alias("total"))


def year_coverage(lost: DataFrame, start: str = "dating_start", end: str = "dating_end") -> DataFrame:
    """(year, n): how many datings span each year of the observed range, from the changes at their ends."""
    known = lost.where(F.col(start) <= F.col(end))
    steps = known.select(F.col(start).alias("year"), F.lit(1).alias("d")).union(known.select(F.col(end) + 1, F.lit(-1))).groupBy("year").agg(F.sum("d").alias("d"))
    ends = known.agg(F.min(start).alias("a"), F.max(end).alias("b"))
    years = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    # years, not rows, are ordered here: a few thousand at most
    return years.join(steps, "year", "left").selectExpr("year", "sum(coalesce(d, 0)) over (order by year) as n")


def year_confidence(coverage: DataFrame, total: int) -> DataFrame:
    """(year, upto): running sum of each year's rarity, for interval means by two lookups."""
    value = F.when(F.col("n") <= 0, F.lit(1.0)).otherwise(rarity(F.col("n"), F.lit(total)))
    return coverage.select("year", value.alias("v")).selectExpr("year", "sum(v) over (order by year) as upto")


def interval_confidence(rows: DataFrame, coverage: DataFrame, total: int, start: str, end: str, name: str) -> DataFrame:
    """Adds the mean rarity of an interval's years: the sum over observed years by the whole length, 1 where none is observed, null where a bound is missing."""
    sums = F.broadcast(year_confidence(coverage, total))
    range_ = sums.agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    x = rows.crossJoin(F.broadcast(range_))
    x = x.withColumns({"_a": F.greatest(F.col(start), "_lo"), "_b": F.least(F.col(end), F.col("_hi"))})
    x = x.join(sums.select((F.col("year") + 1).alias("_a"), F.col("upto").alias("_before")), "_a", "left").join(sums.select(F.col("year").alias("_b"), F.col("upto").alias("_upto")), "_b", "left")
    length = F.col(end) - F.col(start) + 1
    value = F.when((F.col("_lo").isNull()) | (F.col("_a") > F.col("_b")), F.lit(1.0)).otherwise((F.col("_upto") - F.coalesce("_before", F.lit(0.0))) / length)
    known = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    return x.withColumn(name, F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))).drop("_a", "_b", "_lo", "_hi", "_before", "_upto")


def trimmed_sizes(lost: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Sizes up to the 99th percentile of each side (interpolated)."""
    tops = lost.agg(F.expr(f"percentile_cont(0.99) within group (order by {width}) filter (where {width} > 0)").alias("_w"), F.expr(f"percentile_cont(0.99) within group (order by {height}) filter (where {height} > 0)").alias("_h"))
    return lost.crossJoin(F.broadcast(tops)).where((F.col(width) > 0) & (F.col(height) > 0) & (F.col(width) <= F.col("_w")) & (F.col(height) <= F.col("_h"))).select(F.col(width).cast("double").alias("width"), F.col(height).cast("double").alias("height"))


def spread(sizes: DataFrame) -> Row:
    """Number, variances and covariance of sizes."""
    return sizes.agg(F.count("*").alias("n"), F.var_samp("width").alias("a"), F.covar_samp("width", "height").alias("b"), F.var_samp("height").alias("c")).first()


def _near_density(wanted: DataFrame, points: pa.Table, a: float, b: float, c: float, n: int) -> DataFrame:
    """(x, y, d): the density at wanted sizes from few points, which go to every task, in blocks."""
    px, py, w = (points.column(k).to_numpy().astype(float) for k in ("width", "height", "w"))
    det = a * c - b * b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, 2_000_000 // max(1, len(px)))
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (0, 1))
            d = np.empty(len(x))
            for i in range(0, len(x), rows):
                dx, dy = x[i : i + rows, None] - px, y[i : i + rows, None] - py
                d[i : i + rows] = np.exp(-(c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (2 * det)) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d / (n * 2 * math.pi * math.sqrt(det)))], ["x", "y", "d"])

    return wanted.repartition(wanted.sparkSession.sparkContext.defaultParallelism, "x", "y").mapInArrow(run, "x double, y double, d double")


def _grid_density(wanted: DataFrame, points: DataFrame, a: float, b: float, c: float, n: int) -> DataFrame:
    """The same from many points: joined by cells. A kernel is below exp(-reach^2 / 2) beyond reach standard deviations, so that only a point's own cell and those beside it matter; what is left out adds less than 1e-9 of the floor of 1e-12."""
    det = a * c - b * b
    dx, dy = F.col("x") - F.col("width"), F.col("y") - F.col("height")
    kernel = F.exp(-(c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (2 * det))
    reach = math.sqrt(2 * math.log(1e21 * max(1, 1 / (2 * math.pi * math.sqrt(det)))))
    cell = lambda x, y: (F.floor(x / (reach * math.sqrt(a))).alias("i"), F.floor(y / (reach * math.sqrt(c))).alias("j"))
    beside = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((F.col("i") + k % 3 - 1).alias("i"), (F.col("j") + F.floor(k / 3) - 1).alias("j")))
    dealt = points.select("width", "height", "w", *cell(F.col("width"), F.col("height"))).select("width", "height", "w", F.explode(beside).alias("cell")).select("width", "height", "w", "cell.i", "cell.j")
    dens = wanted.select("x", "y", *cell(F.col("x"), F.col("y"))).join(dealt, ["i", "j"], "left").groupBy("x", "y")
    return dens.agg((F.coalesce(F.sum(F.col("w") * kernel), F.lit(0.0)) / (n * 2 * math.pi * math.sqrt(det))).alias("d"))


def density_confidence(rows: DataFrame, sizes: DataFrame, width: str, height: str, name: str, known: Row | None = None) -> DataFrame:
    """Adds ln(1 / density) by its largest value over the sizes: a Gaussian kernel density with Scott's factor. Equal sizes are one weighted point; the density is computed once for each different size."""
    points = sizes.groupBy("width", "height").agg(F.count("*").alias("w"))
    s = known or spread(sizes)
    if not s["n"] or s["n"] < 2 or s["a"] * s["c"] - s["b"] ** 2 <= 0:
        return rows.withColumn(name, F.lit(None).cast("double"))
    scott = s["n"] ** (-1 / 3)  # the square of n^(-1/6)
    a, b, c = s["a"] * scott, s["b"] * scott, s["c"] * scott
    det = a * c - b * b
    wanted = rows.where(F.col(width).isNotNull() & F.col(height).isNotNull()).select(F.col(width).cast("double").alias("x"), F.col(height).cast("double").alias("y")).union(points.select("width", "height")).distinct()
    few = points.limit(BROADCAST_POINTS + 1).toArrow()
    dens = _near_density(wanted, few, a, b, c, s["n"]) if few.num_rows <= BROADCAST_POINTS else _grid_density(wanted, points, a, b, c, s["n"])
    dens = dens.select("x", "y", F.log(1 / F.greatest(F.col("d"), F.lit(1e-12))).alias("l"))
    most = dens.join(points.select(F.col("width").alias("x"), F.col("height").alias("y")), ["x", "y"]).agg(F.max("l").alias("m"))
    scored = dens.crossJoin(F.broadcast(most)).select("x", "y", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l") / F.col("m"))).alias(name))
    return rows.join(scored, (F.col(width).cast("double") == F.col("x")) & (F.col(height).cast("double") == F.col("y")), "left").drop("x", "y")


def looked_up(rows: DataFrame, index: tuple[DataFrame, DataFrame], key: Column, index_key: str, name: str) -> DataFrame:
    """Adds the rarity of key in an index; null keys give 0."""
    counts, total = index
    x = rows.withColumn("_k", key).join(counts.withColumnsRenamed({index_key: "_k", "n": "_n"}), "_k", "left").crossJoin(F.broadcast(total.withColumnRenamed("total", "_t")))
    return x.withColumn(name, F.when(F.col("_k").isNull() | (F.col("_k") == ""), F.lit(0.0)).otherwise(rarity(F.col("_n"), F.col("_t")))).drop("_k", "_n", "_t")
