"""Time series: counts by day and hour, running totals, gap-filled calendars, unpivoted events, run deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_events(rows: DataFrame, stamps: dict[str, str]) -> DataFrame:
    """(bucket, kind, n) of several timestamp columns; kinds name them."""
    parts = [rows.where(F.col(c).isNotNull()).groupBy(F.to_date(c).alias("bucket"), F.lit(k).alias("kind")).agg(F.count("*").alias("n")) for k, c in stamps.items()]
    return reduce(DataFrame.unionByName, parts)


def running_totals(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(bucket, kind columns): one row a day, each column the total up to it. Only days are ordered, not events."""
    daily = events.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("bucket", *(F.sum(k).over(upto).alias(k) for k in kinds))


def calendar(spark, start: Column, end: Column, step: str = "1 hour") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias("bucket"))


def unpivoted(rows: DataFrame, stamps: dict[str, str]) -> DataFrame:
    pairs = ", ".join(f"'{k}', `{c}`" for k, c in stamps.items())
    return rows.select(F.expr(f"stack({len(stamps)}, {pairs}) as (kind, at)")).where("at is not null")


def hourly(events: DataFrame, kinds: list[str], last: Column, hours: int = 24) -> DataFrame:
    """The last hours up to last, with zeros where nothing happened."""
    end = F.date_trunc("hour", last)
    start = end - F.expr(f"interval {hours - 1} hours")
    inside = events.where((F.col("at") >= start) & (F.col("at") < end + F.expr("interval 1 hour")))
    counts = inside.groupBy(F.date_trunc("hour", "at").alias("bucket")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return calendar(events.sparkSession, start, end).join(counts, "bucket", "left").select("bucket", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


def run_deltas(runs: DataFrame, source: str = "source", at: str = "at", total: str = "total") -> DataFrame:
    """Adds what each run found new against the run before it, never below 0."""
    before = F.lag(total).over(Window.partitionBy(source).orderBy(at))
    return runs.withColumn("new_entries", F.greatest(F.lit(0), F.col(total) - F.coalesce(before, F.lit(0))))


def latest_runs(runs: DataFrame, source: str = "source", at: str = "at") -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.desc(at))
    return runs.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(percent, per_second, seconds_left)."""
    rate = F.when(seconds > 0, done / seconds)
    return F.struct(F.when(total > 0, F.round(F.least(done / total, F.lit(1.0)) * 100, 1)).alias("percent"), F.round(rate, 3).alias("per_second"), F.when(rate > 0, F.round(F.greatest(F.lit(0.0), (total - done) / rate))).cast("long").alias("seconds_left"))


def hour_projection(count: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, F.round(count / (minutes / 60))).cast("long")
