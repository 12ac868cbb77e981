"""Streams: queued works as micro-batches, ordered stages, tumbling counts, matches that wait for their metadata."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)

Stage = tuple[str, Callable[[DataFrame, int], None], tuple[str, ...]]


def staged(stages: list[Stage]) -> Callable[[DataFrame, int], dict[str, str]]:
    """A batch function that runs stages in order: a failed one is logged and skips those that need it, the others go on."""

    def run(batch: DataFrame, number: int) -> dict[str, str]:
        done: dict[str, str] = {}
        for name, stage, needs in stages:
            if any(done.get(n) != "done" for n in needs):
                done[name] = "skipped"
                continue
            try:
                stage(batch, number)
                done[name] = "done"
            except Exception:
                log.exception("stage %s of batch %s failed", name, number)
                done[name] = "failed"
        return done

    return run


def queue(spark: SparkSession, path: str, schema: str, files_each: int = 16) -> DataFrame:
    """Works as they arrive in a directory, so many files a batch; offsets in the checkpoint make it at least once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def start(works: DataFrame, stages: list[Stage], checkpoint: str) -> StreamingQuery:
    run = staged(stages)

    def each(batch: DataFrame, number: int) -> None:
        run(batch, number)

    return works.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(bucket, kind, n) of a stream or table; a stream drops what comes later than the watermark."""
    x = events.withWatermark(at, late) if events.isStreaming else events
    return x.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), kind, "n")


def ripe(images: DataFrame, metadata: DataFrame, wait: str = "1 day") -> DataFrame:
    """Image matches with their metadata if it comes within the wait, else without: a left stream-stream join."""
    i, m = images.withWatermark("image_at", wait).alias("i"), metadata.withWatermark("meta_at", wait).alias("m")
    near = F.expr(f"i.match_id = m.match_id and m.meta_at between i.image_at - interval {wait} and i.image_at + interval {wait}")
    return i.join(m, near, "left_outer").select("i.match_id", "image_at", "image_score", "meta_at", "meta_score")
