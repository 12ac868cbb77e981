"""Rankings as streams of groups: contiguous groups without a shuffle, sort-merge of two streams, version checks.

Rows of a group stand together in a stream. An Arrow batch's complete groups are cut to lists by offsets, with no loop
over rows, and the open group at its end is carried into the next batch: a task holds one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from findling.sources.scratch import cut


def _starts(keys: pa.Array) -> list[int]:
    """Where runs of equal keys start; nulls are equal."""
    ends = pc.run_end_encode(keys).run_ends.to_pylist()
    return [0, *ends[:-1]] if ends else []


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.RecordBatch, list[int], bool]]:
    """Batches of whole groups with the starts of the groups, the last one marked."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        starts = _starts(rows.column(key))
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1], False
        held = rows.slice(starts[-1])
    if held is not None:
        yield held, [0], True


def _lists(rows: pa.Array, starts: list[int], where: pa.Array | None = None) -> pa.ListArray:
    """A list for each group, of the rows that `where` marks."""
    offsets = pa.array([*starts, len(rows)], pa.int32())
    if where is not None:
        before = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.cast(where, pa.int32()))])
        offsets, rows = pc.take(before, offsets), rows.filter(where)
    return pa.ListArray.from_arrays(offsets, rows)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}`: {df.schema[n].dataType.simpleString()}" for n in names)


def contiguous_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, items) of rows that are stored group by group, as ranking parts are; nothing is shuffled but the first and last group of each task, which may go on in the next.

    items: structs of the other columns in stored order. A group that is met twice apart from that is an error. Null is
    a key like any other; no rows, no groups.
    """
    names = [c for c in rows.columns if c != key]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        first = True
        for part, starts, last in _runs(batches, part_key):
            keys = part.column(part_key).take(pa.array(starts, pa.int64()))
            for k in keys.to_pylist():
                if k in seen:
                    raise ValueError(f"rows of {key} {k!r} do not stand together")
                seen.add(k)
            edge = [first and i == 0 or last for i in range(len(starts))]
            first = False
            yield pa.RecordBatch.from_arrays([keys, _lists(pa.StructArray.from_arrays([part.column(part.schema.get_field_index(n)) for n in names], names), starts), pa.array(edge)], [key, "items", "_edge"])

    part_key = rows.columns.index(key)
    parts = rows.mapInArrow(run, f"`{key}` {kind}, items array<struct<{_fields(rows, names)}>>, _edge boolean")
    parts = cut(parts.withColumn("_part", F.spark_partition_id()))
    inner, edges = parts.where(~F.col("_edge")).select(key, "items"), parts.where("_edge")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "items"))), lambda x: x["items"]))
    whole = inner.union(edges.groupBy(key).agg(joined.alias("items")))
    twice = whole.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    if again := twice.head(1):
        raise ValueError(f"rows of {key} {again[0][0]!r} do not stand together")
    return whole


def merge_groups(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, lefts, rights): the rows of both sides for every key that either has, by merging two sorted streams.

    Both sides are dealt into the same ranges of the key and sorted there, so that a range is one stream in which a
    key's left rows stand before its right rows; no hash table and no whole range is held. Lists hold structs of the
    other columns, sorted by them in order. Null keys are one group; a side without rows of a key has an empty list.
    """
    names = {s: [c for c in df.columns if c != key] for s, df in (("l", left), ("r", right))}
    kinds = {s: f"struct<{_fields(df, names[s])}>" for s, df in (("l", left), ("r", right))}
    side = lambda df, s, o: df.select(F.col(key), F.lit(s == "r").alias("_right"), *(F.struct(*names[t]).alias(f"_{t}") if t == s else F.lit(None).cast(kinds[t]).alias(f"_{t}") for t in ("l", "r")))
    both = side(left, "l", "r").unionByName(side(right, "r", "l"))
    stream = both.repartitionByRange(key).sortWithinPartitions(key, "_right", "_l", "_r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, _ in _runs(batches, 0):
            is_right = part.column(1)
            lists = _lists(part.column(2), starts, pc.invert(is_right)), _lists(part.column(3), starts, is_right)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(starts, pa.int64())), *lists], [key, "lefts", "rights"])

    return stream.mapInArrow(run, f"`{key}` {left.schema[key].dataType.simpleString()}, lefts array<{kinds['l']}>, rights array<{kinds['r']}>")


def paths_of(images: DataFrame, id_: str = "file_id", path: str = "file_path") -> DataFrame:
    """(file_id, file_path) of an image list: ids trimmed, each once, none and no path blank; others are an error."""
    rows = images.select(F.trim(F.col(id_).cast("string")).alias("file_id"), F.trim(F.col(path)).alias("file_path"))
    each = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path"), F.count_if(F.coalesce(F.col("file_path") == "", F.lit(True))).alias("blank"))
    fault = F.when(F.coalesce(F.col("file_id") == "", F.lit(True)), "image without id").when(F.col("n") > 1, F.concat(F.lit("image id twice: "), "file_id")).when(F.col("blank") > 0, F.concat(F.lit("image without path: "), "file_id"))
    return each.select("file_id", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("file_path")).alias("file_path"))


def match_candidates(ranking: DataFrame, auction_paths: DataFrame, lost_paths: DataFrame) -> DataFrame:
    """(auction_file_id, auction_file_path, auction_content_version, candidates) for each auction image of a ranking.

    Candidates are (rank, lost_file_id, lost_file_path, blocking_score) by rank. The lost side's paths are joined by
    id, the auction side's merged with the groups. A ranked image without a path, or an auction image with two
    versions, is an error; images without a ranking are left out.
    """
    lost = lost_paths.select(F.col("file_id").alias("lost_file_id"), F.col("file_path").alias("lost_file_path"))
    ranked = ranking.join(lost, "lost_file_id", "left").select(F.col("auction_file_id"), "rank", "lost_file_id", "lost_file_path", "blocking_score", "auction_content_version")
    own = auction_paths.select(F.col("file_id").alias("auction_file_id"), F.col("file_path").alias("auction_file_path"))
    met = merge_groups(ranked, own, "auction_file_id").where(F.size("lefts") > 0)
    version = lambda f: f(F.transform("lefts", lambda x: x["auction_content_version"]))
    mixed = (version(F.array_min) != version(F.array_max)) | (F.exists("lefts", lambda x: x["auction_content_version"].isNull()) & version(F.array_max).isNotNull())
    about = lambda what: F.concat(F.lit(f"{what}: "), F.coalesce(F.col("auction_file_id").cast("string"), F.lit("null")))
    fault = F.when(F.size("rights") == 0, about("ranked image without path")).when(F.exists("lefts", lambda x: x["lost_file_path"].isNull()), about("candidate without path, of")).when(mixed, about("two versions of"))
    items = F.transform("lefts", lambda x: F.struct(x["rank"].alias("rank"), x["lost_file_id"].alias("lost_file_id"), x["lost_file_path"].alias("lost_file_path"), x["blocking_score"].alias("blocking_score")))
    path = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.element_at("rights", 1)["auction_file_path"])
    return met.select("auction_file_id", path.alias("auction_file_path"), version(F.array_max).alias("auction_content_version"), items.alias("candidates"))


def one_revision(column: str) -> dict[str, Column]:
    """Metrics of a column that must not change within a run."""
    return {"rows": F.count(F.lit(1)), "unset": F.count_if(F.col(column).isNull()), "least": F.min(column), "most": F.max(column)}


def checked_write(rows: DataFrame, column: str, write: Callable[[DataFrame], None], undo: Callable[[], None]) -> dict[str, object]:
    """Write rows while their revisions are observed, in the same pass; two revisions, or some rows without one, undo the write and are an error. Returns the metrics."""
    seen = Observation()
    try:
        write(rows.observe(seen, *(m.alias(n) for n, m in one_revision(column).items())))
    except BaseException:
        undo()
        raise
    found = seen.get
    if found["least"] != found["most"] or found["unset"] not in (0, found["rows"]):
        undo()
        raise ValueError(f"{column} is not one: {found['least']} to {found['most']}, {found['unset']} of {found['rows']} rows without")
    return found


def stale_versions(results: DataFrame, images: DataFrame, id_: str, version: str) -> DataFrame:
    """Results whose image is gone or has another version by now, null-safe."""
    now = images.select(F.col("file_id").alias(id_), F.col("content_version").alias("_now"), F.lit(True).alias("_there"))
    return results.join(now, id_, "left").where(F.col("_there").isNull() | ~F.col(version).eqNullSafe(F.col("_now"))).drop("_there")
