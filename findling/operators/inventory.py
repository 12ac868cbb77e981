"""Inventories for replication: keyset pages, byte budgets, digests, hash comparison, closure, clean-up eligibility."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next rows behind a composite key."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True))))
    return rows.orderBy(*keys).limit(size)


def row_bytes(*columns: str) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def budget(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum(row_bytes(*rows.columns)).alias("bytes"))


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str, ranges: int = 256) -> DataFrame:
    """Adds the sum of value over all rows up to each in key order. Ranges of the first key, told by a sample of at most 16 keys for each, are summed apart; only their totals, a row for each range, meet in one task."""
    first = F.col(keys[0])
    some = rows.select(first.alias("b")).where("b is not null").orderBy(F.xxhash64("b"), "b").limit(16 * ranges).orderBy("b").collect()
    bounds = [r["b"] for r in some[16::16]]
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < first)) if bounds else F.lit(0)
    x = rows.withColumns({"_range": at, "_value": value})
    total = x.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = total.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_value", "_own", "_before")


def byte_pages(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Adds `page`: rows in key order, a new page wherever the running size passes a multiple of most."""
    x = running_sum(rows.withColumn("_b", row_bytes(*rows.columns)), keys, F.col("_b"), "_upto")
    return x.withColumn("page", F.floor((F.col("_upto") - F.col("_b")) / most).cast("long")).drop("_b", "_upto")


def entity_hash(*columns: str) -> Column:
    """A digest over named columns, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def graph_hash(rows: DataFrame, key: str, refs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, hash): the digest of a row's own hash and those of the rows it refers to. refs: column -> (hashes, their key)."""
    x = rows.withColumn("_h", entity_hash(*rows.columns))
    for i, (column, (hashes, ref_key)) in enumerate(refs.items()):
        x = x.join(hashes.select(F.col(ref_key).alias(column), F.col("hash").alias(f"_r{i}")), column, "left")
    parts = [F.col("_h"), *(F.coalesce(f"_r{i}", F.lit("")) for i in range(len(refs)))]
    return x.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("hash"))


def ordered_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the digest of the rows in key order, each by its length and bytes. Ranges of keys are digested apart and their digests in order, so only one short line for each range meets."""
    cut = rows.select(*keys, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_j"))
    cut = cut.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyspark import TaskContext

        h, n = hashlib.sha256(), 0
        for frame in frames:
            for j in frame["_j"]:
                data = j.encode()
                h.update(len(data).to_bytes(8, "big") + data)
                n += 1
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "digest": [h.hexdigest()]})

    parts = cut.mapInPandas(run, "part int, n long, digest string").where("n > 0")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(line, 256).alias("digest"))


def bag_digest(rows: DataFrame) -> DataFrame:
    """One row: count and an order-free digest (sums of the four 15-digit parts of row hashes)."""
    h = rows.select(entity_hash(*rows.columns).alias("h"))
    return h.agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"d{i}") for i in range(4)))


def hash_mismatches(advertised: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, fault): missing, extra or different."""
    x = advertised.select(key, F.col("hash").alias("a")).join(actual.select(key, F.col("hash").alias("b")), key, "full_outer")
    return x.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("different").alias("fault"))


def operation_digest(pages: DataFrame, digest: str = "digest") -> DataFrame:
    return pages.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("digest"))


def reference_closure(starts: dict[str, DataFrame], hops: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """(kind, id) of everything that starts lead to. hops: (kind, rows, its key, column that refers, kind referred to), in an order in which kinds come before what they refer to."""
    found = {k: d.select(F.col(d.columns[0]).alias("id")).distinct() for k, d in starts.items()}
    for kind, rows, key, column, target in hops:
        if kind not in found:
            continue
        ids = rows.join(found[kind].withColumnRenamed("id", key), key, "left_semi").where(F.col(column).isNotNull()).select(F.col(column).alias("id"))
        found[target] = ids.union(found[target]).distinct() if target in found else ids.distinct()
    out = None
    for k, d in found.items():
        part = d.select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out


def cleanup_flags(images: DataFrame, links: DataFrame, works: DataFrame, scores: DataFrame, lost_links: DataFrame) -> DataFrame:
    """(image_id, file_path, four flags): whether an image belongs to a work that is done with and unmatched, to a lost work, to a work still needed, or to a score. Existence as columns: left joins with distinct keys."""
    per = links.join(images.select("image_id", "is_embedded"), "image_id", "left").groupBy("auction_id").agg(F.bool_and(F.col("processed") & F.col("error_free")).alias("done"), F.bool_and(F.coalesce("is_embedded", F.lit(True))).alias("embedded"))
    eligible = works.where("processed").select("auction_id").join(per.where("done and embedded"), "auction_id", "left_semi").join(scores.select("auction_id"), "auction_id", "left_anti").withColumn("_e", F.lit(True))
    linked = links.select("auction_id", "image_id").join(eligible, "auction_id", "left").groupBy("image_id").agg(F.bool_or(F.col("_e").isNotNull()).alias("has_candidate_auction"), F.bool_or(F.col("_e").isNull()).alias("has_protected_auction_reference"))
    flag = lambda d, c: d.where(F.col(c).isNotNull()).select(F.col(c).alias("image_id")).distinct()
    x = images.where("file_path is not null and not cleaned").join(linked, "image_id", "left")
    x = x.join(flag(lost_links, "image_id").withColumn("_l", F.lit(True)), "image_id", "left").join(flag(scores, "best_image_file_id").withColumn("_s", F.lit(True)), "image_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return x.select("image_id", "file_path", yes("has_candidate_auction").alias("has_candidate_auction"), yes("_l").alias("has_lost_reference"), yes("has_protected_auction_reference").alias("has_protected_auction_reference"), yes("_s").alias("has_direct_score_reference"))


def cleanup_targets(flags: DataFrame) -> DataFrame:
    """(file_path, removable): rows that share a file are candidates if any is, and protected if any is."""
    kept = F.col("has_lost_reference") | F.col("has_protected_auction_reference") | F.col("has_direct_score_reference")
    return flags.groupBy("file_path").agg(F.bool_or("has_candidate_auction").alias("_c"), F.bool_or(kept).alias("_k")).select("file_path", (F.col("_c") & ~F.col("_k")).alias("removable"))
