"""Group streams, merges, version checks, sharded stores and caches."""

from __future__ import annotations

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from findling.operators import rankings
from findling.sources import shards


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_contiguous_groups_over_batches_and_tasks(spark, small_batches):
    """Groups of 1 to 20 rows in batches of three, and tasks that end within a group."""
    rng, rows = random.Random(1), []
    for k in [*range(40), None]:
        rows += [(k, i, f"c{k}-{i}") for i in range(rng.randrange(1, 21))]
    stored = spark.createDataFrame(spark.sparkContext.parallelize(rows, 7), "k int, rank int, name string")
    got = {r["k"]: [(i["rank"], i["name"]) for i in r["items"]] for r in rankings.contiguous_groups(stored, "k").collect()}
    assert got == {k: [r[1:] for r in own] for k, own in itertools.groupby(rows, lambda r: r[0])}
    assert rankings.contiguous_groups(stored.limit(0), "k").collect() == []


@pytest.mark.parametrize("parts", [1, 4])
def test_group_seen_twice_is_rejected(spark, small_batches, parts):
    rows = [(k, i, "x") for k in (1, 2, 3, 2, 4, 5) for i in range(5)]
    with pytest.raises(Exception, match="do not stand together"):
        rankings.contiguous_groups(spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "k int, rank int, name string"), "k").collect()


def test_merge_of_two_streams(spark, small_batches):
    rng = random.Random(2)
    left = [(rng.choice([None, *range(12)]), rng.randrange(50)) for _ in range(90)]
    right = [(rng.choice([None, *range(6, 20)]), f"r{rng.randrange(9)}") for _ in range(70)]
    got = rankings.merge_groups(spark.createDataFrame(left, "k int, a int").repartition(3), spark.createDataFrame(right, "k int, b string"), "k")
    want = collections.defaultdict(lambda: ([], []))
    for side, rows in enumerate((left, right)):
        for k, v in sorted(rows, key=lambda r: r[1]):
            want[k][side].append(v)
    assert {r["k"]: ([x["a"] for x in r["lefts"]], [x["b"] for x in r["rights"]]) for r in got.collect()} == dict(want)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and plan.count("Exchange rangepartitioning") >= 1


RANKING = "auction_file_id string, auction_content_version long, lost_file_id string, rank int, blocking_score float"


def test_candidates_with_paths(spark):
    ranking = spark.createDataFrame([("a", 1, "y", 2, 0.5), ("a", 1, "x", 1, 0.75), ("b", None, "x", 1, 0.25)], RANKING)
    auction = rankings.paths_of(spark.createDataFrame([(" a ", "p/a"), ("b", "p/b"), ("c", "p/c")], "file_id string, file_path string"))
    lost = rankings.paths_of(spark.createDataFrame([("x", "q/x"), ("y", "q/y")], "file_id string, file_path string"))
    got = {r["auction_file_id"]: (r["auction_file_path"], r["auction_content_version"], [tuple(c) for c in r["candidates"]]) for r in rankings.match_candidates(ranking, auction, lost).collect()}
    assert got == {"a": ("p/a", 1, [(1, "x", "q/x", 0.75), (2, "y", "q/y", 0.5)]), "b": ("p/b", None, [(1, "x", "q/x", 0.25)])}
    for bad, says in (((("d", 1, "x", 1, 0.5)), "image without path"), (("c", 1, "z", 1, 0.5), "candidate without path"), (("a", 2, "x", 3, 0.5), "two versions")):
        with pytest.raises(Exception, match=says):
            rankings.match_candidates(ranking.union(spark.createDataFrame([bad], RANKING)), auction, lost).collect()


@pytest.mark.parametrize(("rows", "says"), [([("a", "p"), (" a", "q")], "twice"), ([("a", " ")], "without path"), ([(" ", "p")], "without id"), ([("a", None)], "without path")])
def test_image_lists_with_faults(spark, rows, says):
    with pytest.raises(Exception, match=says):
        rankings.paths_of(spark.createDataFrame(rows, "file_id string, file_path string")).collect()


def test_mixed_revisions_are_refused(spark, tmp_path):
    at = str(tmp_path / "out")
    folder = shards.Folder(spark, str(tmp_path))
    write = lambda df: df.write.parquet(at)
    undo = lambda: folder.remove("out")
    for extra in (F.when(F.col("id") == 7, 2).otherwise(1), F.when(F.col("id") != 7, 1)):
        with pytest.raises(ValueError, match="revision is not one"):
            rankings.checked_write(spark.range(20).withColumn("revision", extra), "revision", write, undo)
        assert not folder.names("out")
    assert rankings.checked_write(spark.range(20).withColumn("revision", F.lit(3)), "revision", write, undo) == {"rows": 20, "unset": 0, "least": 3, "most": 3}
    assert spark.read.parquet(at).count() == 20


def test_results_of_other_versions(spark):
    results = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", None)], "file_id string, version long")
    images = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "file_id string, content_version long")
    assert {r["file_id"] for r in rankings.stale_versions(results, images, "file_id", "version").collect()} == {"b", "d"}


def fails(df, at):
    df.withColumn("x", F.raise_error(F.lit("stop"))).write.parquet(at)


def test_atomic_write_keeps_the_old_table(spark, tmp_path):
    at = str(tmp_path / "t")
    shards.atomic_write(spark.range(3), at)
    with pytest.raises(Exception, match="stop"):
        shards.atomic_write(spark.range(9), at, fails)
    assert spark.read.parquet(at).count() == 3
    shards.atomic_write(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def state(store):
    return {(r["shard"], r["version"]) for r in store.manifest().collect()}


def test_store_writes_changed_shards_only(spark, tmp_path):
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 2 == 0).alias("even"), F.lit("007").alias("tag"))
    store = shards.Store(spark, str(tmp_path / "s"), F.concat("tag", F.lit(":"), F.expr("id div 10")), ("id", "even"))
    assert store.read() is None and store.commit(rows) == 4 and store.commit(rows.repartition(5)) == 0
    assert state(store) == {(f"007:{i}", 1) for i in range(4)}
    assert store.commit(rows.withColumn("even", F.when(F.col("id") != 13, F.col("even")))) == 1
    assert state(store) == {("007:0", 1), ("007:1", 2), ("007:2", 1), ("007:3", 1)}
    assert store.read().count() == 40 and store.read().where("even is null").count() == 1
    assert store.commit(rows.where("id < 20")) == 1 and {s for s, _ in state(store)} == {"007:0", "007:1"} and store.read().count() == 20
    assert len(list((tmp_path / "s/data").glob("shard=*/identity=*"))) == 2 and len(list((tmp_path / "s/manifests").iterdir())) == 1


def test_failing_commit_leaves_the_state(spark, tmp_path):
    rows = spark.range(20).select("id", F.lit(1).alias("v"))
    store = shards.Store(spark, str(tmp_path / "s"), F.expr("id div 10"), ("id", "v"))
    store.commit(rows)
    with pytest.raises(Exception, match="stop"):
        store.commit(rows.withColumn("v", F.col("id")), lambda some: some.withColumn("v", F.when(F.col("id") == 15, F.raise_error(F.lit("stop"))).otherwise(F.col("v"))))
    assert state(store) == {("0", 1), ("1", 1)} and {r["v"] for r in store.read().collect()} == {1}
    assert store.commit(rows.withColumn("v", F.col("id"))) == 2 and store.read().agg(F.sum("v")).first()[0] == sum(range(20))


def test_embedding_cache_is_revalidated(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embed(some):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return some.mapInArrow(count, some.schema).withColumn("vector", F.array(F.length("digest").cast("double")))

    images = spark.range(30).select(F.col("id").cast("string").alias("file_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("long").alias("content_version"), F.lit("m1").alias("model"))
    store = shards.Store(spark, str(tmp_path / "s"), F.expr("cast(file_id as int) div 10"), ("file_id", "digest", "content_version", "model"))
    assert shards.refreshed(store, images, embed) == 3 and seen.value == 30
    assert shards.refreshed(store, images, embed) == 0 and seen.value == 30
    changed = images.withColumn("digest", F.when(F.col("file_id") == "12", "other").otherwise(F.col("digest")))
    assert shards.refreshed(store, changed, embed) == 1 and seen.value == 31
    vectors = {r["file_id"]: r["vector"] for r in store.read().collect()}
    assert len(vectors) == 30 and vectors.pop("12") == [5.0] and set(map(tuple, vectors.values())) == {(64.0,)}
    assert shards.refreshed(store, changed.withColumn("model", F.lit("m2")), embed) == 3 and seen.value == 61
    assert shards.refreshed(store, images.where("file_id <> '3'").withColumn("model", F.lit("m2")), embed) == 2 and store.read().count() == 29
