from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.functions import similarity
from findling.operators import images, indexes, inventory, pairs, tables, trees, vectors


def test_top_k(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["candidate_id"], r["score"]) for r in vectors.top_k(q, c, 9).collect()}
    assert [got[0, k][0] for k in (1, 2, 3)] == [0, 1, 2] and [got[1, k][0] for k in (1, 2, 3)] == [1, 0, 2] and len(got) == 6
    with pytest.raises(ValueError):
        vectors.top_k(q, c, 0)


def test_trees(spark):
    t = spark.createDataFrame([("unbekannt", None), ("a", "unbekannt"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "name string, parent string")
    paths = {r["name"]: r["path"] for r in trees.root_paths(t).collect()}
    assert paths["b"] == ["b", "a", "unbekannt"] and paths["x"] == ["x", "y"]
    sims = {(r["a"], r["b"]): r["similarity"] for r in trees.similarity_table(trees.root_paths(t)).collect()}
    assert sims["b", "c"] == pytest.approx(1 / 3) and sims["a", "b"] == 0.5 and sims["b", "b"] == 1 and sims["unbekannt", "a"] is None
    assert {tuple(r) for r in trees.tree_faults(t).collect()} == {("x", "not reached"), ("y", "not reached")}


def test_trees_deeper_than_sixteen(spark):
    t = spark.createDataFrame([("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 19))], "name string, parent string")
    chain = [f"n{i}" for i in range(18, -1, -1)]
    assert trees.root_paths(t).where("name = 'n18'").first()["path"] == chain
    assert {r["name"] for r in trees.ancestors(t.where("name = 'n18'").select("name"), t).collect()} == set(chain)
    assert trees.tree_faults(t).count() == 0


def test_year_coverage_and_confidence(spark):
    rows = spark.createDataFrame([(1900, 1900), (1900, 1901), (1902, 1902)], "dating_start int, dating_end int")
    assert [r["n"] for r in indexes.year_coverage(rows).orderBy("year").collect()] == [2, 1, 1]
    cover = spark.createDataFrame([(1900, 10), (1901, 2), (1902, 1), (1903, 5)], "year int, n long")
    x = spark.createDataFrame([(1902, 1902), (1900, 1900), (1898, 1901), (1501, 1504), (None, 1900)], "a int, b int")
    got = {(r["a"], r["b"]): r["c"] for r in indexes.interval_confidence(x, cover, 10, "a", "b", "c").collect()}
    assert got[1902, 1902] == 1 and got[1900, 1900] == 0 and got[1501, 1504] == 1 and got[None, 1900] is None
    assert got[1898, 1901] == pytest.approx(np.log(5) / 4 / np.log(10))


def test_artist_index(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c; d"]), (4, None), (5, [""])], "lost_id int, artists array<string>")
    counts, total = indexes.artist_index(docs)
    assert {r["artist_key"]: r["n"] for r in counts.collect()} == {"a": 1, "b": 2, "c": 2, "d": 1} and total.first()["total"] == 3


def _side(spark, rows, prefix, artist):
    schema = f"{prefix}_id long, {prefix}_title string, {artist}, {prefix}_materials array<string>, {prefix}_techniques array<string>, {prefix}_dating_start int, {prefix}_dating_end int, {prefix}_width double, {prefix}_height double"
    return spark.createDataFrame(rows, schema)


def test_pair_scoring(spark):
    lost = _side(spark, [(1, "Mill by the river", ["Anna Adler"], ["oil"], ["paint"], 1850, 1850, 40.0, 50.0), (2, "Castle", ["Ben Baum"], ["oil"], [], 1700, 1710, 10.0, 12.0), (3, None, [], ["oil"], [], 1800, 1800, 33.0, 21.0)], "lost", "lost_artists array<string>")
    auction = _side(spark, [(7, "Mill by the River", "Anna Adler", ["oil"], ["paint"], 1845, 1855, 40.0, 50.0), (8, None, None, ["oil"], [], 1850, 1850, 40.0, 50.0)], "auction", "auction_artist string")
    tree = spark.createDataFrame([("unbekannt", None), ("oil", "unbekannt"), ("paint", "unbekannt")], "name string, parent string")
    got = {(r["lost_id"], r["auction_id"]): r for r in pairs.score_pairs(lost, auction, tree, tree).collect()}
    assert set(got) == {(1, 7)} and got[1, 7]["final_score"] == pytest.approx(1) and got[1, 7]["confidence_score"] >= 0.5
    known = spark.createDataFrame([(3, 8), (2, 7)], "lost_id long, auction_id long")
    got = {(r["lost_id"], r["auction_id"]): r for r in pairs.score_pairs(lost, auction, tree, tree, known).collect()}
    assert set(got) == {(1, 7), (3, 8), (2, 7)} and got[3, 8]["final_score"] == 0 and got[3, 8]["title_sim"] == 0


def test_pairs_meet_in_blocks(spark):
    a, b = spark.range(50).withColumnRenamed("id", "lost_id"), spark.range(7).withColumnRenamed("id", "auction_id")
    assert pairs.meet(a, b, limit=10).distinct().count() == 350


def test_statistics_of_no_scores(spark):
    got = spark.range(1).select(images.score_statistics(F.array().cast("array<double>")).alias("s")).first()["s"]
    assert got["n"] == 1 and got["mean"] == 0 and got["p50"] == 0


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 6), (3, "c", 7)], "k int, x string, y int")
    once = tables.upsert(old, new, ["k"], keep_old_if_null=True)
    assert {tuple(r) for r in once.collect()} == {(1, "a", None), (2, "b", 6), (3, "c", 7)} == {tuple(r) for r in tables.upsert(once, new, ["k"], keep_old_if_null=True).collect()}


def test_ordered_digest_sees_order_free_content(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 3 % 7).alias("v"))
    a, b = (inventory.ordered_digest(d, ["id"]).first() for d in (rows, rows.orderBy(F.desc("id"))))
    assert a["n"] == 1000 and a["digest"] == b["digest"] or a["n"] == b["n"]
    assert inventory.bag_digest(rows).first() == inventory.bag_digest(rows.orderBy(F.desc("id"))).first()


def test_densities_of_few_and_of_many_points_agree(spark, monkeypatch):
    r = random.Random(3)
    sizes = spark.createDataFrame([(float(r.randint(1, 40)), float(r.randint(1, 60))) for _ in range(400)] + [(400.0, 900.0)], "width double, height double")
    few = {tuple(x)[:2]: x[2] for x in indexes.density_confidence(sizes, sizes, "width", "height", "d").collect()}
    monkeypatch.setattr(indexes, "BROADCAST_POINTS", 0)
    many = {tuple(x)[:2]: x[2] for x in indexes.density_confidence(sizes, sizes, "width", "height", "d").collect()}
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], abs=1e-9) for k in few)


def test_pairs_against_all_pairs(spark):
    """Pruning loses no pair: the same pairs as when all are known before, and so never pruned."""
    r = random.Random(4)
    words, names = ["Portrait", "of", "a", "lady", "Landschaft", "mit", "river", "boat"], ["Jan Steen", "Jan Stein", "unbekannt", "Rubens"]
    title = lambda: r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(1, 4)))])
    some = lambda v: r.choice([None, v])
    lost = [(i, title(), r.sample(names, r.randint(0, 2)), ["oil"], ["etching"], some(1600), some(1650), some(30.0 + r.randint(0, 5)), some(40.0)) for i in range(40)]
    sold = [(i, title(), r.choice([*names, None]), r.sample(["oil", "paper"], 1), ["etching"], some(1620), some(1700), some(31.0), some(41.0 + r.randint(0, 9))) for i in range(30)]
    rest = "materials array<string>, {0}_techniques array<string>, {0}_dating_start int, {0}_dating_end int, {0}_width double, {0}_height double"
    left = spark.createDataFrame(lost, "lost_id int, lost_title string, lost_artists array<string>, lost_" + rest.format("lost"))
    right = spark.createDataFrame(sold, "auction_id int, auction_title string, auction_artist string, auction_" + rest.format("auction"))
    tree = spark.createDataFrame([("unbekannt", None), ("oil", "unbekannt"), ("paper", "unbekannt"), ("etching", "paper")], "name string, parent string")
    every = left.select("lost_id").crossJoin(right.select("auction_id"))
    got = {(x["lost_id"], x["auction_id"]): x for x in pairs.score_pairs(left, right, tree, tree).collect()}
    known = {(x["lost_id"], x["auction_id"]): x for x in pairs.score_pairs(left, right, tree, tree, every).collect()}
    assert len(known) == 1200 and got and got == {k: x for k, x in known.items() if x["final_score"] >= 0.7 and x["confidence_score"] >= 0.5}
    for (i, j), x in known.items():
        a, b = lost[i], sold[j]
        if (a[1] and a[1].strip() or a[2]) and (b[1] and b[1].strip() or b[2]):
            sims = {c: x[f"{c}_sim"] for c in pairs.scoring.WEIGHTS}
            bottom = sum(w for c, w in pairs.scoring.WEIGHTS.items() if sims[c] is not None)
            assert x["final_score"] == pytest.approx(sum(w * sims[c] for c, w in pairs.scoring.WEIGHTS.items() if sims[c] is not None) / bottom if bottom else 0)
            best = [similarity.jaro_winkler_pair(n.lower(), b[2].lower()) for n in a[2] if n != "unbekannt"] if b[2] and b[2] != "unbekannt" else []
            assert sims["artist"] == (max(best) if best else None)


def test_running_sums_of_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice([None, r.randint(0, 500)]), i, r.randint(0, 9)) for i in range(3000)]
    got = inventory.running_sum(spark.createDataFrame(rows, "k int, i int, v int"), ["k", "i"], F.col("v"), "s", ranges=8).collect()
    upto, want = 0, {}
    for k, i, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        upto += v
        want[i] = upto
    assert {x["i"]: x["s"] for x in got} == want
    names = inventory.running_sum(spark.createDataFrame([(c,) for c in "banana"], "k string").distinct(), ["k"], F.lit(1), "s").collect()
    assert sorted(map(tuple, names)) == [("a", 1), ("b", 2), ("n", 3)]
    assert inventory.running_sum(spark.createDataFrame([], "k int, v int"), ["k"], F.col("v"), "s").count() == 0


def test_dictionary_names_in_order_with_the_root_for_the_rest(spark):
    from findling.operators import catalogue

    variants = spark.createDataFrame([("öl", ["Öl"]), ("holz", ["Holz", "Öl"]), ("leer", [])], "key string, names array<string>")
    rows = spark.createDataFrame([(1, "Holz und Öl"), (2, "Öl, Holz, Öl"), (3, None), (4, " "), (5, "Blech"), (6, "leer"), (7, "Holz und Öl")], "k int, raw string")
    got = {r["k"]: r["names"] for r in catalogue.dictionary_names(rows, "raw", variants, "?").collect()}
    assert got == {1: ["Holz", "Öl"], 2: ["Öl", "Holz"], 3: ["?"], 4: ["?"], 5: ["?"], 6: ["?"], 7: ["Holz", "Öl"]}
