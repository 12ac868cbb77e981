"""Pairs made by blocks and by classes against brute force, and what their plans hand over for each pair."""

from __future__ import annotations

import math
import random

import pytest

from findling.functions import similarity
from findling.operators import blocks, pairs
from findling.plans import queries

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_of_jaro_winkler_equals_pairs():
    draw = random.Random(5)
    text = lambda: "".join(draw.choice("abé# 0\0") for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 18, 31, 32, 33, 63, 64, 65, 90])))
    left, right = [text() for _ in range(120)] + [None, "martha", "a"], [text() for _ in range(70)] + [None, "marhta", "a"]
    got = similarity.jaro_winkler_table(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert math.isnan(got[i, j]) if a is None or b is None else got[i, j] == similarity.jaro_winkler_pair(a, b), (a, b)
    assert similarity.jaro_winkler_table([None], [None, "x"]).shape == (1, 2)


def test_blocks_hold_every_pair_once(spark):
    draw = random.Random(6)
    side = lambda n, first: [(first + k, draw.choice([0, 1, 1, 1]), draw.choice(["ab", "abc", "b", None])) for k in range(n)] + [(None, 1, "ab"), (None, 1, "ab")]
    left, right = side(700, 0), side(300, 5000)
    a, b = spark.createDataFrame(left, "a long, g int, x string"), spark.createDataFrame(right, "b long, g int, y string")
    got = blocks.compared(a, b, ["g"], ("a", "b"), ("x", "y"), similarity.jaro_winkler_table, "s", (702, 302)).collect()
    value = lambda x, y: None if x is None or y is None else similarity.jaro_winkler_pair(x, y)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, j, value(x, y))) for i, g, x in left for j, h, y in right if g == h)
    every = blocks.compared(a, b, [], ("a", "b"), ("x", "y"), similarity.jaro_winkler_table, "s", (702, 302))
    assert every.count() == 702 * 302


def test_artists_of_the_same_nation_go_to_python_by_lists(spark):
    said = plan(queries.QUERIES["sc3_artist_similarity"](spark, DIR))
    assert "MapInArrow" in said and "ArrowEvalPython" not in said


def test_best_artists_equal_pairs(spark):
    names, artists = [["A b", None, "unbekannt"], ["Cd", "a B "], [], None, ["unbekannt", " "]], [" a b", "cde", "Unbekannt", None, ""]
    got = pairs.best_artists(names, artists)
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(artists)], "i int, j int, a array<string>, b string")
    for r in rows.withColumn("s", pairs.best_artist("a", "b")).collect():
        assert math.isnan(got[r["i"], r["j"]]) if r["s"] is None else got[r["i"], r["j"]] == r["s"]


def test_best_artists_go_to_python_by_lists(spark):
    said = plan(queries.QUERIES["sc4_best_artist"](spark, DIR))
    assert "MapInArrow" in said and "ArrowEvalPython" not in said


def test_classes_hold_every_pair_once(spark):
    draw = random.Random(7)
    left = [(k, draw.choice([0, 1]), draw.choice(["x", None])) for k in range(800)] + [(None, 1, "x")] * 2
    right = [(5000 + k, draw.choice([0, 1, 2]), draw.choice(["y", "z"])) for k in range(310)] + [(None, 0, None)]
    a, b = spark.createDataFrame(left, "a long, g int, x string"), spark.createDataFrame(right, "b long, g int, y string")
    met = blocks.class_pairs(a, b, ["g"], ("a", "b"), (["x"], ["y"]), (802, 311))
    got = [tuple(r) for r in blocks.listed(met).select("g", "x", "y", "a", "b").collect()]
    assert sorted(map(repr, got)) == sorted(repr((g, x, y, i, j)) for i, g, x in left for j, h, y in right if g == h)
    assert max(len(r["_left"]) for r in met.select("_left").collect()) <= blocks.LIST_ROWS and blocks.listed(blocks.class_pairs(a, b, [], ("a", "b"), (["x"], ["y"]), (802, 311))).count() == 802 * 311


def test_titles_are_compared_once_for_each_two_classes(spark):
    said = plan(queries.QUERIES["sc1_title_similarity"](spark, DIR))
    assert said.index("explode") < said.index("levenshtein") < said.index("Join")  # the plan's top comes first


@pytest.mark.parametrize("name", ["jn2_interval_overlap", "jn3_tolerance_band"])
def test_equal_ranges_meet_once(spark, name):
    said = plan(queries.QUERIES[name](spark, DIR))
    assert said.index("explode") < said.index("Join") and "collect_list" in said


def test_pair_scoring_compares_titles_by_classes_whatever_the_lists(spark, monkeypatch):
    """Titles are compared below the listing of pairs; lists of names by number and by pair give the same scores."""
    few = queries.QUERIES["jn1_score_pairs"](spark, DIR)
    said = plan(few)
    assert said.index("explode") < said.index("levenshtein") and "lost_material_no" in said
    monkeypatch.setattr(pairs, "LIST_PAIRS", 0)
    many = queries.QUERIES["jn1_score_pairs"](spark, DIR)
    assert "lost_material_no" not in plan(many)
    rows = few.collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("name", ["sc5_dating_similarity", "sc6_dimensions_similarity"])
def test_sides_are_dealt_to_all_cores(spark, name):
    said = plan(queries.QUERIES[name](spark, DIR))
    assert said.index("explode") < said.index("Join") and "REPARTITION_BY_NUM" in said
