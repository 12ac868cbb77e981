"""Dumps, loads and replays, titles, broken answers and pages of components: the cases that the tables do not hold."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from findling.functions import answers, components, titles
from findling.functions.components import Pick
from findling.operators import loads


def one(spark, column, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"{c} string" for c in "ab"[: len(texts)])).select(column.alias("x"))
    return row.first()["x"]


@pytest.mark.parametrize(("text", "want"), [(" A  B *", "A B"), ("Undefined", None), ("KÜNSTLER X", None), ("Unbekannter Meister", None), ("anonymous", None), ("A-B", "A-B"), ("A (x)+", "A (x)"), ("#", None), ("", None), (None, None)])
def test_marked_artists(spark, text, want):
    assert one(spark, titles.marked_artist(F.col("a")), text) == want


@pytest.mark.parametrize(("text", "want"), [("na", None), ("Nana", "Nana"), ("X, Signature non identifiée", None), ("x NICHT IDENTIFIZIERTE SIGNATUR y", None), (" A\n B", "A B"), (" ", None)])
def test_signed_artists(spark, text, want):
    assert one(spark, titles.signed_artist(F.col("a")), text) == want


@pytest.mark.parametrize(("text", "want"), [("A [b] (c) D", "A D"), ("unknown [x]", None), ("[]", "[]"), ("()", None), ("A () B", "A B"), (None, None)])
def test_bracketed_artists(spark, text, want):
    assert one(spark, titles.bracketed_artist(F.col("a")), text) == want


@pytest.mark.parametrize(
    ("text", "artist", "same", "title"),
    [("Max  GROSS (1900-1950)*", "Max Groß", True, None), ("Vase", "Max", False, "Vase"), ("untitled", "Max", False, None), ("Vase", None, False, None), ("(x)", "(y)", True, None), ("", "Max", False, None), (None, None, False, None)],
)
def test_titles_that_repeat_the_artist(spark, text, artist, same, title):
    assert one(spark, titles.same_identity(F.col("a"), F.col("b")), text, artist) is same
    assert one(spark, titles.title(F.col("a"), F.col("b")), text, artist) == title


@pytest.mark.parametrize(("text", "want"), [("12 - Vase", "Vase"), ("12a/13b bis — Vase.", "Vase"), ("1-2-3-4-5-6 - x", "6 - x"), ("Vase 12", "Vase 12"), (" ,; ", ""), (None, "")])
def test_display_titles(spark, text, want):
    assert one(spark, titles.display_title(F.col("a")), text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[1, {}]", ("whole", ["1", "{}"])), ("```json\n[]\n```", ("whole", [])), ('see [{"a": "ü"}].', ("brackets", ['{"a": "ü"}'])), ('{"a": 1}', ("objects", ['{"a": 1}'])), ('} {"a": 1} {"b": 2}', None),
        ('{"a": {"b": 1}, } {"c": 3}', ("objects", ['{"c": 3}'])), ('[{"a": 5"}, {"b": [1])) , {"c": 1}]', ("whole", ['{"a": 5}', '{"b": [1]}', '{"c": 1}'])), ("", None), ("[", None), ("{}}", ("objects", ["{}"])), (None, None),
    ],
)
def test_recovered_answers(spark, text, want):
    got = one(spark, answers.recovered(F.col("a")), text)
    assert (got and got["way"] and (got["way"], got["objects"])) == want


def test_recovery_of_long_answers_is_linear():
    begun = time.perf_counter()
    assert answers.array_in("{" * 500_000) is None
    assert len(answers.array_in('{"a": 1} ' * 100_000 + "[")[1]) == 100_000
    assert answers.array_in("[" * 100_000) is None
    assert time.perf_counter() - begun < 10


def page(*picks, html):
    return [(p, i, t) for p, i, t in components._Page(picks).values(html)]


def test_picks_take_the_first_filled_value_within_each_element():
    picks = (Pick("a", "p"), Pick("b", "li.x", "ul"), Pick("c", "a[href]", attribute="href"), Pick("d", "#k[data-v=1]"))
    html = '<p> </p><p>one<b>two</b><ul><li class="y x">1</li><li class=x>2</li></ul></i><ul><li class="x"></li><li class="x">3</ul><a>n</a><a href="">e</a><a href=u>f</a><q id=k>no</q><q id="k" data-v="1">yes'
    assert sorted(page(*picks, html=html)) == [(0, 0, "one two 1 2 3 n e f no yes"), (1, 1, "1"), (1, 2, "3"), (2, 0, "u"), (3, 0, "yes")]
    assert page(*picks, html=None) == page(*picks, html="") == []


def test_deep_and_long_pages_are_read_in_linear_time():
    begun = time.perf_counter()
    got = page(Pick("a", "div"), Pick("b", "p", "div"), html="<div>" * 20_000 + "<p>x</p>" * 20_000)
    assert dict(((p, i), len(t)) for p, i, t in got) == {(0, 0): 39_999, (1, 20_000): 1}
    assert time.perf_counter() - begun < 10


def test_sections_and_fields_of_pages(spark):
    picks = (Pick("t", "h1"), Pick("t", "h2"), Pick("head", "dt", "dl"), Pick("body", "dd", "dl"))
    rows = [(1, "<h2>b</h2><h1></h1><dl><dt>Kind<dd>x</dl><dl><dt>KIND</dt><dd>y</dd></dl><dl><dd>z</dd></dl>"), (2, None), (3, "<dl><dt>Other</dt><dd>w</dd></dl><h2>c</h2><h1>d")]
    found = components.page_values(spark.createDataFrame(rows, "page_id int, html string"), picks).cache()
    got = components.sections(found, "head", "body", {"kind": "kind"})
    assert [tuple(r) for r in got.collect()] == [(1, "kind", "y")]
    assert sorted(tuple(r) for r in components.fields(found.where("field = 't'")).collect()) == [(1, "t", "b"), (3, "t", "d")]


def test_dumps_are_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/dump"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    broken = rows.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        loads.dump({"good": rows, "bad": broken}, path)
    assert os.listdir(tmp_path) == []
    told = loads.dump({"good": rows, "none": rows.where("false")}, path)
    assert [tuple(r) for r in told.orderBy("place").collect()] == [("good", 0, 2, ["id", "name"]), ("none", 1, 0, ["id", "name"])]
    with pytest.raises(FileExistsError):
        loads.dump({"good": rows}, path)
    assert os.listdir(tmp_path) == ["dump"]
    assert [(n, d.count()) for n, d in loads.dumped(spark, path).items()] == [("good", 2), ("none", 0)]
    rows.write.mode("append").parquet(f"{path}/data/none")
    with pytest.raises(ValueError, match="none"):
        loads.dumped(spark, path)


def test_loads_add_only_what_is_missing(spark):
    there = spark.createDataFrame([(1, "own", 5)], "id int, name string, more int")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("b", 3), ("a", 3), ("z", None)], "name string, id long").withColumn("extra", F.lit(1))
    want = [(1, "own", 5), (2, "y", None), (3, "a", None)]
    once = loads.loaded(there, new, "id")
    assert sorted(tuple(r) for r in once.collect()) == want and once.schema == there.schema
    assert sorted(tuple(r) for r in loads.loaded(once, new, "id").collect()) == want
    assert loads.loaded(there.where("false"), new.where("false"), "id").isEmpty()


def test_paths_without_files_get_ids_after_the_largest(spark):
    works = spark.createDataFrame([(1, ["b", "k", None, "b"]), (2, ["b"]), (3, []), (4, None), (5, ["a"])], "lost_id int, img_paths array<string>")
    files = spark.createDataFrame([(7, "k"), (3, "k"), (9, None)], "image_id long, file_path string")
    fresh, links = loads.paths_as_images(works, files)
    assert sorted(tuple(r) for r in fresh.collect()) == [(10, "a", False), (11, "b", False)]
    assert sorted(tuple(r) for r in links.collect()) == [(1, 3), (1, 11), (2, 11), (5, 10)]
    fresh, links = loads.paths_as_images(works, files.where("false"))
    assert sorted(tuple(r) for r in fresh.collect()) == [(1, "a", False), (2, "b", False), (3, "k", False)]


def test_replays_reset_live_images_alone(spark):
    links = spark.createDataFrame([(1, 10, True, True), (1, 11, True, False), (2, 11, False, True), (3, 12, None, None), (4, 99, True, True), (5, None, True, True)], "auction_id int, image_id int, processed boolean, error_free boolean")
    images = spark.createDataFrame([(10, False, "a"), (11, True, "b"), (12, None, "c"), (99, False, None)], "image_id int, cleaned boolean, file_path string")
    works = spark.createDataFrame([(1, True, "t"), (2, True, "t"), (3, None, "t"), (4, True, "t"), (5, True, "t"), (6, True, "t")], "auction_id int, processed boolean, image_at string")
    out, owners = loads.replayed(links, images, works, "not coalesce(cleaned, false) and file_path is not null")
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 10, False, False), (1, 11, True, False), (2, 11, False, True), (3, 12, None, None), (4, 99, True, True), (5, None, True, True)]
    assert sorted(map(tuple, owners.collect())) == [(1, False, None), (2, True, "t"), (3, None, "t"), (4, True, "t"), (5, True, "t"), (6, True, "t")]


def test_variants_and_lists_are_added_where_there_are_none(spark):
    new = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), ("", "x"), ("a", None), ("a", "")], "name string, raw string")
    there = spark.createDataFrame([("a", "y"), (None, "x")], "name string, raw string")
    assert [tuple(r) for r in loads.variants_added(new, there, "name", "raw").collect()] == [("a", "x")]
    rows = spark.createDataFrame([(1, None, ["f"]), (2, [], ["f"]), (3, ["o"], ["f"]), (4, [None], ["f"]), (5, [], None)], "i int, names array<string>, found array<string>")
    assert sorted((tuple(r) for r in loads.backfilled(rows, "names", "found").collect()), key=repr) == [(1, ["f"]), (2, ["f"]), (3, ["o"]), (4, [None]), (5, None)]
