"""Parts of one catalogue taken over into another."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from findling.operators import transfer


@pytest.mark.parametrize(
    ("path", "want"),
    [(" ./a/b.jpg ", "p/q/a/b.jpg"), ("/root/x/a.jpg", "p/q/a.jpg"), ("/root/xy/a.jpg", "/root/xy/a.jpg"), ("p/q", "p/q"), ("p/q/a", "p/q/a"), ("p/qa", "p/q/p/qa"), ("/z", "/z"), (None, None)],
)
def test_portable_paths(spark, path, want):
    rows = spark.createDataFrame([(path,)], "a string")
    assert rows.select(transfer.portable_path(F.col("a"), "/root/x/", "./p/q/").alias("x")).first()["x"] == want
    assert rows.select(transfer.portable_path(F.col("a"), "", "p/q").alias("x")).first()["x"] == ("/root/x/a.jpg" if path == "/root/x/a.jpg" else want)


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="module")
def catalogues(spark):
    works = "auction_id int, artist_id int, platform_id int, lot_id string, lot_url string, names array<string>"
    own = {
        "works": table(spark, works, (1, 1, 1, "a", None, ["oil", None]), (2, 2, 1, "b", "u2", []), (3, None, None, None, None, None), (4, 3, 2, "c", None, ["ink"]), (5, 9, 1, "a", "u5", None), (6, 1, 1, "z", None, None)),
        "artists": table(spark, "artist_id int, complete_name string", (1, "Ann"), (2, "Bo"), (3, "ann"), (4, "Cy"), (9, None)),
        "platforms": table(spark, "platform_id int, name string", (1, "One"), (2, "Two")),
        "dictionary": table(spark, "name string, parent string", ("all", None), ("paint", "all"), ("oil", "paint"), ("ink", "all"), ("wax", "all")),
        "images": table(spark, "image_id int, file_path string", (1, "./i/1"), (2, "/srv/2"), (3, "i/3"), (4, None)),
        "links": table(spark, "auction_id int, image_id int", (1, 1), (1, 2), (2, 2), (4, 3), (5, 4), (6, 3)),
    }
    there = {
        "works": table(spark, works, (70, None, 11, "q", "u2", None), (3, None, None, None, None, None), (71, None, 2, None, None, None)),
        "artists": table(spark, "artist_id int, complete_name string", (8, "ANN"), (7, "ann"), (2, "bo")),
        "platforms": table(spark, "platform_id int, name string", (11, "ONE")),
        "dictionary": table(spark, "name string, parent string", ("all", None)),
        "images": table(spark, "image_id int, file_path string", (5, "p/2"), (6, "x")),
    }
    return own, there


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exports_hold_what_scored_works_refer_to(spark, catalogues):
    own, _ = catalogues
    scores = table(spark, "auction_id int", (1,), (1,), (2,), (3,), (4,), (5,), (99,), (None,))
    got = transfer.exported(own, scores, "/srv", "p")
    assert rows_of(got["works"], "auction_id") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows_of(got["artists"], "artist_id") == [(1,), (2,), (3,), (9,)]
    assert rows_of(got["dictionary"], "name") == [("all",), ("ink",), ("oil",), ("paint",)]
    assert rows_of(got["images"], "image_id", "file_path") == [(1, "p/i/1"), (2, "p/2"), (3, "p/i/3"), (4, None)]
    with pytest.raises(ValueError, match="no work"):
        transfer.exported(own, scores.where("auction_id = 99"), "/srv", "p")


def test_imports_translate_ids_and_add_nothing_twice(spark, catalogues):
    own, there = catalogues
    export = transfer.exported(own, own["works"].where("auction_id < 6").select("auction_id"), "/srv", "p")
    new = transfer.imported(export, there)
    # 2 is there by its address on the platform of the same name, 3 by its id; artist 1 is there by name alone, as its smallest id
    assert rows_of(new.works, "auction_id", "artist_id", "platform_id") == [(1, 7, 11), (4, 7, 2), (5, 9, 11)]
    assert rows_of(new.artists, "artist_id") == [(9,)] and rows_of(new.platforms, "platform_id") == [(2,)]
    assert rows_of(new.dictionary, "name") == [("ink",), ("oil",), ("paint",)]
    assert rows_of(new.images, "image_id", "file_path") == [(7, "p/i/1"), (8, "p/i/3")]
    assert rows_of(new.links, "auction_id", "image_id") == [(1, 5), (1, 7), (4, 8)]
    after = {k: there[k].select(*there[k].columns).unionByName(getattr(new, k).select(*there[k].columns)) for k in there}
    again = transfer.imported(export, after)
    assert all(getattr(again, k).isEmpty() for k in ("artists", "platforms", "dictionary", "works", "images", "links"))


def test_imports_into_an_empty_catalogue_keep_ids(spark, catalogues):
    own, there = catalogues
    export = transfer.exported(own, own["works"].select("auction_id"), "/srv", "p")
    new = transfer.imported(export, {k: d.where("false") for k, d in there.items()})
    assert rows_of(new.works, "auction_id", "artist_id") == rows_of(own["works"], "auction_id", "artist_id")
    assert new.images.count() == 3 and new.links.count() == 5  # the image without a path links nothing


def test_imports_that_would_mix_up_things_are_refused(spark, catalogues):
    own, there = catalogues
    export = transfer.exported(own, own["works"].select("auction_id"), "/srv", "p")
    with pytest.raises(ValueError, match="different names"):
        transfer.imported(export, there | {"platforms": table(spark, "platform_id int, name string", (1, "Other"))})
    with pytest.raises(ValueError, match="p/i/1"):
        transfer.imported(export, there | {"images": table(spark, "image_id int, file_path string", (1, "P/I/1"))})
