"""What is read off records, names, contacts and stored images, and how answers are written back."""

from __future__ import annotations

import datetime
import json
import struct
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from findling.functions import dating, identifiers, imagebytes, lifedates, names, records
from findling.operators import extraction
from findling.plans import evidence
from findling.streaming import micro


def values_of(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


# The forms and values that the linkage data's fixtures name


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1847 Berlin - 1935 Berlin", ("1847", "1935", "Berlin", "Berlin")), ("1858 Tapiau - 1925 Zandvoort", ("1858", "1925", "Tapiau", "Zandvoort")), ("1858-1925", ("1858", "1925", None, None)), ("1847-", ("1847", None, None, None)), ("Stockholm 1659 - London 1743", ("1659", "1743", "Stockholm", "London")),
        ("1847 Berlin - 1935", ("1847", "1935", "Berlin", None)), ("1847 Berlin", ("1847", None, "Berlin", None)), ("1530/31", ("1530/31", None, None, None)), ("fl. 1600-1620", (None,) * 4), ("Wien, 1900-1950?", ("1900", "1950", "Wien", None)), ("Wien 1900-", ("1900", None, "Wien", None)), ("1900-1950, Paris", ("1900", "1950", None, "Paris")),
        ("1530/31-1590", ("1530/31", "1590", None, None)), ("1530-1590/91", ("1530", "1590/91", None, None)), ("1950 - 8. Dezember 2023", ("1950", "2023", None, None)), ("1924-2022, Würzburger Künstler", ("1924", "2022", None, None)), ("American, b. 1960", ("1960", None, None, None)), ("née en 1890", ("1890", None, None, None)),
        ("German 1600-1650", ("1600", "1650", None, None)), ("Italian, 19th Century", (None,) * 4), ("?", (None,) * 4), ("1900, attributed to", ("1900", None, None, None)), ("ca. 1600 - um 1650", ("1600", "1650", None, None)), ("early 1600 to 1650", ("1600", "1650", None, None)), ("born 1900 died 1950", ("1900", "1950", None, None)),
    ],
)
def test_lives(text, want):
    found = lifedates.life(text)
    assert found is not None and tuple(found.get(f) for f in lifedates.FIELDS) == want


@pytest.mark.parametrize("text", ["died 1920", "Wien um 12 x", "1847 Berlin - ?", "12345"])
def test_lives_not_understood(text):
    assert lifedates.life(text) is None


@pytest.mark.parametrize(
    ("name", "other", "want"),
    [("O. K.", "Oskar Kurz", "Oskar Kurz"), ("Kurz", "Oskar K.", "Oskar Kurz"), ("K.", "Oskar Kurz", "Oskar Kurz"), ("A. B. Kurz", "Anton", "Anton B. Kurz"), ("O. Kurz", "Oskar Maria Kurz", "Oskar Maria Kurz"), ("Meier", "Otto Kurz", None), ("O. Meier", "Anton Zorn", None), ("Hans", "Hans-Peter", "Hans-Peter"), ("", "Otto", None)],
)
def test_presumed_names_fill_initials(name, other, want):
    assert lifedates.fused(name, other) == want


def test_names_with_lives():
    got = names.normal_name("KURZ, O. (wohl Oskar Kurz 1925 Erlangen-2004 Fürth)")
    assert (got["name"], got["dob"], got["dod"], got["pob"], got["pod"]) == ("Oskar Kurz", "1925", "2004", "Erlangen", "Fürth")
    got = names.normal_name("Max Ernst, *1891 Brühl †1976 Paris")
    assert (got["name"], got["dob"], got["pob"], got["dod"], got["pod"]) == ("Max Ernst", "1891", "Brühl", "1976", "Paris")
    assert lifedates.inline("Maier, Max, 1900-1950", {"dob": "1899"}) == ("Maier, Max", {"dob": "1899", "dod": "1950"})


def test_datings_that_look_alike(spark):
    got = values_of(spark, dating.parse_dating, ["12. Jh.", "12th c.", "12e siècles", "12 s.", "c. 1500", "ca.1500", "1500–1501", "1999-03", "dat.1645", "(18)50", "18 50", "1500 (c.)", "3. Jahrhundert", "15000", "", None, "x" * 1000])
    assert [(g["start"], g["end"]) if g["matched"] else None for g in got] == [(1100, 1200)] * 4 + [(1495, 1505), None, (1500, 1501), (1999, 2003), (1645, 1645), (1850, 1850), None, (1495, 1505), (200, 300), None, None, None, None]


# Records


@pytest.mark.parametrize("key", records.ARTIST_KEYS)
def test_every_artist_key_and_shape(spark, key):
    shapes = [" A ", {"name": "A"}, {"displayName": "A"}, {"name": "", "displayName": "A"}, ["A", "B"], [{"name": "A"}], {"name": " ", "displayName": "A"}, {"name": 5, "displayName": "A"}, [], 7, None, "", [[]]]
    got = values_of(spark, lambda t: records.artist_name(records.parsed(t)), [json.dumps({"maker_of": "x", key: s}) for s in shapes] + ["{", None, "[]"])
    assert got == ["A"] * 6 + [None] * 10


def test_lots_of_odd_shapes(spark):
    origin = "https://x.org"
    texts = ['{"data":{"lot":{}}}', '{"data":{"lot":[]}}', '{"data":7}', "[]", "7", '"x"', "", None, '{"data":{"lot":{"lotId":"&lt;b&gt; a","auction":{"departmentNames":[" "],"dates":{"acceptsBids":"2020-01-02T00:00:00Z","goesLive":""}},"estimateV2":{"lowEstimate":{"amount":"n/a"}}}}}']
    got = values_of(spark, lambda t: records.lot(records.parsed(t), origin), texts)
    assert got[0] is not None and not any(got[0]) and got[1:8] == [None] * 7
    assert got[8]["lot_id"] == "a" and got[8]["departments"] is None and got[8]["auction_date"] == datetime.date(2020, 1, 2) and got[8]["estimate_low"] is None and got[8]["url"] is None


def test_contacts(spark):
    texts = ["Max;max@x.de; other@y.de ;Tel;030 1;homepage:;x.de", "Tel", "E-Mail; a@b; c@d", "", None, ";;\n", "http://a.b; https://c.d; Main Road 1\nD 12345 X"]
    got = [tuple(r) if r else None for r in values_of(spark, records.contact, texts)]
    assert got == [("Max; other@y.de", None, "030 1", "max@x.de", "x.de"), ("Tel",) + (None,) * 4, ("c@d", None, None, "a@b", None), (None,) * 5, None, (None,) * 5, (None, "Main Road 1; D 12345 X", None, None, "https://c.d")]


def test_ids_are_pythons(spark):
    texts = ["", "a", "ünï 日本", "x" * 1000, *(f"n{i}" for i in range(300))]
    assert values_of(spark, identifiers.uuid5, texts) == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]
    assert values_of(spark, lambda t: identifiers.program_id("p", t, F.lit("1")), ["m", None]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "p:matching_program:m:1")), None]


# Stored images


def test_images_cut_anywhere_have_a_fault():
    for made, kind in ((evidence._png(9, 4), "png"), (evidence._jpeg(9, 4), "jpeg")):
        assert imagebytes.looked_at(made) == (kind, 9, 4, None)
        for n in range(len(made)):
            assert imagebytes.looked_at(made[:n])[3] is not None
    png = evidence._png(9, 4)
    for i in range(8, len(png)):
        assert imagebytes.looked_at(png[:i] + bytes([png[i] ^ 4]) + png[i + 1 :])[3] is not None


def test_images_with_false_headers():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = lambda *h: imagebytes.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", *h))
    end = chunk(b"IEND", b"")
    assert imagebytes.looked_at(head(0, 1, 8, 0, 0, 0, 0) + end)[3] == "header out of range"
    assert imagebytes.looked_at(head(2, 2, 8, 0, 0, 0, 0) + chunk(b"IDAT", zlib.compress(b"\0ab")) + end)[3] == "rows missing"
    assert imagebytes.looked_at(head(2, 2, 8, 0, 0, 0, 0) + chunk(b"IDAT", b"no") + end)[3] == "data do not unpack"
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x01\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x01\x44\x00" + b"\x3b"
    assert imagebytes.looked_at(gif) == ("gif", 3, 2, None) and imagebytes.looked_at(gif[:-1])[3] == "cut short"
    assert imagebytes.looked_at(None)[3] == "empty" and imagebytes.looked_at(b"BM")[3] == "unknown format"


# Answers


def test_realignment_of_repeated_texts(spark):
    asked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (2, "a", 5)], "g int, t string, id int")
    answers = spark.createDataFrame([(1, " a ", 10), (1, "c", 11), (1, "", 12), (2, "a", 13), (2, "a", 14)], "g int, t string, pos int")
    got = {(r["id"], r["pos"], r["state"]) for r in extraction.realigned(asked, answers, "g", "t", "id", "pos").collect()}
    assert got == {(1, 10, "matched"), (2, None, "unanswered"), (3, None, "unanswered"), (4, 12, "matched"), (5, 13, "matched"), (None, 11, "unasked"), (None, 14, "unasked")}


def test_batches_are_written_back_once(spark, tmp_path):
    at, seen = str(tmp_path / "works"), []
    spark.createDataFrame([("1", "old", None, False), ("2", None, "ink", False), ("3", "old", None, False)], "id string, title string, material string, is_processed boolean").write.parquet(at)
    fields = "id string, title string, material string, extraction_parsed boolean"
    rest = ", ".join(f"{c} string" for c in extraction.CONTENT if c not in ("title", "material"))
    rows = [("1", "new", "oil", True), ("2", " ", "oil", None), ("3", None, None, True), ("4", "x", None, False), (" ", "x", None, True)]
    batch = spark.createDataFrame([(*r, *[None] * (len(extraction.CONTENT) - 2)) for r in rows], f"{fields}, {rest}")
    write = extraction.batch_writer(at, fill=("material",), again=lambda df, n: seen.append(df.count()))
    for n in (0, 0, 1):
        write(batch, n)
        assert {tuple(r) for r in spark.read.parquet(at).collect()} == {("1", "new", "oil", True), ("2", None, "ink", True), ("3", "old", None, True)}
    assert seen == [2, 2, 2]


def test_late_metadata_on_a_stream(spark, tmp_path):
    """Metadata in time joins; missing or too late metadata lets the image go alone once the watermark has passed."""
    images, metadata = str(tmp_path / "i"), str(tmp_path / "m")

    def add(at, rows, kind):
        name = "image" if at == images else "meta"
        spark.createDataFrame(rows, kind).selectExpr("match_id", f"cast(t as timestamp) as {name}_at", f"s as {name}_score").coalesce(1).write.mode("append").parquet(at)

    kind = "match_id int, t string, s double"
    add(images, [(1, "2024-01-01 00:00:00", 0.1), (2, "2024-01-01 00:00:00", 0.2), (3, "2024-01-01 00:00:00", 0.3)], kind)
    add(metadata, [(1, "2024-01-01 12:00:00", 1.0)], kind)
    read = lambda at, columns: spark.readStream.schema(columns).parquet(at)
    joined = micro.ripe(read(images, "match_id int, image_at timestamp, image_score double"), read(metadata, "match_id int, meta_at timestamp, meta_score double"))
    out = str(tmp_path / "out")

    def run():
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        return {(r["match_id"], r["meta_score"]) for r in spark.read.parquet(out).collect()}

    assert run() == {(1, 1.0)}
    add(metadata, [(2, "2024-01-05 00:00:00", 2.0)], kind)  # four days late
    add(images, [(9, "2024-01-09 00:00:00", 0.9)], kind)
    run()
    add(metadata, [(9, "2024-01-09 01:00:00", 9.0)], kind)
    add(images, [(10, "2024-01-12 00:00:00", 1.0)], kind)
    got = run()
    assert {(1, 1.0), (2, None), (3, None), (9, 9.0)} <= got and (2, 2.0) not in got


# What is shown


def test_chart_geometry(spark):
    from findling.functions import charts

    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.3, 1.0, 1.5, 7.0, 10.0, 12.0, 999.0, 1000.0, 5001.0)], "v double")
    assert [r[0] for r in rows.select(charts.nice_max(F.col("v"))).collect()] == [1, 1, 0.5, 1, 2, 10, 10, 20, 1000, 1000, 10000]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(charts.label_places(F.lit(0))) == [] and one(charts.label_places(F.lit(3))) == [0, 1, 2] and one(charts.label_places(F.lit(11))) == [0, 2, 4, 6, 8, 10]
    assert [tuple(p) for p in one(charts.line(F.array(F.lit(5)), F.lit(10.0), (0.0, 0.0, 10.0, 10.0)))] == [(5.0, 5.0)] and one(charts.line(F.array().cast("array<int>"), F.lit(1.0))) == []


def test_keypoints_out_of_range(spark):
    from findling.functions import charts

    points = F.array(F.array(F.lit(1.0), F.lit(2.0)))
    with pytest.raises(Exception, match="not there"):
        spark.range(1).select(charts.keypoint_payload(points, points, F.array(F.array(F.lit(0), F.lit(1))), F.array(F.lit(0.5)))).collect()


def test_list_defaults(spark):
    from findling.functions import charts

    rows = [("x", None, None, None), ("x", "accepted", "oldest", "true"), (None, None, None, None), (" ", "expired", None, "true"), (None, "discarded", None, None), (None, None, "newest", None), (None, "unrated", None, "false"), (None, None, None, "true")]
    got = [tuple(r["d"]) for r in spark.createDataFrame(rows, "q string, r string, s string, b string").select(charts.list_defaults(F.col("q"), F.col("r"), F.col("s"), F.col("b")).alias("d")).collect()]
    assert got == [("all", "similarity", "all", False), ("accepted", "oldest", "true", False), ("unrated", "similarity", "false", True), ("expired", "similarity", "all", False), ("discarded", "newest", None, False), (None, "newest", None, False), ("unrated", "similarity", "false", True), (None, "newest", "true", False)]


def test_preferred_rows_and_tree_changes(spark):
    from findling.operators import catalogue

    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "k int, g int")
    table = spark.createDataFrame([(2, 7), (9, 7), (5, 8), (3, 7)], "own int, g int")
    assert {(r["k"], r["own"]) for r in catalogue.preferred_row(rows, table, "k", "own", "g").collect()} == {(1, 2), (2, 2), (3, 5)}
    tree = lambda *pairs: spark.createDataFrame(list(pairs), "name string, parent string")
    new = tree(("a", None), ("b", "a"), ("c", "b"), ("d", "c"))
    got = {tuple(r) for r in catalogue.tree_changes(tree(("a", None), ("c", "a"), ("d", "c")), new).collect()}
    assert got == {("b", "a", 1, "insert"), ("c", "b", 2, "update")} and catalogue.tree_changes(new, new).collect() == []
