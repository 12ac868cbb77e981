from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from findling.functions import dating, jsontext, markup, names, scoring, similarity, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [("1898", 1898, 1898), ("um 1910", 1905, 1915), ("ca. 1850", 1845, 1855), ("dat. 1645", 1645, 1645), ("1911-1912", 1911, 1912), ("1950-55", 1950, 1955), ("1898–02", 1898, 1902), ("17. Jh.", 1600, 1700), ("19th century", 1800, 1900), ("XX 18e siècle", None, None), ("18e siècle", 1700, 1800), ("1850 (?)", 1850, 1850), ("1850 (ca.)", 1845, 1855), ("[18]98", 1898, 1898), ("(18)98", 1898, 1898), ("nach 1880", None, None), ("1920er Jahre", None, None), ("", None, None), (None, None, None)],
)
def test_parse_dating(spark, text, start, end):
    got = one(spark, dating.parse_dating(F.lit(text).cast("string")))
    assert (got["start"], got["end"], got["matched"]) == (start, end, start is not None)


def test_two_digit_years(spark):
    short = dating.parse_dating(F.lit("42"))
    assert one(spark, dating.expand_two_digits(short, F.lit(1850)))["start"] == 1942
    assert tuple(one(spark, dating.expand_two_digits(short, F.lit(None).cast("int")))) == (None, None, True)
    assert one(spark, dating.expand_two_digits(dating.parse_dating(F.lit("1942")), F.lit(1850)))["start"] == 1942


def mention(kind, n1=None, n2=None, a=None, b=None, hedge=False, ts=False, te=False):
    return F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in (("kind", kind, "string"), ("n1", n1, "int"), ("n2", n2, "int"), ("subdivision", a, "string"), ("subdivision2", b, "string"), ("hedge", hedge, "boolean"), ("truncate_start", ts, "boolean"), ("truncate_end", te, "boolean"))))


@pytest.mark.parametrize(
    ("m", "want"),
    [(("year", 1850), (1850, 1850)), (("year", 1850, None, None, None, True), (1845, 1855)), (("year", 50), (None, None)), (("century", 19), (1800, 1900)), (("century", 21), (2000, 2026)), (("century", 19, None, "late"), (1875, 1900)), (("century", 1920, None, "mid"), (1923, 1927)), (("century_span", 18, 19, "q2", "first_half"), (1725, 1850)), (("decade", 1920), (1920, 1930)), (("range", 1900, 1890), (None, None)), (("range", 1900, 1910, None, None, True), (1895, 1915)), (("open_after", 1880), (1880, None)), (("open_before", 1880), (None, 1880)), (("fragment", 42), (1942, 1942)), (("year", 1850, None, None, None, False, True), (None, 1850)), (("none",), (None, None))],
)
def test_mentions(spark, m, want):
    assert tuple(one(spark, dating.resolve_mention(mention(*m), F.lit(1850)))) == want


def test_union_of_intervals(spark):
    got = dating.resolve_dating(F.array(mention("year", 1850), mention("open_after", 1900), mention("none")), F.lit(None).cast("int"))
    assert tuple(one(spark, got)) == (1850, None)
    assert tuple(one(spark, dating.resolve_dating(F.array(mention("none")), F.lit(None).cast("int")))) == (None, None)


def test_title_similarity(spark):
    s = lambda a, b: one(spark, similarity.title_similarity(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert s(" Stillleben ", "stillleben") == 1
    assert s(None, "x") is None and s(" ", "x") is None
    assert s("Porträt Anna", "Porträt Anne") == pytest.approx(0.75)
    assert s("Porträt", "Porträt x") == pytest.approx(7 / 9)
    assert s("Porträt Anna", "Anna") == pytest.approx(1 - 8 / 12)


def test_artist_similarity():
    f = similarity.jaro_winkler_pair
    assert f("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert f("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert f("a", "b") == 0 and f("x", "x") == 1


def test_interval_and_size_similarity(spark):
    d = lambda *v: one(spark, similarity.dating_similarity(*(F.lit(x).cast("int") for x in v)))
    assert [d(1821, 1821, 1821, 1821), d(1821, 1821, 1921, 1921), d(None, None, 1821, 1821), d(1800, None, 1990, 2000), d(1800, None, 2001, 2005)] == [1, 0, None, 1, 0]
    z = lambda *v: one(spark, similarity.dimensions_similarity(*(F.lit(x).cast("double") for x in v)))
    assert [z(40, 50, 40, 50), z(40, 50, 50, 40), z(40, None, 40, 50), z(0, 50, 0, 50), z(100, 1, 90, 2)] == [1, 0, None, 0.5, 0.5]


def test_fusion(spark):
    null = F.lit(None).cast("double")
    parts = {k: null for k in scoring.WEIGHTS} | {"title": F.lit(1.0), "artist": F.lit(0.5)}
    assert one(spark, scoring.fused(parts)) == pytest.approx((0.35 + 0.125) / 0.6)
    assert one(spark, scoring.trusted(parts)) == pytest.approx(0.35 + 0.125)
    assert one(spark, scoring.fused({k: null for k in scoring.WEIGHTS})) == 0


@pytest.mark.parametrize(("text", "cm"), [("16 in.", 40.64), ("16", None), ("120 mm", 12.0), ("53,5 cm", 53.5), ("5 ft 3 in", 160.02), ("2 ft", 60.96), ("3 ells", None), (None, None)])
def test_centimetres(spark, text, cm):
    assert one(spark, values.centimetres(F.lit(text).cast("string"))) == cm


def test_values(spark):
    v = lambda f, x, *a: one(spark, f(F.lit(x).cast("string"), *a))
    assert v(values.money, "USD 1,250.50 - 2,000") == 1250.5 and v(values.money, "USD 1,250.50 - 2,000", 2) == 2000
    assert [v(values.decimal, x) for x in ("1.234,5", "1,234.5", "12,5", "12.5", "")] == [1234.5, 1234.5, 12.5, 12.5, None]
    assert [v(values.lot_number, x) for x in ("Los 12a", "Lot #7", "no digits", "Lot 5 painting")] == ["12a", "7", None, None]
    assert [v(values.boolean, x) for x in ("Ja", "0", "?")] == [True, False, None]
    assert v(values.tokens, "Öl auf Leinwand, Holz und Öl") == ["öl", "leinwand", "holz"]
    assert v(values.names_of, '{"Klee, Paul",Jan Matejko}') == ["Klee, Paul", "Jan Matejko"]
    assert v(values.names_of, "a; b | c") == ["a", "b | c"] and v(values.names_of, "Klee, Paul") == ["Klee, Paul"]
    assert v(values.slug_title, "https://x.y/lots/12-old-master%20work?z=1") == "Old Master Work"
    assert tuple(v(values.height_by_width, "53,5 x 76 cm")) == (53.5, 76.0, None)
    assert str(v(values.any_date, "3 May 2021")) == "2021-05-03" and str(v(values.any_date, "05.04.2020")) == "2020-04-05"
    assert one(spark, values.byte_size(F.lit(1536).cast("long"))) == "1.5 KB" and one(spark, values.grouped(F.lit(1234567))) == "1.234.567"
    assert one(spark, values.estimate(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Estimate on request")))["low"] is None


def test_presentation(spark):
    assert one(spark, scoring.percent(F.lit(0.1234))) == "12,34%" and one(spark, scoring.percent(F.lit(None).cast("double"))) == "--"
    assert one(spark, scoring.bar_width(F.lit(1.7))) == "100.00" and one(spark, scoring.bar_segment(F.lit(0.5), 0.6)) == "30.00"


@pytest.mark.parametrize(
    ("raw", "name", "dob", "dod"),
    [("BAISCH, Hermann (1846–1894)", "Hermann Baisch", "1846", "1894"), ("unbekannt", None, None, None), ("Prof. Max Liebermann", "Max Liebermann", None, None), ("nach Peter Paul Rubens", "nach Peter Paul Rubens", None, None), ("VAN GOGH, VINCENT", "Vincent van Gogh", None, None), ("mcdonald", "McDonald", None, None), ('{"name": "Alexandre Noll"}', "Alexandre Noll", None, None), ("Lucas Cranach d. Ä.", "Lucas Cranach d.Ä.", None, None), ("Jan Steen, Dutch", "Jan Steen", None, None)],
)
def test_artist_names(raw, name, dob, dod):
    got = names.normal_name(raw)
    assert got["matched"] and (got["name"], got["dob"], got["dod"]) == (name, dob, dod)


def test_artist_names_not_matched():
    assert not names.normal_name("Müller und Meier")["matched"] and not names.normal_name("")["matched"] and not names.normal_name(None)["matched"]
    assert names.life("1847 Berlin - 1935 ebenda") == {"dob": "1847", "pob": "Berlin", "dod": "1935", "pod": "Berlin"}


def test_json_and_markup():
    assert jsontext.array_of("```json\n[{'a': None,},]\n```") == [{"a": None}]
    assert jsontext.array_of('x {"a": 1} y {"b": 2}') == [{"a": 1}, {"b": 2}] and jsontext.array_of("none") is None
    assert jsontext.best_object('{"w": 1} {"w": 2, "h": 3} {"w": null, "h": null}', ("w", "h")) == {"w": 2, "h": 3}
    assert jsontext.last_complete('{"a": 1} ```', frozenset("a")) == {"a": 1} and jsontext.last_complete('{"a": 1} tail', frozenset("a")) is None
    assert jsontext.balanced('x = {"a": "}", b: [1]};', 4) == '{"a": "}", b: [1]}'
    assert markup.pairs_of("<table><tr><th>Size:</th><td>3 <b>x</b> 4</td></tr></table><dl><dt>Type</dt><dd>Oil</dd></dl>") == [("Size", "3 x 4"), ("Type", "Oil")]


def test_paths_lists_and_payloads(spark):
    path = lambda p: one(spark, values.canonical_path(F.lit(p).cast("string"), "/store/img", "img"))
    assert [path(p) for p in ("img", "img/a", "imgs/a", "/store/img/a", "/store/imgs/a", " ./b ", None)] == ["img", "img/a", "img/imgs/a", "img/a", "/store/imgs/a", "img/b", None]
    assert one(spark, values.flattened(F.lit(None).cast("array<string>"))) == "" == one(spark, values.flattened(F.array(F.lit("\n "))))
    assert one(spark, values.payload({"a": F.lit(" "), "b": F.lit(0)}, ("b",))) == "{}"
    assert one(spark, values.payload({"a": F.lit("0"), "b": F.lit(0)})) == '{"a":"0","b":0}'


def test_best_rendition_takes_the_first_of_ties(spark):
    kind = "array<struct<url:string,size:string,width:int,height:int>>"
    best = lambda rows: spark.createDataFrame([(rows,)], f"r {kind}").select(values.best_rendition(F.col("r")).alias("x")).first()["x"]
    assert best([("z", "LARGE", 1, 2), ("a", "large", 2, 1), ("b", None, 90, 90)]) == "z"
    assert best([("", "large", 1, 1), ("a", "small", 1, 1)]) is None and best([]) is None and best(None) is None
