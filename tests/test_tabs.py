"""Segments of tabs, and what is told apart in them."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from findling.functions import tabs


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a class="item" data-tab="d">Details</a><div class="ui tab segment" data-tab="d"><p>One<p>Two</div>', ["One", "Two"]),
        ('<div data-tab="d">short</div><div data-tab="d">a much longer one</div>', ["a much longer one"]),
        ('<div data-tab="d">same</div><div data-tab="d">also</div>', ["same"]),
        ('<div data-tab="d">plain but long, ' + "x" * 120 + '</div><div data-tab="d"><b>y</b></div>', ["y"]),
        ('<div class="TAB" data-tab="d">x<script>no</script></div><div class="menu item segment" data-tab="d">y</div>', ["x"]),
        ('<div class="segment" data-tab="e">no</div><img data-tab="d">', []), ("", []), ('<div data-tab="d">a\n b </div></p>c', ["a", "b"]), ('<li data-tab="d"><div data-tab="d">in</div>out', ["in"]),
    ],
)
def test_the_segment_is_told_from_buttons(html, want):
    assert tabs.lines_of(html, "d") == want


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["A", "Provenienz:", "X", "B"], ("A\nB", "X")), (["provenance: X", "PROVENANCE Y", "Provenienza", "x"], ("", "X\nY")), (["Provenance", "Provenance", "A"], ("A", "Provenance")), (["A", "Provenance:"], ("A", None)), (["The provenance: X"], ("The provenance: X", None)), ([], ("", None)),
    ],
)
def test_lines_are_told_apart(lines, want):
    assert tabs.told_apart(lines) == want


def test_nested_and_long_pages_are_read_in_linear_time():
    begun = time.perf_counter()
    assert len(tabs.lines_of('<div data-tab="d">' * 20_000 + "<p>x " * 100_000, "d")) == 100_000
    assert time.perf_counter() - begun < 10


def test_null_and_empty_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, '<div data-tab="d">a<br>Provenance: b</div>')], "i int, html string")
    got = rows.select("i", tabs.tab_segment("d")(F.col("html")).alias("t")).select("i", "t.*").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "", None), (2, "", None), (3, "a", "b")]
