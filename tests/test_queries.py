"""Every registered query of the linkage engine against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.plans import queries, standins

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in standins.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, float):
        return float(f"{v:.7g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(map(flat, v))
    return v if v is None or isinstance(v, str | bool | tuple) else v.isoformat() if isinstance(v, datetime.date) else float(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == names
    ours = [tuple(flat(r[c]) for c in names) for r in df.collect()]
    at = [rel.columns.index(c) for c in names]
    theirs = [tuple(flat(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)


def rows_of(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def test_every_query_without_sql_has_a_test_of_its_values():
    assert set(queries.QUERIES) - set(queries.SQL) == {"jn1_score_pairs", "vs4_regrouped_candidates", "vs6_set_digest", "ag15_ordered_digest", "pg17_label_values", "pg1_plain_text", "x29_best_segment", "nr12_artist_names"}


def test_pairs_reach_both_thresholds(spark):
    """Their values are held against all pairs in test_operators."""
    got = rows_of(spark, "jn1_score_pairs")
    assert got and all(r["final_score"] >= 0.7 and r["confidence_score"] >= 0.5 for r in got)


def test_regrouped_candidates_are_the_nearest(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    got = {r["query_id"]: r["candidates"] for r in rows_of(spark, "vs4_regrouped_candidates")}
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        scores = unit @ unit[np.searchsorted(ids, q)]
        assert [c["rank"] for c in found] == list(range(1, len(found) + 1)) and [c["score"] for c in found] == pytest.approx(sorted(scores, reverse=True)[: len(found)])


def test_digests_know_sets_and_order(spark):
    from findling.operators import inventory, vectors

    rows = spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey", "c_name")
    other = rows.where("c_custkey > 1")
    assert vectors.set_digest(rows, "c_custkey").first() == vectors.set_digest(rows.orderBy(F.desc("c_custkey")).repartition(7), "c_custkey").first() != vectors.set_digest(other, "c_custkey").first()
    assert len(rows_of(spark, "vs6_set_digest")[0]["digest"]) == 64 and len(rows_of(spark, "ag15_ordered_digest")) == 1
    assert inventory.ordered_digest(rows, ["c_custkey"]).first() != inventory.ordered_digest(other, ["c_custkey"]).first()


def test_pages_as_plain_text(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    plain, best = ({r["page_id"]: r["text"] for r in rows_of(spark, name)} for name in ("pg1_plain_text", "x29_best_segment"))
    assert plain.keys() == best.keys() == html.keys()
    assert any(plain.values()) and all("<p" not in (t or "") and "  " not in (t or "") for t in plain.values())


def test_names_of_all_people(spark):
    got = rows_of(spark, "nr12_artist_names")
    assert len(got) == spark.read.parquet(f"{DIR}/customer.parquet").count() and len({r["artist_id"] for r in got}) == len(got)
    assert rows_of(spark, "pg17_label_values") == []  # no page of these tables has labels; fragments with labels are in test_functions
