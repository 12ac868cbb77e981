from __future__ import annotations

import json

from findling.sources import readers, writers
from findling.streaming import micro


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("name;parent\nroot; \noil;root\n")
    assert {tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.csv")).collect()} == {("root", None), ("oil", "root")}
    (tmp_path / "r.jsonl").write_text('{"id": 1, "t": "x"}\n\nbroken\n{"id": 2}\n')
    assert {tuple(r) for r in readers.records(spark, str(tmp_path / "r.jsonl"), "id int, t string").collect()} == {(1, "x"), (2, None)}
    (tmp_path / "i.csv").write_text("file_id,file_path,role,content_version,content_sha256\n1,a,lost,1,\n1,b,auction,0,\n2,c,other,1,zz\n")
    assert {tuple(r) for r in readers.image_inputs(spark, str(tmp_path / "i.csv"))[1].collect()} == {("1", "version"), ("1", "repeated"), ("2", "role")}


def test_pages_round_trip(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "repeat('x', 50) as t")
    writers.write_pages(rows, ["id"], str(tmp_path / "p"), 1000)
    back = spark.read.text(str(tmp_path / "p"))
    assert back.count() == 100 and back.select("page").distinct().count() > 4 and json.loads(back.first()["value"])["t"] == "x" * 50


def test_stages_skip_and_continue(spark):
    seen = []

    def fail(batch, number):
        raise ValueError

    run = micro.staged([("block", fail, ()), ("verify", lambda b, n: seen.append("verify"), ("block",)), ("match", lambda b, n: seen.append("match"), ())])
    assert run(None, 0) == {"block": "failed", "verify": "skipped", "match": "done"} and seen == ["match"]


def test_queue_is_read_once(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "auction_id").repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        works = micro.queue(spark, str(tmp_path / "in"), "auction_id long", 1)
        micro.start(works, [("count", lambda b, n: seen.append(b.count()), ())], str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 10 and len(seen) == 3


def test_stream_counts_equal_table_counts(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 17) as ts, id % 2 as kind from range(30)")
    events.write.parquet(str(tmp_path / "e"))
    stream = micro.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in micro.tumbling(events, "ts", "kind").collect()}
