"""The log of changes and paged feeds as data sources."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import changelog as L
from lodestar.streaming import changes as ST
from lodestar.streaming import deltas as D


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    L.register(spark)


def send(spark, path, rows, key=None):
    out = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").repartition(2).write.format("changelog").option("path", path).mode("append")
    (out.option("key", key) if key else out).save()


def test_a_log_is_read_in_order_and_a_key_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert spark.read.format("changelog").option("path", path).load().count() == 0
    send(spark, path, [{"k": i} for i in range(10)], "a")
    send(spark, path, [{"k": i} for i in range(10)], "a")
    send(spark, path, [{"k": i} for i in range(10, 15)])
    rows = spark.read.format("changelog").option("path", path).load().collect()
    assert sorted(r.seq for r in rows) == list(range(15)) and sorted(json.loads(r.value)["k"] for r in rows) == list(range(15))
    assert {json.loads(r.value)["k"] < 10 for r in rows if r.seq < 10} == {True}
    assert len(list((tmp_path / "log" / "data").iterdir())) == sum(len(json.loads(p.read_text())["files"]) for p in (tmp_path / "log" / "commits").iterdir())


def test_files_without_a_commit_are_no_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    send(spark, path, [{"k": 1}])
    (tmp_path / "log" / "data" / "lost.jsonl").write_text('"a task that died"')
    L._write(path, [{"value": "another"}])
    assert spark.read.format("changelog").option("path", path).load().count() == 1


def test_a_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    """From log to log through a query that is stopped, started anew, and has its last batch run once more."""
    first, second, point = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        rows = spark.readStream.format("changelog").option("path", first).load().select("value")
        rows.writeStream.format("changelog").option("path", second).option("producer", "copy").option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()

    want = 0
    for k in range(3):
        send(spark, first, [{"n": want + i} for i in range(20 + k)])
        want += 20 + k
        run()
        if k == 1:  # as if the query had died after its commit to the log and before that of its checkpoint
            last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            crc = last.with_name(f".{last.name}.crc")
            if crc.exists():
                crc.unlink()
    run()  # the run before was spent on the batch that was run again
    got = sorted(json.loads(r.value)["n"] for r in spark.read.format("changelog").option("path", second).load().collect())
    assert got == list(range(want))


def test_catalogue_from_a_log(spark, tmp_path):
    path, table = str(tmp_path / "log"), str(tmp_path / "t")
    for own in ([{"_id": "a", "name": "x", "price": 5}, {"_id": "b", "price": 1}, {"name": "no id"}], [{"_id": "a", "price": 4}, {"_id": "b", "_action": "delete"}, {"_id": "c", "price": 2}]):
        send(spark, path, own)
        ST.merge_stream(ST.log_changes(spark, path), table, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    assert {r["_id"]: (r["name"], r["price"]) for r in D.read_table(spark, table).collect()} == {"a": ("x", 4.0), "c": (None, 2.0)}


def test_pages_of_feeds(spark, tmp_path):
    for feed, page, content in (("all", 1, json.dumps({"products": [{"id": 1}, {"id": 2}, "odd"]})), ("all", 2, json.dumps({"products": []})), ("new", 1, "not json"), ("new", 2, "[1]")):
        (tmp_path / feed).mkdir(exist_ok=True)
        (tmp_path / feed / f"page-{page}.json").write_text(content)
    pages = spark.read.format("feedpages").option("path", str(tmp_path)).load()
    assert pages.rdd.getNumPartitions() == 4
    assert sorted((r.feed, r.page, r.n, r.id or "") for r in pages.collect()) == [("all", 1, 2, "1"), ("all", 1, 2, "2"), ("all", 2, 0, ""), ("new", 1, 0, ""), ("new", 2, 0, "")]
    assert pages.where(F.col("id").isNotNull()).select(F.get_json_object("product", "$.id").alias("x")).count() == 2
