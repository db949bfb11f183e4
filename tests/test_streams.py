"""Catalogues that merge on read, and state that expires."""

import json
import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import changes as ST
from lodestar.streaming import deltas as D

CHANGES = "_id string, _action string, at long, name string, category string, brand string, price double, mrp double, in_stock boolean"


def plain(table, batch):
    """{id: {field: value}} after changes in order of `at`."""
    for c in sorted(batch, key=lambda c: c["at"]):
        if c["_action"] == "delete":
            table.pop(c["_id"], None)
        else:
            table.setdefault(c["_id"], {}).update({k: c[k] for k in D.FIELDS if c.get(k) is not None})
    return table


def batches(seed=1, n=4, size=60):
    r, at = random.Random(seed), 0
    for _ in range(n):
        own = []
        for _ in range(size):
            at += 1
            own.append({"_id": f"p{r.randrange(90)}", "_action": "delete" if r.random() < 0.2 else "upsert", "at": at, "name": r.choice([None, "x", "y"]), "price": r.choice([None, float(r.randrange(9))]), "in_stock": r.choice([None, True, False])})
        yield own


def rows_of(spark, path):
    return {r["_id"]: {f: r[f] for f in D.FIELDS if r[f] is not None} for r in D.read_table(spark, path).collect()}


def frame(spark, own):
    return spark.createDataFrame([tuple(c.get(k.split(" ")[0]) for k in CHANGES.split(", ")) for c in own], CHANGES)


@pytest.mark.parametrize("share", [0.0, 1e9])
def test_merge_on_read_is_the_merge(spark, tmp_path, share):
    """Compacting always, sometimes and never; a batch run twice changes nothing."""
    path, want, compacted = str(tmp_path / "t"), {}, 0
    D.write_table(frame(spark, [{"_id": f"p{i}", "_action": "upsert", "at": 0, "name": "base", "price": 1.0} for i in range(60)]).select("_id", *D.FIELDS), path)
    want = {f"p{i}": {"name": "base", "price": 1.0} for i in range(60)}
    for number, own in enumerate(batches()):
        want = plain(want, own)
        D.write_delta(frame(spark, own), path, number)
        assert rows_of(spark, path) == want
        if number % 2:
            compacted += len(D.compact(spark, path, share))
            assert rows_of(spark, path) == want
            D.write_delta(frame(spark, own), path, number)
            assert rows_of(spark, path) == want
    gone = D.drop_taken(spark, path)
    assert rows_of(spark, path) == want and compacted >= (share == 0) * D.BUCKETS // 2 and (share > 0 or {f"delta={k}" for k in range(4)} <= set(gone))


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """Few changes of a large catalogue: a small delta, and compaction of their buckets only once they are many."""
    path = tmp_path / "t"
    D.write_table(spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("name"), *[F.lit(None).cast(t).alias(f) for f, t in D.FIELDS.items() if f != "name"]), str(path))
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    whole = size(path)
    D.merge_batch(spark, frame(spark, [{"_id": f"p{i}", "_action": "upsert", "at": i, "price": 5.0} for i in range(20)]), str(path), 0)
    assert size(path) - whole < whole / 50 and not (path / "base=0").exists()
    one = 0
    bucket = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("_id")).where(F.pmod(F.xxhash64("_id"), F.lit(D.BUCKETS)) == one).limit(500).collect()
    D.merge_batch(spark, frame(spark, [{"_id": r["_id"], "_action": "delete", "at": 1} for r in bucket]), str(path), 1)
    assert [p.name for p in (path / "base=1").iterdir() if p.is_dir()] == [f"_bucket={one}"] and D.read_table(spark, str(path)).count() == 19_500


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    """Two runs of a stream from one checkpoint, with compaction between, give what one merge gives."""
    source, path, want = tmp_path / "in", str(tmp_path / "t"), {}
    source.mkdir()
    for run in range(2):
        for k, own in enumerate(batches(seed=run + 5, n=2, size=40)):
            own = [c | {"seq": c["at"] + 1000 * (run * 10 + k)} for c in own]
            want = plain(want, [c | {"at": c["seq"]} for c in own])
            (source / f"{run}-{k}.json").write_text("\n".join(json.dumps({x: y for x, y in c.items() if x not in ("at",)}) for c in own))
            os.utime(source / f"{run}-{k}.json", (1_700_000_000 + 2 * run + k, 1_700_000_000 + 2 * run + k))
        raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        changes = ST.parsed(raw.select("value", F.get_json_object("value", "$.seq").cast("long").alias("seq")))
        ST.merge_stream(changes, path, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
        assert rows_of(spark, path) == want
        D.compact(spark, path, 0)
        assert rows_of(spark, path) == want


def test_state_of_ids_that_are_gone_expires(spark, tmp_path):
    """The number of ids in the state falls once event time has passed their timers; an id that comes back is new."""
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i, day, price: json.dumps({"id": i, "at": f"2024-{1 + day // 28:02d}-{1 + day % 28:02d}T00:00:00Z", "price": price, "in_stock": True})
    for k, own in enumerate([[line(f"i{j}", 0, 5.0) for j in range(20)], [line("i0", 1, 5.0), line("i1", 1, 6.0)], [line("late", 40, 1.0)], [line("late", 41, 1.0)], [line("i0", 42, 5.0)], [line("late", 43, 1.0)]]):
        (source / f"{k}.json").write_text("\n".join(own))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # a stream of files goes by their times
    stream = spark.readStream.schema("id string, at timestamp, price double, mrp double, in_stock boolean").option("maxFilesPerTrigger", 1).json(str(source))
    found = ST.price_change_stream(stream, late="1 hour", forget=timedelta(days=10))
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    kept = [int(p["stateOperators"][0]["numRowsTotal"]) for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"]]
    assert max(kept) >= 20 and kept[-1] <= 8
    rows = sorted((r.id, r.at.month, r.at.day, r.price_changed) for r in spark.read.parquet(str(tmp_path / "out")).where("id in ('i0', 'i1', 'late')").collect())
    assert rows == [("i0", 1, 1, False), ("i0", 2, 15, False), ("i1", 1, 1, False), ("i1", 1, 2, True), ("late", 2, 13, False)]
