"""Streams of catalogue changes: merging upserts and deletes, price changes by state, alerts that fire once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.schemas import CHANGE
from lodestar.streaming.deltas import merge_batch, read_table


def kafka_changes(spark: SparkSession, servers: str, topic: str = "product-updates") -> DataFrame:
    """The topic from its start, as parsed changes with their offset for order."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parsed(raw.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("seq")))


def parsed(messages: DataFrame) -> DataFrame:
    """messages(value, seq) as changes; without a JSON object or an _id they are left out, without an action they are upserts."""
    rows = messages.select(F.from_json("value", CHANGE).alias("c"), "seq").select("c.*", F.col("seq").alias("at")).drop("seq")
    return rows.where("_id is not null and _id <> ''").withColumn("_action", F.coalesce("_action", F.lit("upsert"))).where("_action in ('upsert', 'delete')")


def merge_stream(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, rebuild: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the catalogue at path (see deltas) up to date with a stream of changes: a batch writes its own net changes, not the catalogue.

    A batch that is run again writes the same delta. `rebuild` gets the table as of the batch, only if the batch had changes.
    """
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        if merge_batch(spark, batch, path, number) and rebuild:
            rebuild(current(spark, path))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as of the newest batch."""
    return read_table(spark, path)


STATE = "price double, mrp double, in_stock boolean"


class _Prices(StatefulProcessor):
    """The last observation of each id, forgotten once its timer, set to `forget` after it in event time, has run out."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{STATE}, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).sort_values("at", kind="stable").reset_index(drop=True)
        now = pd.DataFrame({"price": seen["price"].astype(float), "mrp": seen["mrp"].fillna(seen["price"]).astype(float), "in_stock": seen["in_stock"].astype(bool)})
        before = now.shift()
        until = -1
        if self.last.exists():
            price, mrp, stock, until = self.last.get()
            before.loc[0] = (price, mrp, stock)
        # what is left out equals the row before it, so each row is held against that one
        known = before["price"].notna()
        new = ~known | (now["price"] != before["price"]) | (now["mrp"] != before["mrp"]) | (now["in_stock"] != before["in_stock"].astype("boolean").fillna(False).astype(bool))
        last = now.iloc[-1]
        then = int(seen["at"].max().timestamp() * 1000) + self.forget_ms
        if then > until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(then)
        self.last.update((float(last["price"]), float(last["mrp"]), bool(last["in_stock"]), max(then, until)))
        out = now.assign(id=key[0], at=seen["at"], price_changed=known & (now["price"] != before["price"]))
        yield out.loc[new, ["id", "at", "price", "mrp", "in_stock", "price_changed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def price_change_stream(observed: DataFrame, late: str = "1 day", forget: timedelta = timedelta(days=90)) -> DataFrame:
    """Observations (id, at, price, mrp, in_stock) of a stream that differ from the last of their id, with price_changed.

    The state of an id is its last observation; a batch's rows are sorted by time first, as they arrive in any order. An id
    that isn't observed for `forget` of event time leaves the state, so that this follows the ids in use; if it comes back
    it counts as new. `late` is the watermark's delay.
    """
    rows = observed.select("id", "at", "price", "mrp", "in_stock").withWatermark("at", late)
    schema = "id string, at timestamp, price double, mrp double, in_stock boolean, price_changed boolean"
    return rows.groupBy("id").transformWithStateInPandas(_Prices(int(forget.total_seconds() * 1000)), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def fire_once(due: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Each alert of a stream due(alert_id, at) once, for as long as the watermark remembers it."""
    return due.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["alert_id"])


def limited(requests: DataFrame, key: str, width: str = "1 minute", most: int = 60, late: str = "10 seconds") -> DataFrame:
    """Windows of a stream of requests(ts) in which a key asked more than `most` times."""
    from lodestar.streaming.windows import rate_limited

    return rate_limited(requests.withWatermark("ts", late), key, width, most)


def unseen(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet: what a job that was stopped goes on with."""
    return new.join(done.select(key).distinct(), key, "left_anti")


def log_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change log (sources.changelog) from its start, as parsed changes in order of their offset."""
    from lodestar.sources import changelog

    changelog.register(spark)
    return parsed(spark.readStream.format("changelog").option("path", path).load())
