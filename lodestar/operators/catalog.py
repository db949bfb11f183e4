"""The catalogue over time: upserts, removals, price changes and their summaries, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import ranges


def latest(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return changes.withColumn("_n", best).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """(id, site, data, first_seen, last_seen, active) after a batch(id, site, data), one row an id: seen ids are active and keep first_seen."""
    b = batch.select("id", F.col("site").alias("n_site"), F.col("data").alias("n_data"), F.lit(True).alias("seen"))
    both = stored.join(b, "id", "full")
    return both.select(
        "id", F.coalesce("n_site", "site").alias("site"), F.coalesce("n_data", "data").alias("data"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("seen"), now).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("seen", F.lit(False)) | F.coalesce("active", F.lit(False))).alias("active"),
    )


def mark_missing(stored: DataFrame, seen: DataFrame, sites_complete: DataFrame) -> DataFrame:
    """Active products of completely crawled sites that were not seen become inactive."""
    gone = stored.join(sites_complete.select("site"), "site", "left_semi").where("active").join(seen.select("id"), "id", "left_anti").select("id", F.lit(True).alias("gone"))
    return stored.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")


def price_changes(observed: DataFrame, most: int = ranges.MOST) -> DataFrame:
    """Observations that differ from the key's last one in price, mrp or stock; price_changed only if there was one and its price differs.

    observed(part, n, at, price, mrp, in_stock) with n in order of time; a null mrp counts as the price. A part of over `most`
    observations is gone through in ranges of n.
    """
    rows = observed.withColumns({"mrp": F.coalesce("mrp", "price"), "in_stock": F.coalesce("in_stock", F.lit(False))})
    state = F.struct("price", "mrp", "in_stock")
    marked = ranges.before_in_groups(rows, "part", ["n"], state, "before", most)
    return marked.where(F.col("before").isNull() | (F.col("before") != state)).withColumn("price_changed", F.coalesce(F.col("before.price") != F.col("price"), F.lit(False))).drop("before")


def _with_neighbours(changes: DataFrame, most: int) -> DataFrame:
    """changes with the part's current price, the price before, and how many changes follow."""
    if ranges.large_groups(changes, "part", most) is None:
        own = Window.partitionBy("part").orderBy("n")
        whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return changes.withColumns({"current": F.last("price").over(whole), "before": F.lag("price").over(own), "left": F.count("*").over(whole) - F.row_number().over(own)})
    sums = changes.groupBy("part").agg(F.max_by("price", "n").alias("current"), F.count("*").alias("_all"))
    numbered = ranges.rank_in_groups(ranges.before_in_groups(changes, "part", ["n"], F.col("price"), "before", most), "part", ["n"], "_at", most)
    return numbered.join(sums, "part").withColumn("left", F.col("_all") - F.col("_at")).drop("_all", "_at")


def history_summary(changes: DataFrame, as_of: Column, days: int = 30, points: int = 30, most: int = ranges.MOST) -> DataFrame:
    """One row a part of its price history changes(part, n, at, price); the current price is the last one.

    previous_price is the latest earlier price that differs from the current one; last_change the time of the last step,
    else the first time; lowest and highest are over `days` before as_of, the current price included; series is the last
    `points` of date:price. Of a part of over `most` changes the windows are taken in ranges of n, the rest is summed up by task.
    """
    rows = _with_neighbours(changes, most)
    recent = F.col("at") >= as_of - F.make_dt_interval(F.lit(days))
    summed = rows.groupBy("part").agg(
        F.count("*").alias("points"), F.min_by("at", "n").alias("tracked_since"), F.max("current").alias("price"),
        F.max_by(F.when((F.col("price") != F.col("current")) & (F.col("left") > 0), F.col("price")), F.when((F.col("price") != F.col("current")) & (F.col("left") > 0), F.col("n"))).alias("previous_price"),
        F.coalesce(F.max_by("at", F.when(F.col("before") != F.col("price"), F.col("n"))), F.min_by("at", "n")).alias("last_change"),
        F.min(F.when(recent, F.col("price"))).alias("low"), F.max(F.when(recent, F.col("price"))).alias("high"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("left") < points, F.struct("n", F.concat_ws(":", F.date_format("at", "yyyy-MM-dd"), F.format_string("%.2f", "price")).alias("s"))))), lambda x: x["s"]), ",").alias("series"),
    )
    lowest, highest = F.least(F.coalesce("low", "price"), "price"), F.greatest(F.coalesce("high", "price"), "price")
    known = F.col("previous_price").isNotNull()
    return summed.select(
        "part", "points", "tracked_since", "price", "previous_price", (known & (F.col("price") < F.col("previous_price"))).alias("price_dropped"), "last_change",
        lowest.alias("lowest"), highest.alias("highest"), (known & (F.col("price") <= lowest)).alias("is_lowest"), "series",
    )


def due_alerts(alerts: DataFrame, products: DataFrame) -> DataFrame:
    """Active alerts(alert_id, product_id, email, target_price, active) whose product is in stock at the target price or less."""
    return alerts.where("active").join(products.select(F.col("id").alias("product_id"), "price", "in_stock"), "product_id").where("in_stock and price > 0 and price <= target_price").select("alert_id", "product_id", "email", "target_price", F.col("price").alias("notified_price"))


def after_notice(alerts: DataFrame, due: DataFrame) -> DataFrame:
    """The alerts with those just sent made inactive, so each fires once."""
    sent = due.select("alert_id", F.lit(True).alias("sent"))
    return alerts.join(sent, "alert_id", "left").withColumn("active", F.col("active") & F.col("sent").isNull()).drop("sent")


def alert_errors(requests: DataFrame, products: DataFrame, alerts: DataFrame, most: int = 20) -> DataFrame:
    """requests(request_id, product_id, email, target_price) with error: null, or 404 unknown product, 400 bad email or target, 429 too many."""
    quota = alerts.where("active").groupBy(F.lower(F.trim("email")).alias("e")).agg(F.count("*").alias("held"))
    both = requests.withColumn("e", F.lower(F.trim("email"))).join(quota, "e", "left").join(products.select(F.col("id").alias("product_id"), F.col("price").alias("now")), "product_id", "left")
    error = F.when(F.col("now").isNull(), 404).when(~F.coalesce(F.col("e").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)), 400).when((F.col("target_price") <= 0) | (F.col("target_price") >= F.col("now")), 400).when(F.coalesce("held", F.lit(0)) >= most, 429)
    return both.select("request_id", error.alias("error"))


def invalid_products(products: DataFrame, most: int = 5) -> DataFrame:
    """(id, missing): the first `most` ids, in order, of products without an id, name, category or price, with what they lack."""
    required = {"id": F.col("id"), "name": F.col("name"), "category": F.col("category"), "price": F.col("price").cast("string")}
    missing = F.array_compact(F.array(*[F.when(c.isNull() | (c == ""), F.lit(n)) for n, c in required.items()]))
    return products.select("id", missing.alias("missing")).where(F.size("missing") > 0).orderBy(F.asc_nulls_first("id")).limit(most)


def crawl_outcomes(before: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, site, outcome) of a crawl: new, changed (another price), saved, or removed if it wasn't seen again."""
    both = before.select("id", F.col("site").alias("s0"), F.col("price").alias("p0"), F.lit(True).alias("b")).join(seen.select("id", F.col("site").alias("s1"), F.col("price").alias("p1"), F.lit(True).alias("n")), "id", "full")
    outcome = F.when(F.col("n").isNull(), "removed").when(F.col("b").isNull(), "new").when(F.col("p0") != F.col("p1"), "changed").otherwise("saved")
    return both.select("id", F.coalesce("s1", "s0").alias("site"), outcome.alias("outcome"))
