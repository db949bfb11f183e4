"""Counts and summaries of searches, clicks, shops and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import half_up


def top_counts(rows: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """(group, name, n): the k most frequent names of each group, ties by name."""
    counts = rows.groupBy(group, name).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), name))
    return counts.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def search_summary(events: DataFrame) -> DataFrame:
    """One row over events(type search or click, query_id, query, total, latency_ms): counts, rates, mean latency, top five queries.

    The click-through rate is the share of searched query ids that were clicked; every rate is 0 without searches.
    """
    search, click = F.col("type") == "search", F.col("type") == "click"
    ids = events.groupBy("query_id").agg(F.bool_or(search).alias("s"), F.bool_or(click).alias("c")).agg(F.count_if("s").alias("asked"), F.count_if(F.col("s") & F.col("c")).alias("both"))
    sums = events.agg(F.count_if(search).alias("searches"), F.count_if(click).alias("clicks"), F.count_if(search & (F.col("total") == 0)).alias("empty"), F.avg(F.when(search, F.col("latency_ms"))).alias("mean"))
    top = events.where(search).groupBy("query").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "query").limit(5)
    names = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("n"), "query"))), lambda x: F.concat_ws(":", x["query"], -x["n"])), ",").alias("top_queries"))
    return sums.crossJoin(ids).crossJoin(names).select(
        "searches", "clicks", F.when(F.col("asked") > 0, half_up(F.col("both") / F.col("asked"), 4)).otherwise(0.0).alias("click_through_rate"),
        F.when(F.col("searches") > 0, half_up(F.col("empty") / F.col("searches"), 4)).otherwise(0.0).alias("zero_result_rate"), F.coalesce(half_up(F.col("mean"), 2), F.lit(0.0)).alias("avg_latency_ms"), "top_queries",
    )


def site_stats(sites: DataFrame, products: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a site: products, those in stock, the highest price, and the last crawl run with its status."""
    own = products.groupBy("site").agg(F.count("*").alias("products"), F.count_if("in_stock").alias("in_stock"), F.max("price").alias("highest"))
    last = runs.groupBy("site").agg(F.max(F.struct("run_id", "status")).alias("r")).select("site", F.col("r.run_id").alias("last_run"), F.col("r.status").alias("last_status"))
    every = sites.select("site").union(products.select("site")).distinct()
    return every.join(own, "site", "left").join(last, "site", "left").select("site", F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("in_stock", F.lit(0)).alias("in_stock"), "highest", "last_run", "last_status")


def moving_average(rows: DataFrame, key: str, value: str, order: list[str], keep: float = 0.8) -> DataFrame:
    """(key, ema): e = keep * e + (1 - keep) * value from the first value on, as a weighted sum by place, so that a key's rows needn't be collected."""
    own = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    placed = rows.where(F.col(value).isNotNull()).withColumn("back", F.row_number().over(own) - 1)
    oldest = F.lead("back").over(Window.partitionBy(key).orderBy("back")).isNull()
    weight = F.when(oldest, F.lit(1.0)).otherwise(1 - keep) * F.pow(F.lit(keep), F.col("back"))
    return placed.withColumn("w", weight).groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias("ema"))


def crawl_counters(events: DataFrame) -> DataFrame:
    """Per site what a crawl did: events(site, outcome) with outcome saved, new, changed, skipped or removed."""
    return events.groupBy("site").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "new", "changed", "skipped", "removed")])


def site_flags(products: DataFrame) -> DataFrame:
    """One row: has_ratings, whether any product has a review, and last_scraped_at, the latest time as text (null without any)."""
    return products.agg(F.coalesce(F.bool_or(F.coalesce("review_count", F.lit(0)) > 0), F.lit(False)).alias("has_ratings"), F.max(F.nullif("scraped_at", F.lit(""))).alias("last_scraped_at"))


def history_counts(history: DataFrame, products: DataFrame) -> DataFrame:
    """(site, changes): observations of price history(id) of each site's products(id, site)."""
    return history.groupBy("id").agg(F.count("*").alias("n")).join(products.select("id", "site"), "id").groupBy("site").agg(F.sum("n").alias("changes"))
