"""Impressions and clicks as training data, and measures of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.matching import cut


def training_sessions(impressions: DataFrame, clicks: DataFrame, version: int) -> DataFrame:
    """Text impressions of one feature version in sessions that have a click, with whether each was clicked."""
    shown = impressions.where((F.col("feature_version") == version) & (F.col("mode").isNull() | (F.col("mode") == "text")))
    asked = clicks.select("query_id").distinct()
    marked = clicks.select("query_id", F.col("clicked_id").alias("product_id"), F.lit(True).alias("hit")).distinct()
    return shown.join(asked, "query_id", "left_semi").join(marked, ["query_id", "product_id"], "left").withColumn("clicked", F.coalesce("hit", F.lit(False))).drop("hit")


def skip_above(items: DataFrame) -> DataFrame:
    """items(session, position, clicked) up to one place below the last click, of sessions where both labels are left."""
    own = Window.partitionBy("session")
    cut = items.withColumn("cutoff", F.max(F.when(F.col("clicked"), F.col("position"))).over(own) + 1).where("position <= cutoff").drop("cutoff")
    both = cut.withColumns({"any": F.bool_or("clicked").over(own), "every": F.bool_and("clicked").over(own)})
    return both.where("any and not every").drop("any", "every")


def global_places(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, from 0, in the order given over all of them: sorted by range, each range numbered after those before.

    The ranges are stored, so that a range keeps its number however often they are read.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # one row a partition
    before = sizes.alias("x").join(F.broadcast(sizes.alias("y")), F.col("y.range") < F.col("x.range"), "left").groupBy(F.col("x.range").alias("range")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("own", own).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("own") - 1).drop("range", "own", "before")


def newest_held_out(sessions: DataFrame, share: float, *order: str) -> DataFrame:
    """sessions with held_out for the newest share: at least one of five sessions or more, none of fewer."""
    n = sessions.count()
    kept = max(1, int(n * share)) if n >= 5 else 0
    if not kept:
        return sessions.withColumn("held_out", F.lit(False))
    return global_places(sessions, *[F.desc(o) for o in order]).withColumn("held_out", F.col("place") < kept).drop("place")


def hard_negatives(sessions: DataFrame, top: int = 10) -> DataFrame:
    """(session, product, label, shown_rank) of sessions(session, shown array, clicked_id): the clicked one with 3, the others of the first `top` shown with 0."""
    good = sessions.where(F.col("clicked_id").isNotNull() & (F.size("shown") > 0))
    hit = good.select("session", F.col("clicked_id").alias("product"), F.lit(3).alias("label"), F.lit(None).cast("int").alias("shown_rank"))
    shown = good.select("session", "clicked_id", F.posexplode(F.slice("shown", 1, top)).alias("place", "product"))
    return hit.unionByName(shown.where("product <> clicked_id").select("session", "product", F.lit(0).alias("label"), (F.col("place") + 1).alias("shown_rank")))


def gain_over_discount(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def ranking_measures(ranked: DataFrame, judgments: DataFrame, k: int, good: int = 2, mrr_depth: int = 20) -> DataFrame:
    """One row a query of judgments(query_id, doc_id, rel) or ranked(query_id, doc_id, rank): ndcg (null without gain to be had),
    ndcg_legacy (1 or 0 then), recall (null if nothing is good), rr, judged."""
    own = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = judgments.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain_over_discount(F.col("rel"), F.col("r"))).alias("idcg"))
    pool = judgments.where(F.col("rel") >= good).groupBy("query_id").agg(F.count("*").alias("n_good"))
    top = ranked.join(judgments.withColumn("known", F.lit(True)), ["query_id", "doc_id"], "left")
    got = top.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain_over_discount(F.coalesce("rel", F.lit(0)), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if((F.col("rank") <= k) & (F.coalesce("rel", F.lit(0)) >= good)).alias("hits"), F.min(F.when((F.col("rel") >= good) & (F.col("rank") <= mrr_depth), F.col("rank"))).alias("first"),
        F.count_if((F.col("rank") <= k) & F.col("known")).alias("judged_n"), F.count_if(F.col("rank") <= k).alias("n"),
    )
    rows = ranked.select("query_id").union(judgments.select("query_id")).distinct().join(ideal, "query_id", "left").join(pool, "query_id", "left").join(got, "query_id", "left")
    idcg, dcg = F.coalesce("idcg", F.lit(0.0)), F.coalesce("dcg", F.lit(0.0))
    return rows.select(
        "query_id", F.when(idcg > 0, dcg / idcg).alias("ndcg"), F.when(idcg > 0, dcg / idcg).when(dcg == 0, F.lit(1.0)).otherwise(0.0).alias("ndcg_legacy"),
        F.when(F.col("n_good") > 0, F.coalesce("hits", F.lit(0)) / F.col("n_good")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("judged_n") / F.col("n")).alias("judged"),
    )


def binary_measures(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """hit, rr, ndcg of ranked(query_id, doc_id, rank) against relevant(query_id, doc_id); the ideal is of the hits retrieved."""
    top = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id", F.lit(1).alias("good")), ["query_id", "doc_id"], "left")
    sums = top.groupBy("query_id").agg(F.count("good").alias("n"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("good") == 1, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n").cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return sums.select("query_id", (F.col("n") > 0).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def nearest_rank(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at place round-half-even(share * (n - 1)) from 0. The places are looked up in a table sorted by range."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    counts = rows.groupBy("value").agg(F.count("*").alias("c"))
    # cumulative counts of the distinct values, by range partitions: totals of earlier partitions are added to each
    # stored, so that a range keeps its number in both uses
    ranged = cut(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()))
    before = ranged.groupBy("p").agg(F.sum("c").alias("t"))
    offsets = before.alias("x").join(F.broadcast(before.alias("y")), F.col("y.p") < F.col("x.p"), "left").groupBy(F.col("x.p").alias("p")).agg(F.coalesce(F.sum("y.t"), F.lit(0)).alias("offset"))
    upto = F.sum("c").over(Window.partitionBy("p").orderBy("value"))
    places = ranged.withColumn("upto", upto).join(F.broadcast(offsets), "p").select("value", (F.col("offset") + F.col("upto")).alias("last"), "c")
    n = rows.agg(F.count("*").alias("n"))
    asked = values.sparkSession.createDataFrame([(s,) for s in shares], "share double").crossJoin(n).select("share", F.bround(F.col("share") * (F.col("n") - 1), 0).cast("long").alias("place"))
    return places.join(F.broadcast(asked), (F.col("place") < F.col("last")) & (F.col("place") >= F.col("last") - F.col("c"))).select("share", "value")


def pooled(lists: DataFrame, labelled: DataFrame, top: int) -> DataFrame:
    """(query_id, doc_id, place): the first `top` of every variant's list(variant, query_id, doc_id, rank), once each in order first seen, without those labelled."""
    first = lists.where(F.col("rank") <= top).groupBy("query_id", "doc_id").agg(F.min(F.struct("variant", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id"))
    return first.withColumn("place", place).join(labelled.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "place")


def label_counts(labels: DataFrame) -> DataFrame:
    """(label, label_source, n) of judged pairs; an empty label is unjudged and counts as null."""
    label = F.nullif(F.trim(F.col("label").cast("string")), F.lit("")).try_cast("int")
    return labels.select(label.alias("label"), "label_source").groupBy("label", "label_source").agg(F.count("*").alias("n"))


def measure_means(measures: DataFrame, *by: str) -> DataFrame:
    """Means over queries of ranking_measures by variant or other keys, with the number of queries that have each: a metric report's rows."""
    names = [c for c in ("ndcg", "recall", "rr", "judged") if c in measures.columns]
    return measures.groupBy(*by).agg(F.count("*").alias("queries"), F.count("ndcg").alias("queries_with_gain"), *[F.avg(c).alias(c) for c in names])
