"""Domain views over the driver's tables: listings, price observations, a corpus with queries, impressions, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import half_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_price() -> Column:
    return half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)


LETTERS = ["S", "M", "L", "XL", "XXL", "28", "32"]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each part and supplier. Line items are aggregated before the joins, so those see one row a listing."""
    # a set of sizes is a number with a bit for each, which a hash aggregation sums up in place
    bit = F.when(F.col("l_linenumber").between(1, len(LETTERS)), F.expr("shiftleft(1, l_linenumber - 1)"))
    letters = lambda mask: F.array_compact(F.array(*[F.when(F.coalesce(mask, F.lit(0)).bitwiseAND(1 << LETTERS.index(x)) != 0, F.lit(x)) for x in sorted(LETTERS)]))
    lines = spread(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus"), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
        F.min(unit_price()).alias("price"), F.max(unit_price()).alias("mrp"), F.count("*").alias("review_count"), (F.max("l_linestatus") == "O").alias("in_stock"),
        F.bit_or(bit).alias("sizes"), F.bit_or(F.when(F.col("l_linestatus") == "O", bit)).alias("available_sizes"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    word = F.split("p_name", " ")
    both = lines.join(part, "l_partkey").join(supplier, "l_suppkey")
    return both.select(
        F.concat(F.lit("p"), F.col("l_partkey"), F.lit("_s"), F.col("l_suppkey")).alias("id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.col("s_name").alias("source_name"),
        F.col("l_partkey").alias("source_product_id"), F.col("p_name").alias("name"), word[1].alias("category"), F.when(word[0].isin("red", "blue"), word[0]).alias("color"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"), (F.col("p_size") / F.lit(10.0)).alias("rating"), "price", "mrp", "review_count", "in_stock", letters(F.col("sizes")).alias("sizes"), letters(F.col("available_sizes")).alias("available_sizes"),
    )


LISTING_SQL = """
listing as (
  select 'p' || l_partkey || '_s' || l_suppkey as id, 's' || l_suppkey as source, s_name as source_name, l_partkey as source_product_id, p_name as name,
         split_part(p_name, ' ', 2) as category, case when split_part(p_name, ' ', 1) in ('red', 'blue') then split_part(p_name, ' ', 1) end as color,
         p_brand as brand, p_type as product_type, p_size / 10e0 as rating, price, mrp, review_count, in_stock, sizes, available_sizes
  from (select l_partkey, l_suppkey, min(floor(l_extendedprice / l_quantity * 100e0 + 0.5e0) / 100e0) as price, max(floor(l_extendedprice / l_quantity * 100e0 + 0.5e0) / 100e0) as mrp,
               count(*) as review_count, max(l_linestatus) = 'O' as in_stock,
               list_sort(list_distinct(list(['S', 'M', 'L', 'XL', 'XXL', '28', '32'][l_linenumber]))) as sizes,
               coalesce(list_sort(list_distinct(list(['S', 'M', 'L', 'XL', 'XXL', '28', '32'][l_linenumber]) filter (l_linestatus = 'O'))), []) as available_sizes
        from lineitem group by l_partkey, l_suppkey)
  join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey)"""


def intents(spark: SparkSession) -> DataFrame:
    """Shopping queries of our own with what they ask for."""
    rows = [
        (1, "red widget under 1200", "widget", ["red"], 1200.0, None, None), (2, "blue bolt", "bolt", ["blue"], None, None, "L"), (3, "large ring 3 star", "ring", [], None, 3.0, None),
        (4, "gizmo or gear", None, [], 1500.0, None, None), (5, "red or blue anvil size M", "anvil", ["red", "blue"], None, None, "M"), (6, "hot rod under 950", "rod", [], 950.0, 1.0, None),
        (7, "small plate", "plate", [], None, None, "XL"), (8, "red things", None, ["red"], 2000.0, None, None),
    ]
    return spark.createDataFrame(rows, "query_id long, text string, q_category string, q_colors array<string>, max_price double, min_rating double, q_size string")


INTENTS_SQL = """
intents(query_id, text, q_category, q_colors, max_price, min_rating, q_size) as (values
  (1::bigint, 'red widget under 1200', 'widget', ['red'], 1200e0, null::double, null), (2, 'blue bolt', 'bolt', ['blue'], null, null, 'L'), (3, 'large ring 3 star', 'ring', []::varchar[], null, 3e0, null),
  (4, 'gizmo or gear', null, [], 1500e0, null, null), (5, 'red or blue anvil size M', 'anvil', ['red', 'blue'], null, null, 'M'), (6, 'hot rod under 950', 'rod', [], 950e0, 1e0, null),
  (7, 'small plate', 'plate', [], null, null, 'XL'), (8, 'red things', null, ['red'], 2000e0, null, null))"""

OBSERVED_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, n, at, price, mrp, in_stock): a part's unit prices in order of all columns, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*OBSERVED_ORDER))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", *OBSERVED_ORDER, unit_price().alias("price"), "l_linestatus")
    return rows.select(F.col("l_partkey").alias("part"), n.cast("long").alias("n"), F.col("l_shipdate").alias("at"), "price", F.col("price").alias("mrp"), (F.col("l_linestatus") == "O").alias("in_stock"))


OBSERVED_SQL = """
observed as (
  select l_partkey as part, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as n,
         l_shipdate as ts, floor(l_extendedprice / l_quantity * 100e0 + 0.5e0) / 100e0 as price, l_linestatus = 'O' as in_stock
  from lineitem)"""


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, query_id, position, event_id, ts, event_type, clicked, label): a user's events of a week are a session's shown places."""
    week = F.date_trunc("week", "ts")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", week.alias("week"))
    session = F.concat_ws("_", "user_id", F.date_format("week", "yyyyMMdd"))
    position = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("ts", "event_id")) - 1
    return events.select(
        session.alias("session"), position.cast("long").alias("position"), "event_id", "ts", "event_type", F.col("event_type").isin("click", "purchase").alias("clicked"),
        F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("label"), "value",
    )


IMPRESSIONS_SQL = """
impressions as (
  select user_id || '_' || strftime(date_trunc('week', ts), '%Y%m%d') as session,
         row_number() over (partition by user_id, date_trunc('week', ts) order by ts, event_id) - 1 as position, event_id, ts, event_type,
         event_type in ('click', 'purchase') as clicked, (case event_type when 'purchase' then 2 when 'click' then 1 else 0 end)::bigint as label, value
  from events)"""


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A table over all cores where its files give fewer splits than there are cores; many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, *keys)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A table of much work a row in four parts a core: however many splits its files have, a file's rows lie in as many as it has row groups."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
