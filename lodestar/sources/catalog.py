"""Readers of catalogues, feeds, labels, queries, logs and indexes."""

from __future__ import annotations

import os
import tomllib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar import schemas as S
from lodestar.functions.text import safe_id


def read_catalog(spark: SparkSession, path: str, schema: str = S.PRODUCT) -> DataFrame:
    """A JSON catalogue, whole arrays or one product a line; no rows if there is no such path."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def catalog_in_use(mode: str, live_ready: bool) -> str:
    """Which catalogue a mode stands for: live, demo, or auto: live if its catalogue and its index exist."""
    if mode not in ("live", "demo", "auto"):
        raise ValueError(f"unknown catalogue mode {mode!r}")
    return ("live" if live_ready else "demo") if mode == "auto" else mode


def active_products(products: DataFrame) -> DataFrame:
    return products.where("active").orderBy("site", "id")


def hydrate(ids: DataFrame, store: DataFrame, fallback: DataFrame) -> DataFrame:
    """Products of ids(id) from the store; from the fallback if the store has none of them at all."""
    found = store.join(ids.select("id").distinct(), "id", "left_semi")
    return fallback.join(ids.select("id").distinct(), "id", "left_semi") if found.isEmpty() else found


#: Products of a full page of a feed: one with fewer is a feed's last.
PAGE_SIZE = 250


def feeds_complete(spark: SparkSession, path: str, most: int | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row: products (distinct ids), complete. A crawl stored as files feed/page-N.json is complete if each feed's last page
    is short or empty and the cap `most` wasn't reached: only then may products that are missing from it count as gone."""
    name = F.input_file_name()
    pages = spark.read.schema(S.FEED).option("multiLine", True).json(path).select(F.regexp_extract(name, r"([^/]*)/[^/]*$", 1).alias("feed"), F.regexp_extract(name, r"(\d+)\D*$", 1).cast("int").alias("page"), F.coalesce(F.size("products"), F.lit(0)).alias("n"), F.transform("products", lambda p: p["id"]).alias("ids"))
    ends = pages.groupBy("feed").agg(F.max_by("n", "page").alias("n")).agg(F.coalesce(F.bool_and(F.col("n") < page_size), F.lit(False)).alias("ended"))
    found = pages.select(F.explode("ids").alias("id")).agg(F.countDistinct("id").alias("products"))
    return found.crossJoin(ends).select("products", (F.col("ended") & (F.col("products") < most if most is not None else F.lit(True))).alias("complete"))


def read_feed(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Products of a shop's paged feed files as raw products, each id once (feeds repeat products by collection); `most` of them, of least id.

    Tags are a comma list; images are ordered by position; a variant is available unless it says otherwise.
    """
    p = F.col("p")
    pages = spark.read.schema(S.FEED).option("multiLine", True).json(path).select(F.explode("products").alias("p"))
    images = F.transform(F.array_sort(F.filter(F.transform(F.coalesce(p["images"], F.array()), lambda i: F.struct(F.coalesce(i["position"], F.lit(0)).alias("position"), i["src"].alias("src"))), lambda i: i["src"].isNotNull() & (i["src"] != ""))), lambda i: i["src"])
    variants = F.transform(p["variants"], lambda v: F.struct(v["price"].alias("price"), v["compare_at_price"].alias("compare_at_price"), F.coalesce(v["available"], F.lit(True)).alias("available"), F.array(v["option1"], v["option2"], v["option3"]).alias("options"), v["sku"].alias("sku")))
    none = F.lit(None)
    rows = pages.select(
        p["id"].cast("string").alias("source_product_id"), F.concat(F.lit("/products/"), p["handle"]).alias("url"), F.coalesce(p["title"], F.lit("")).alias("title"), F.coalesce(p["vendor"], F.lit("")).alias("vendor"), none.cast("string").alias("brand"),
        F.coalesce(p["product_type"], F.lit("")).alias("product_type"), F.filter(F.transform(F.split(F.coalesce(F.regexp_replace(p["tags"], r'[\[\]"]', ""), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags"),
        F.coalesce(p["body_html"], F.lit("")).alias("description_html"), images.alias("images"), p["options"].alias("options"), variants.alias("variants"), none.cast("string").alias("color"), none.cast("double").alias("rating"),
        none.cast("int").alias("review_count"), none.cast("string").alias("currency"), none.cast("string").alias("gtin"),
    )
    rows = rows.dropDuplicates(["source_product_id"])
    return rows if most is None else rows.orderBy(F.col("source_product_id").try_cast("long"), "source_product_id").limit(most)


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CLICK).json(path).withColumn("shown_results", F.from_json("shown_results", "array<string>"))


ESCAPES = r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrt'\"\\])"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """Backslash escapes of a text undone; one that can't be stays as it is."""

    def one(t):
        try:
            return t.encode("latin-1", "backslashreplace").decode("unicode_escape")
        except ValueError:
            return t

    return text.map(lambda t: one(t) if isinstance(t, str) else None)


def read_csv_products(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV export; rows that don't parse are left out. Backslash escapes in its texts are undone, in a text where that fails
    the bytes count as Latin-1. category_path is the split of a `[\"a >> b\"]` category tree."""
    rows = spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumns({c: F.when(F.rlike(F.col(c), F.lit(ESCAPES)), _unescaped(c)).otherwise(F.col(c)) for c in rows.columns})
    return rows.withColumn("category_path", category_path(F.col("product_category_tree"))) if "product_category_tree" in rows.columns else rows


def category_path(tree):
    """`["Clothing >> Women's Clothing"]` as lower-case steps with underscores."""
    first = F.get(F.from_json(tree, "array<string>"), F.lit(0))
    return F.transform(F.split(first, ">>"), lambda s: F.replace(F.lower(F.trim(s)), F.lit(" "), F.lit("_")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels, with or without a byte order mark."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    """(text): one query a line; blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> '' and not startswith(text, '#')")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored index table, or None if it must be built."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fresh(pages: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Cached pages(fetched_at) that are no older than `hours` at as_of: the rest is to be fetched again."""
    return pages.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def missing_images(products: DataFrame, indexed: DataFrame) -> DataFrame:
    """Products with an image whose file isn't indexed yet."""
    wanted = products.where("image_url <> ''").select("_id", "image_url", F.concat(safe_id(F.col("_id")), F.lit(".jpg")).alias("file"))
    return wanted.join(indexed.select("file"), "file", "left_anti")


def read_config(text: str, environment: dict[str, str] | None = None) -> tuple[dict, list[dict]]:
    """(settings, sites) of a TOML configuration with a [crawler] table and [[site]] entries; variables CRAWLER_CONTACT and
    FEEDBACK_DB of the environment win over contact and alerts_db."""
    given = tomllib.loads(text)
    env = os.environ if environment is None else environment
    settings = {k: v for k, v in given.get("crawler", {}).items() if k != "sites"}
    settings |= {field: env[name] for name, field in (("CRAWLER_CONTACT", "contact"), ("FEEDBACK_DB", "alerts_db")) if name in env}
    return settings, [dict(s) for s in given.get("site", [])]


def sampled(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows by the order of a seeded hash of their key: equal on every run and at any parallelism."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
