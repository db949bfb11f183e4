"""Writers of catalogues, indexes, logs and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.matching import cut


def export_catalog(products: DataFrame, path: str) -> None:
    """The catalogue as JSON lines; the committer publishes it as a whole."""
    products.write.mode("overwrite").json(path)


def write_index(table: DataFrame, path: str, version: int, built_at: Column) -> None:
    """An index table and beside it one row of metadata: version, rows, when built."""
    table.write.mode("overwrite").parquet(path)
    rows = table.sparkSession.read.parquet(path)
    rows.agg(F.count("*").alias("n")).select("n", F.lit(version).alias("version"), built_at.cast("string").alias("built_at")).write.mode("overwrite").parquet(f"{path}_meta")


def append_log(rows: DataFrame, path: str) -> None:
    """Impressions or clicks at the end of their table; features are kept to six places."""
    if "features" in rows.columns:
        rows = rows.withColumn("features", F.transform("features", lambda f: F.round(f, 6)))
    rows.write.mode("append").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").option("header", True).csv(path)


def write_changes(products: DataFrame, servers: str, topic: str = "product-updates") -> None:
    """Products as upserts on a Kafka topic."""
    value = F.to_json(F.struct(F.lit("upsert").alias("_action"), *products.columns))
    products.select(F.col("_id").alias("key"), value.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def notice_texts(due: DataFrame) -> DataFrame:
    """(email, subject, body) of due alerts, for an outbox table or a mailer."""
    price = F.format_string("%.0f", "notified_price")
    return due.select("email", F.concat(F.lit("Price drop: "), "product_id").alias("subject"), F.concat("product_id", F.lit(" is now "), price, F.lit(" (target "), F.format_string("%.0f", "target_price"), F.lit(")")).alias("body"))


def append_outbox(due: DataFrame, path: str, at: Column) -> None:
    """Notices of due alerts at the end of an outbox table, for whoever sends them."""
    notice_texts(due).withColumn("queued_at", at).write.mode("append").json(path)


def write_report(means: DataFrame, path: str) -> None:
    """A metric report (rows of measure_means, a few) as JSON lines and, beside it, as lines of a Markdown table."""
    rows = cut(means.coalesce(1))
    rows.write.mode("overwrite").json(f"{path}/json")
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if t == "double" else F.col(c).cast("string"), F.lit("-")) for c, t in rows.dtypes]
    head = [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}"]
    lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    rows.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(lines).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def replaced(stored: DataFrame, documents: DataFrame, key: str = "_id") -> DataFrame:
    """stored with whole documents put in the place of those of their key (or added): fields that a document lacks are null
    afterwards, where a merge would keep them."""
    return stored.join(documents.select(key), key, "left_anti").unionByName(documents, allowMissingColumns=True).select(*stored.columns)
