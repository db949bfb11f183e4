"""A catalogue that merges as it is read: a base in buckets, and the net changes of each batch since.

A batch writes a delta of its own changes only. Readers put the deltas over the base; compaction takes them into the base,
for those buckets only in which they have become many, so what is written in all follows the changes. Each bucket's newest
committed base says which deltas it has taken in, so a reader sees the same rows before, during and after a compaction,
and a batch or a compaction that is run again writes the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.tables import stored

BUCKETS = 16
#: Delta rows, as a share of a bucket's base rows, from which the bucket is compacted.
SHARE = 0.25
FIELDS = {"name": "string", "category": "string", "brand": "string", "price": "double", "mrp": "double", "in_stock": "boolean"}
ROW = "_id string, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())
DELTA = f"{ROW}, _erased boolean, _live boolean, _bucket int"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders kind=<number> whose job has committed."""
    own = [int(n.split("=")[1]) for n in _names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(n for n in own if "_SUCCESS" in _names(spark, f"{path}/{kind}={n}"))


def net_changes(changes: DataFrame) -> DataFrame:
    """One row an _id of changes(_id, _action, at, fields): the fields set since its last delete, if there was one (_erased), and whether anything was set (_live)."""
    own = Window.partitionBy("_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = changes.withColumn("_cut", F.max(F.when(F.col("_action") == "delete", F.col("at"))).over(own))
    after = F.col("_cut").isNull() | (F.col("at") > F.col("_cut"))
    fields = [F.max_by(f, F.when(after & F.col(f).isNotNull(), F.col("at"))).cast(t).alias(f) for f, t in FIELDS.items()]
    bucket = F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    return rows.groupBy("_id").agg(*fields, F.bool_or(F.col("_cut").isNotNull()).alias("_erased"), F.bool_or(after).alias("_live")).select("_id", *FIELDS, "_erased", "_live", bucket)


def write_delta(changes: DataFrame, path: str, number: int) -> None:
    """The net changes of batch `number`; written anew if the batch is run again."""
    net_changes(changes).sortWithinPartitions("_bucket", "_id").write.mode("overwrite").parquet(f"{path}/delta={number}")


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest committed base of each bucket: the number of the last delta it has taken in."""
    newest: dict[int, int] = {}
    for v in _committed(spark, path, "base"):
        for n in _names(spark, f"{path}/base={v}"):
            if n.startswith("_bucket="):
                newest[int(n.split("=")[1])] = v
    return newest


def _base_rows(spark: SparkSession, path: str, bases: dict[int, int]) -> DataFrame:
    none = spark.createDataFrame([], f"{ROW}, _bucket int")
    folders: dict[int, list[str]] = {}
    for b, v in sorted(bases.items()):
        folders.setdefault(v, []).append(f"{path}/base={v}/_bucket={b}")
    each = [spark.read.option("basePath", f"{path}/base={v}").schema(f"{ROW}, _bucket int").parquet(*own).where("_id is not null") for v, own in folders.items()]
    return reduce(DataFrame.unionByName, each) if each else none


def _delta_rows(spark: SparkSession, path: str, bases: dict[int, int], upto: int | None = None) -> DataFrame:
    """Rows of deltas that their bucket's base hasn't taken in, with the delta's number."""
    first = min((bases.get(b, -1) for b in range(BUCKETS)), default=-1)
    numbers = [n for n in _committed(spark, path, "delta") if n > first and (upto is None or n <= upto)]
    each = [spark.read.schema(DELTA).parquet(f"{path}/delta={n}").withColumn("_number", F.lit(n)) for n in numbers]
    rows = reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], f"{DELTA}, _number int")
    taken = F.create_map(*[F.lit(x) for b in range(BUCKETS) for x in (b, bases.get(b, -1))])
    return rows.where(F.col("_number") > F.try_element_at(taken, F.col("_bucket")))


def _merged(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(_id, fields, _bucket) of a base under deltas. Base rows without changes are passed on as they are."""
    touched = deltas.select("_id").distinct()
    old = base.join(touched, "_id", "left_semi").select("_id", *FIELDS, F.lit(False).alias("_erased"), F.lit(True).alias("_live"), "_bucket", F.lit(-1).alias("_number"))
    own = Window.partitionBy("_id")
    rows = old.unionByName(deltas).withColumn("_cut", F.max(F.when(F.col("_erased"), F.col("_number"))).over(own)).where(F.col("_cut").isNull() | (F.col("_number") >= F.col("_cut")))
    fields = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_number"))).alias(f) for f in FIELDS]
    new = rows.groupBy("_id").agg(*fields, F.bool_or("_live").alias("_any"), F.first("_bucket").alias("_bucket")).where("_any").select("_id", *FIELDS, "_bucket")
    return base.join(touched, "_id", "left_anti").select("_id", *FIELDS, "_bucket").unionByName(new)


def read_table(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The catalogue as of now, or as of delta `upto` if no base has taken in a later one."""
    bases = _bases(spark, path)
    return _merged(_base_rows(spark, path, bases), _delta_rows(spark, path, bases, upto)).drop("_bucket")


def compact(spark: SparkSession, path: str, share: float = SHARE) -> list[int]:
    """Takes the deltas into the base of the buckets where they have over `share` of its rows; the buckets' numbers are given back. 0 takes all."""
    bases = _bases(spark, path)
    base, deltas = _base_rows(spark, path, bases), _delta_rows(spark, path, bases)
    sizes = {r["_bucket"]: r["n"] for r in base.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # a number a bucket
    pending = {r["_bucket"]: (r["n"], r["last"]) for r in deltas.groupBy("_bucket").agg(F.count("*").alias("n"), F.max("_number").alias("last")).collect()}
    due = sorted(b for b, (n, _) in pending.items() if n > share * sizes.get(b, 0))
    if not due:
        return []
    last = max(n for _, n in pending.values())
    rows = _merged(_base_rows(spark, path, {b: v for b, v in bases.items() if b in due}), deltas.where(F.col("_bucket").isin(due)))
    # a bucket that has lost all its rows leaves a row without an id, so that its folder is there
    marks = spark.createDataFrame([(b,) for b in due], "_bucket int").select(F.lit(None).cast("string").alias("_id"), *[F.lit(None).cast(t).alias(f) for f, t in FIELDS.items()], "_bucket")
    rows.unionByName(marks).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base={last}")
    return due


def drop_taken(spark: SparkSession, path: str) -> list[str]:
    """Removes deltas that every bucket's base has taken in and bases that no bucket needs; readers of older states must be done. Gives back what went."""
    bases = _bases(spark, path)
    fs, at = _folder(spark, path)
    gone = [f"base={v}" for v in _committed(spark, path, "base") if v not in bases.values()]
    for n in _committed(spark, path, "delta"):
        left = spark.read.schema(DELTA).parquet(f"{path}/delta={n}").select("_bucket").distinct().collect()
        if all(bases.get(r["_bucket"], -1) >= n for r in left):
            gone.append(f"delta={n}")
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone


def write_table(rows: DataFrame, path: str) -> None:
    """A first base of rows(_id, fields), one row an _id."""
    bucket = F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).cast("int")
    rows.select("_id", *[F.col(f).cast(t).alias(f) for f, t in FIELDS.items()], bucket.alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/base=-1")


def merge_batch(spark: SparkSession, batch: DataFrame, path: str, number: int, share: float = SHARE) -> bool:
    """One micro-batch: its delta, and compaction where it is due. Whether the batch had changes."""
    rows = stored(batch, "batch")
    if rows.isEmpty():
        return False
    write_delta(rows, path, number)
    compact(spark, path, share)
    return True
