"""Order within groups of any size: a large group is cut into ranges of its order, each ranked by itself, and counts are carried over.

Groups of at most `most` rows are ranked by a window as they are. Larger ones, of which there are at most rows / most, are
cut at bounds from a sample of their own rows, taken by hash of the whole order, so that rows of equal first columns can
be told apart too. The ranges of a group go to tasks of their own; from one range to the next only its count and its last row are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.tables import stored

#: Rows of a group that one task ranks, and rows of a large group's sample for each of its ranges.
MOST, SAMPLED = 1_000_000, 64


def large_groups(rows: DataFrame, group: str, most: int = MOST) -> DataFrame | None:
    """(group, n) of the groups of over `most` rows, None without any. Rows are counted before they are sent."""
    return none_or_stored(rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most))


def none_or_stored(sizes: DataFrame) -> DataFrame | None:
    return None if sizes.isEmpty() else stored(sizes, "sizes")


def cut_groups(rows: DataFrame, group: str, order: list[str], large: DataFrame, most: int = MOST) -> DataFrame:
    """rows with _range: 0 for all of a small group, the number of a large group's range of about `most` rows or fewer; each range goes to one task."""
    place = F.struct(*order)
    ranges = F.ceil(F.col("_n") / most) * 2
    sampled = rows.join(large, group).where(F.pmod(F.xxhash64(*order), F.greatest(F.floor(F.col("_n") / (ranges * SAMPLED)), F.lit(1))) == 0)
    # one of SAMPLED of the sampled rows is a bound: a few numbers a range
    bounds = sampled.groupBy(group).agg(F.sort_array(F.collect_list(place)).alias("all"), F.first(ranges).alias("_k"))
    step = F.greatest(F.floor(F.size("all") / F.col("_k")), F.lit(1))
    bounds = bounds.select(group, F.transform(F.sequence(step.cast("int"), F.greatest(F.size("all"), step).cast("int"), step.cast("int")), lambda i: F.element_at("all", F.least(i, F.size("all")))).alias("_bounds"))
    placed = rows.join(bounds, group, "left").withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b < place)), F.lit(0))).drop("_bounds")
    return placed.repartition(group, "_range")


def _carried(placed: DataFrame, group: str, order: list[str], large: DataFrame, *values: Column) -> DataFrame:
    """Of each range of a large group: the rows before it, and what `values` are in the last of these."""
    last = [F.max_by(v, F.struct(*order)).alias(f"_v{i}") for i, v in enumerate(values)]
    ends = placed.join(large.select(group), group, "left_semi").groupBy(group, "_range").agg(F.count("*").alias("_c"), *last)
    own = Window.partitionBy(group).orderBy("_range")
    before = [F.lag(f"_v{i}").over(own).alias(f"_b{i}") for i in range(len(values))]
    return ends.select(group, "_range", F.coalesce(F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *before)


def rank_in_groups(rows: DataFrame, group: str, order: list[str], name: str = "rank", most: int = MOST, sizes: DataFrame | None = None) -> DataFrame:
    """rows with their number, from 1, in the order of `order` within their group. Rows of equal order are numbered in any order.

    sizes(group, _n) are counts of the groups where they are known.
    """
    large = large_groups(rows, group, most) if sizes is None else none_or_stored(sizes.where(F.col("_n") > most))
    if large is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    placed = stored(cut_groups(rows, group, order, large, most), "ranges")
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    numbered = placed.repartition(group, "_range").withColumn("_own", own)
    return numbered.join(_carried(placed, group, order, large), [group, "_range"], "left").withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before", "_range")


def before_in_groups(rows: DataFrame, group: str, order: list[str], value: Column, name: str, most: int = MOST) -> DataFrame:
    """rows with what `value` is in the row before theirs in their group, null in the first."""
    large = large_groups(rows, group, most)
    if large is None:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(*order)))
    placed = stored(cut_groups(rows, group, order, large, most), "ranges")
    own = Window.partitionBy(group, "_range").orderBy(*order)
    lagged = placed.repartition(group, "_range").withColumns({name: F.lag(value).over(own), "_own": F.row_number().over(own)})
    carried = _carried(placed, group, order, large, value)
    return lagged.join(carried, [group, "_range"], "left").withColumn(name, F.when(F.col("_own") == 1, F.col("_b0")).otherwise(F.col(name))).drop("_own", "_before", "_b0", "_range")
