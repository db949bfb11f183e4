"""Order within groups that are larger than a task should hold."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import catalog, matching, ranges


def rows(spark, seed=1, n=6000):
    """Two thirds of all rows in one group, many of them with the same price; small groups beside it."""
    r = random.Random(seed)
    own = [(i, "hot" if i % 3 else f"g{i % 40}", r.choice([1.0, 1.0, 1.0, r.random(), None])) for i in range(n)]
    return own, spark.createDataFrame(own, "id long, g string, price double").repartition(5)


@pytest.mark.parametrize("most", [10_000, 300, 7])
def test_ranks(spark, most):
    own, table = rows(spark)
    got = {x.id: x["rank"] for x in ranges.rank_in_groups(table.withColumn("p", F.coalesce("price", F.lit(9.0))), "g", ["p", "id"], most=most).collect()}
    want = {}
    for g in {x[1] for x in own}:
        for k, (i, _, _) in enumerate(sorted((x for x in own if x[1] == g), key=lambda x: (9.0 if x[2] is None else x[2], x[0]))):
            want[i] = k + 1
    assert got == want


def test_a_large_group_is_many_tasks(spark):
    own, table = rows(spark)
    large = ranges.large_groups(table, "g", 300)
    cut = ranges.cut_groups(table, "g", ["price", "id"], large, 300)
    sizes = {(x.g, x["_range"]): x["count"] for x in cut.groupBy("g", "_range").count().collect()}
    assert sum(n for (g, _), n in sizes.items() if g == "hot") == 4000 and max(sizes.values()) <= 600 and len([1 for g, _ in sizes if g == "hot"]) >= 10
    assert all(k == 0 for g, k in sizes if g != "hot") and ranges.large_groups(table, "g", 5000) is None


@pytest.mark.parametrize("most", [10_000, 300, 7])
def test_row_before(spark, most):
    own, table = rows(spark)
    got = {x.id: x.b for x in ranges.before_in_groups(table, "g", ["id"], F.struct("id", "price"), "b", most).collect()}
    last, want = {}, {}
    for i, g, p in own:
        want[i], last[g] = last.get(g), (i, p)
    assert {i: b and tuple(b) for i, b in got.items()} == want


@pytest.mark.parametrize("most", [50])
def test_the_same_history_and_index_of_large_groups(spark, most):
    r = random.Random(2)
    seen = [(0 if i % 2 else i % 30, i, float(r.choice([5, 5, 6, 7])), r.random() < 0.8) for i in range(3000)]
    observed = spark.createDataFrame(seen, "part long, n long, price double, in_stock boolean").withColumns({"mrp": F.lit(None).cast("double"), "at": F.timestamp_seconds(F.col("n") * 40_000)}).repartition(4)
    as_of = F.timestamp_seconds(F.lit(3000 * 40_000))
    plain = catalog.price_changes(observed)
    assert sorted(map(str, catalog.price_changes(observed, most).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, catalog.history_summary(plain, as_of, most=most).collect())) == sorted(map(str, catalog.history_summary(plain, as_of).collect()))
    _, table = rows(spark)
    groups = table.select(F.col("g").alias("group_id"), "id").unionByName(spark.createDataFrame([("hot", -5), ("lost", -6)], "group_id string, id long"))
    assert sorted(map(str, matching.dedup_index(table, groups, most).collect())) == sorted(map(str, matching.dedup_index(table, groups).collect()))
    assert {x.group_size for x in matching.dedup_index(table, groups, most).where("group_id = 'hot'").collect()} == {4001}


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, g string, price double")
    assert ranges.rank_in_groups(none, "g", ["price", "id"]).count() == 0 and ranges.before_in_groups(none, "g", ["id"], F.col("price"), "b").count() == 0
