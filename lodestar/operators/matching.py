"""The same product at several sources: known groups, price ranks, image and title matches, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import half_up, jaccard, title_tokens
from lodestar.operators import cells, ranges
from lodestar.operators.tables import cut, narrow, stored


#: Rows of a block's products looked through at once.
ROWS = 128


def known_groups(products: DataFrame) -> DataFrame:
    """(group_id, id): products that share a source_product_id with another; the group is named by it."""
    many = products.groupBy("source_product_id").agg(F.count("*").alias("n")).where("n > 1").select("source_product_id")
    return products.join(many, "source_product_id").select(F.concat(F.lit("g"), "source_product_id").alias("group_id"), "id")


def cheapest_of_groups(products: DataFrame) -> DataFrame:
    """(source_product_id, cheapest_price, group_size) of the products that share a source_product_id, as dedup_index has them: one aggregation, no ranks."""
    p = F.coalesce("price", F.lit(float("inf")))
    return products.groupBy("source_product_id").agg(F.min(p).alias("cheapest_price"), F.count("*").alias("group_size")).where("group_size > 1")


def dedup_index(products: DataFrame, groups: DataFrame, most: int = ranges.MOST) -> DataFrame:
    """(id, group_id, cheapest_id, cheapest_price, group_size, price_rank): group_size counts members without a product too.

    A group of over `most` products is ranked in ranges of its prices, see ranges.
    """
    p = F.coalesce("price", F.lit(float("inf")))
    every = groups.join(products.select("id", "price", F.lit(True).alias("there")), "id", "left").select("group_id", "id", p.alias("p"), "there")
    # size and cheapest are summed up before they are sent, and every member is read once for both
    sums = stored(every.groupBy("group_id").agg(F.count("*").alias("group_size"), F.min(F.when(F.col("there"), F.struct("p", "id"))).alias("best")), "groups")
    sizes = sums.select("group_id", F.col("group_size").alias("_n"))
    ranked = ranges.rank_in_groups(every.where("there").select("group_id", "id", "p"), "group_id", ["p", "id"], "price_rank", most, sizes)
    return ranked.join(sums, "group_id").select("id", "group_id", F.col("best.id").alias("cheapest_id"), F.col("best.p").alias("cheapest_price"), "group_size", "price_rank")


def similar_pairs(items: DataFrame, least: float, block: int = cells.BLOCK, most: int | None = None) -> DataFrame:
    """(x, y, similarity), both ways: items(id, category, v) of one category whose unit vectors' product is `least` or more.

    A category's vectors lie in blocks around pivots, as many of these as it has blocks (cells.PIVOTS at most); pairs of
    blocks that are too far apart for `least` are dropped on the blocks' numbers, and the vectors go only where a pair of
    blocks is left. No task holds a whole category, and a pair under `least` never becomes a row. most: of an item's pairs
    with the items of a block only so many of the greatest are wanted (ties: the lesser id), so rows follow the items and
    not their pairs. Items without a category are compared with each other; those without a direction with none.
    """
    rows = items.where("v is not null").select("id", F.coalesce(F.col("category").cast("string"), F.lit("")).alias("group"), "v")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    # where every category is one block there is nothing to leave out
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    wanted = min(cells.PIVOTS, math.ceil(largest / block))
    pivots = cells.fit_pivots(rows, wanted, "id") if wanted > 1 else np.zeros((0, 1))
    own = F.least(F.ceil(F.col("n") / block), F.lit(max(len(pivots), 1))).cast("int").alias("pivots")
    kind = cells._kind(rows)
    with narrow(items.sparkSession):
        blocks = stored(cells.packed(rows.join(sizes.select("group", own), "group"), pivots, kind), "blocks")
    pairs = cells.block_pairs(blocks, pivots, least).select("i", "j")
    part = blocks.select("block", "size", "ids", "m")
    both = pairs.join(part.withColumnsRenamed({"block": "i", "ids": "x", "m": "mx"}), "i").join(part.drop("size").withColumnsRenamed({"block": "j", "ids": "y", "m": "my"}), "j").select("i", "j", "size", "x", "mx", "y", "my")
    id_type = items.schema["id"].dataType.simpleString()
    return both.mapInArrow(_compared(kind, least, most), f"x {id_type}, y {id_type}, similarity double")


def _compared(kind: str, least: float, most: int | None):
    """Rows of two blocks each -> their pairs of `least` or more."""

    def apply(batches):
        for b in batches:
            for r in range(b.num_rows):
                i, j, size = (b.column(c)[r].as_py() for c in ("i", "j", "size"))
                x, y = b.column("x")[r].values, b.column("y")[r].values
                vx, vy = (np.frombuffer(b.column(c)[r].as_py(), kind).reshape(-1, size).astype(float) for c in ("mx", "my"))
                ids_x, ids_y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
                value = vx @ vy.T
                value *= 1e6
                value += 0.5
                np.floor(value, out=value)
                value /= 1e6
                if i == j:
                    np.fill_diagonal(value, -2)
                for rows, columns, v in ((ids_x, ids_y, value), (ids_y, ids_x, value.T))[: 1 if i == j else 2]:
                    # a few rows at a time: an entry is held several times
                    for at in range(0, len(rows), ROWS):
                        own, other, similarity = _greatest(rows[at : at + ROWS], columns, v[at : at + ROWS], least, most)
                        if len(own):
                            yield pa.RecordBatch.from_arrays([pa.array(own.tolist(), x.type), pa.array(other.tolist(), x.type), pa.array(similarity)], names=["x", "y", "similarity"])

    return apply


def title_pairs(titles: DataFrame, least: float) -> DataFrame:
    """(x, y, similarity), x < y: titles(id, t) whose sets of words t have a Jaccard similarity of `least` or more.

    Two such sets share one of the first |t| - ceil(least * |t|) + 1 words of each, in order from the rarest, so only these
    words are joined on: a frequent word hardly ever is one. Equal sets of words are joined once.
    """
    sets = titles.where(F.size("t") > 0).select("id", F.array_sort("t").alias("t"))
    kinds = sets.groupBy("t").agg(F.min("id").alias("kind"))
    counts = kinds.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rare = kinds.select("kind", "t", F.explode("t").alias("w")).join(counts, "w").groupBy("kind", "t").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ordered"))
    first = F.slice("ordered", 1, (F.size("t") - F.ceil(F.size("t") * least - 1e-9) + 1).cast("int"))
    heads = rare.select("kind", "t", F.explode(first).alias("h")).select("kind", "t", "h.w")
    x, y = heads.select(F.col("kind").alias("kx"), F.col("t").alias("tx"), "w"), heads.select(F.col("kind").alias("ky"), F.col("t").alias("ty"), "w")
    met = x.join(y, "w").where((F.col("kx") < F.col("ky")) & (F.least(F.size("tx"), F.size("ty")) >= F.greatest(F.size("tx"), F.size("ty")) * least)).select("kx", "ky", "tx", "ty").distinct()
    near = met.select("kx", "ky", half_up(jaccard(F.col("tx"), F.col("ty")), 6).alias("similarity")).where(F.col("similarity") >= least)
    own = sets.join(kinds, "t").select("kind", "id")
    across = near.join(own.select(F.col("kind").alias("kx"), F.col("id").alias("i")), "kx").join(own.select(F.col("kind").alias("ky"), F.col("id").alias("j")), "ky").select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "similarity")
    within = own.select("kind", F.col("id").alias("x")).join(own.select("kind", F.col("id").alias("y")), "kind").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def _greatest(rows: np.ndarray, columns: np.ndarray, value: np.ndarray, least: float, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, similarity) of the entries of `least` or more, the `most` greatest of each row."""
    order = np.argsort(columns, kind="stable")
    columns, value = columns[order], np.where(value[:, order] >= least, value[:, order], -2)
    if most is not None and value.shape[1] > most:
        order = np.argsort(-value, axis=1, kind="stable")[:, :most]
        columns, value = columns[order], np.take_along_axis(value, order, 1)
    else:
        columns = np.broadcast_to(columns, value.shape)
    at = value >= least
    return np.broadcast_to(rows[:, None], value.shape)[at], columns[at], value[at]


def match_pairs(items: DataFrame, least: float = 0.92, title: float = 0.35, neighbours: int = 10, price_ratio: float = 3.0) -> DataFrame:
    """(a, b, similarity): items of different sources and one category that look alike and agree otherwise.

    items(id, source, category, brand, name, price, gtin, v) with unit vectors. b is among a's `neighbours` nearest of the
    category (itself aside) and comes after a in order of id. Brand, code or title must agree and prices be within a ratio.
    """
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "y"))
    near = similar_pairs(items, least, most=neighbours).withColumn("place", place).where((F.col("place") <= neighbours) & (F.col("x") < F.col("y"))).select("x", "y", "similarity")
    with narrow(items.sparkSession):
        near = stored(near, "near")
    facts = items.select("id", "source", "brand", "name", "price", "gtin")
    both = near.join(facts.select(F.col("id").alias("x"), *[F.col(c).alias(f"{c}_x") for c in facts.columns[1:]]), "x").join(facts.select(F.col("id").alias("y"), *[F.col(c).alias(f"{c}_y") for c in facts.columns[1:]]), "y")
    same_code = F.coalesce(F.col("gtin_x") == F.col("gtin_y"), F.lit(False))
    same_brand = F.coalesce((F.lower(F.trim("brand_x")) == F.lower(F.trim("brand_y"))) & (F.trim("brand_x") != ""), F.lit(False))
    agree = same_code | same_brand | (jaccard(title_tokens(F.col("name_x")), title_tokens(F.col("name_y"))) >= title)
    low, high = F.least("price_x", "price_y"), F.greatest("price_x", "price_y")
    return both.where((F.col("source_x") != F.col("source_y")) & agree & (low > 0) & (high / low <= price_ratio)).select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")


def components(links: DataFrame) -> DataFrame:
    """(id, component) with the least id reachable over links(a, b): least labels spread and are followed until none changes."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(both["a"].alias("id")).agg(F.min("component").alias("least"))
        hop = labels.join(near, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(hop.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"), "old"))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def match_groups(links: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, id): components with members of more than one source, named by their least member."""
    named = components(links).join(items.select("id", "source"), "id")
    wide = named.groupBy("component").agg(F.min("source").alias("x"), F.max("source").alias("y")).where("x <> y").select("component")
    return named.join(wide, "component").select(F.concat(F.lit("match_"), "component").alias("group_id"), "id")
