"""Boosted trees for ranked lists: LambdaRank's gradients, histograms of them, and trees grown level by level.

A session's list is one row, so that a round computes the gradients where the list lies. What a level of a tree needs of the
rows is the sum of gradients, weights and rows of each (leaf, feature, bin): one aggregation, combined before its shuffle, whose
result has leaves x features x bins rows at most, whatever the input. The best splits are found in that on the driver.
Gradients are whole numbers of 2^-30, so their sums, and with them the trees, don't depend on how rows are partitioned.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.tables import stored

UNIT = float(1 << 30)
#: A list that is longer is dealt to lists of about this size: gradients take time by its square.
LONGEST = 512
#: Trees that are applied on the fly before the scores are stored again.
TREES_ON_THE_FLY = 8


@dataclass(frozen=True)
class Growth:
    """How trees grow: a split needs `least` rows and LEAST_WEIGHT of weight on both sides; bins are a feature's quantiles."""

    rounds: int = 300
    leaves: int = 15
    depth: int = 6
    rate: float = 0.05
    least: int = 5
    bins: int = 64
    watched: float = 0.2
    patience: int = 20
    k: int = 10


# Fixed value: the weight below which a side of a split doesn't count.
LEAST_WEIGHT = 1e-3


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1.0


def _discount(place: Column) -> Column:
    return 1.0 / F.log2(place + 1.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _ideal(items: Column, k: int | None = None) -> Column:
    """DCG of the items' labels in their best order, of the first k places where k is given."""
    labels = F.reverse(F.array_sort(F.transform(items, lambda x: x["label"])))
    labels = labels if k is None else F.slice(labels, 1, k)
    return _total(F.transform(labels, lambda v, i: _gain(v) * _discount(i + 1.0)))


def _in_order(items: Column, score) -> Column:
    """Items by score, high first, ties by item."""
    keyed = F.transform(items, lambda x: F.struct((-score(x)).alias("key"), x["item"].alias("item"), x.alias("x")))
    return F.array_sort(keyed)


def listed(rows: DataFrame, carried: list[Column], longest: int = LONGEST) -> DataFrame:
    """(session, ideal, items): rows(session, item, label, ...) as one row a list; items have item, label, score and what is carried.

    A null label counts as 0, rows without session or item are left out, and repeated rows are items of their own. A session of
    over `longest` rows is dealt by a hash of its items to lists of about that size, so none is one task's burden. Lists whose
    labels are all 0 are left out: no order of theirs is better than another.
    """
    known = rows.where("session is not null and item is not null")
    sizes = known.groupBy("session").agg(F.count("*").alias("_n")).where(F.col("_n") > longest)
    part = F.pmod(F.xxhash64("item"), F.coalesce(F.ceil(F.col("_n") / longest), F.lit(1))).alias("_part")
    label = F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label")
    item = F.struct("item", label, F.coalesce("score", F.lit(0.0)).alias("score"), *carried)
    dealt = known.join(sizes, "session", "left").select("session", part, item.alias("x"))
    lists = dealt.groupBy("session", "_part").agg(F.collect_list("x").alias("items")).drop("_part")
    return lists.withColumn("ideal", _ideal(F.col("items"))).where("ideal > 0")


def pulled(lists: DataFrame) -> DataFrame:
    """(session, x, gradient, weight): LambdaRank's of NDCG over each whole list of listed(), an item a row.

    Each pair of items of unlike labels pulls by the sigmoid of their scores times what swapping their places would change.
    """
    ordered = lists.select("session", "ideal", _in_order(F.col("items"), lambda x: x["score"]).alias("sorted"))
    placed = ordered.select("session", "ideal", F.transform("sorted", lambda s, i: F.struct(
        s["x"].alias("x"), s["x"]["label"].alias("label"), s["x"]["score"].alias("score"),
        _gain(s["x"]["label"]).alias("gain"), _discount(i + 1.0).alias("discount"))).alias("all"))

    def pair(x: Column, y: Column) -> Column:
        change = F.abs((x["gain"] - y["gain"]) * (x["discount"] - y["discount"])) / F.col("ideal")
        up = x["label"] > y["label"]
        rho = 1.0 / (1.0 + F.exp(F.when(up, x["score"] - y["score"]).otherwise(y["score"] - x["score"])))
        moved = F.struct((F.when(up, rho).otherwise(-rho) * change).alias("g"), (rho * (1.0 - rho) * change).alias("h"))
        return F.when(x["label"] == y["label"], F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))).otherwise(moved)

    def pulls(x: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))
        return F.aggregate("all", none, lambda a, y: F.transform(F.array(pair(x, y)), lambda p: F.struct(
            (a["g"] + p["g"]).alias("g"), (a["h"] + p["h"]).alias("h")))[0])

    each = placed.select("session", F.explode(F.transform("all", lambda x: F.struct(x["x"].alias("x"), pulls(x).alias("p")))).alias("e"))
    return each.select("session", "e.x", F.col("e.p.g").alias("gradient"), F.col("e.p.h").alias("weight"))


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """The values that bins of each feature end at, at most bins - 1 of them, from one aggregation; equal values share a bin."""
    shares = [i / bins for i in range(1, bins)]
    aggs = [F.percentile_approx(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), shares).alias(f) for f in features]
    tops = [F.max(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"_top_{f}") for f in features]
    r = rows.agg(*aggs, *tops).first()
    return [sorted({x for x in r[f] or () if x < r[f"_top_{f}"]}) for f in features]


def binned(features: list[str], cuts: list[list[float]]) -> Column:
    """bins array<int>: for each feature the number of cuts under its value; a null counts as 0."""
    def of(f: str, own: list[float]) -> Column:
        if not own:
            return F.lit(0)
        value = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return F.size(F.filter(F.lit(own), lambda c: c < value))

    return F.array(*[of(f, own) for f, own in zip(features, cuts, strict=True)]).alias("bins")


class Tree:
    """Splits as (feature, bin) with children; a child under 0 is leaf ~child. Values up to the bin's end go left."""

    def __init__(self) -> None:
        self.split: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.gains: list[float] = []
        self.values: list[float] = [0.0]

    def leaf(self, bins: Column) -> Column:
        """The number of the leaf that an item's bins lead to."""
        def node(i: int) -> Column:
            if i < 0:
                return F.lit(~i)
            (feature, last), (left, right) = self.split[i], self.children[i]
            return F.when(bins[feature] <= last, node(left)).otherwise(node(right))

        return node(0 if self.split else -1)

    def value(self, bins: Column) -> Column:
        def node(i: int) -> Column:
            if i < 0:
                return F.lit(self.values[~i])
            (feature, last), (left, right) = self.split[i], self.children[i]
            return F.when(bins[feature] <= last, node(left)).otherwise(node(right))

        return node(0 if self.split else -1)

    def divide(self, leaf: int, feature: int, last: int, gain: float) -> int:
        """Splits a leaf; it stays the left side, and the number of the right side is given back."""
        me, new = len(self.split), len(self.values)
        for pair in self.children:
            for side in (0, 1):
                if pair[side] == ~leaf:
                    pair[side] = me
        self.split.append((feature, last))
        self.children.append([~leaf, ~new])
        self.gains.append(gain)
        self.values.append(0.0)
        return new

    def plain(self, cuts: list[list[float]]) -> dict:
        """In the terms of a text dump: split_feature, threshold, left_child, right_child, leaf_value."""
        return {
            "split_feature": [float(f) for f, _ in self.split], "threshold": [cuts[f][b] for f, b in self.split],
            "left_child": [float(a) for a, _ in self.children], "right_child": [float(b) for _, b in self.children],
            "leaf_value": list(self.values), "split_gain": list(self.gains),
        }


def best_split(histogram: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) from a leaf's histogram[3, feature, bin] of gradient, weight and rows in whole
    numbers; ties go to the first feature, then the first bin. None where no split gains."""
    left = np.cumsum(histogram, axis=2)[:, :, :-1]
    whole = histogram[:, :1, :].sum(axis=2, keepdims=True)
    right = whole - left
    (gl, hl, nl), (gr, hr, nr) = left, right
    fits = (nl >= least) & (nr >= least) & (hl >= LEAST_WEIGHT * UNIT) & (hr >= LEAST_WEIGHT * UNIT)
    if not fits.any():
        return None
    square = lambda g, h: (g / UNIT) ** 2 / np.maximum(h / UNIT, LEAST_WEIGHT / 2)
    gains = np.where(fits, square(gl, hl) + square(gr, hr) - square(whole[0], whole[1]), -np.inf)
    at = int(gains.argmax())
    feature, last = divmod(at, gains.shape[1])
    return (float(gains[feature, last]), feature, last) if gains[feature, last] > 1e-12 else None


def _histograms(rows: DataFrame, tree: Tree, wanted: list[int], features: int, bins: int) -> dict[int, np.ndarray]:
    """The histograms of the wanted leaves over rows(bins, g, h): one aggregation, whose result is bounded by its keys."""
    at = rows.select(tree.leaf(F.col("bins")).alias("leaf"), "g", "h", "bins").where(F.col("leaf").isin(wanted))
    each = at.select("leaf", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    sums = each.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    found = {leaf: np.zeros((3, features, bins), dtype=np.int64) for leaf in wanted}
    for r in sums.collect():
        found[r["leaf"]][:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    return found


def grow(rows: DataFrame, features: int, bins: int, how: Growth) -> Tree:
    """A tree on rows(bins, g, h). On each level the leaves that gain most are split first, up to how.leaves of them.

    Only the side with fewer rows is aggregated; the other is what is left of the leaf's own histogram, exactly, as sums are whole
    numbers. A leaf's value is a Newton step times the rate.
    """
    tree = Tree()
    held = _histograms(rows, tree, [0], features, bins)
    level = [0]
    for depth in range(how.depth):
        found = [(leaf, best_split(held[leaf], how.least)) for leaf in level]
        chosen = sorted(((s, leaf) for leaf, s in found if s), key=lambda c: (-c[0][0], c[1]))[: how.leaves - len(tree.values)]
        level, asked = [], []
        for (gain, feature, last), leaf in chosen:
            new = tree.divide(leaf, feature, last, gain)
            left, right = held[leaf][2, feature, : last + 1].sum(), held[leaf][2, feature, last + 1 :].sum()
            asked.append((leaf, new) if left <= right else (new, leaf))
            level += [leaf, new]
            own = held[leaf][:, feature, :]
            for side, part in ((leaf, own[:, : last + 1]), (new, own[:, last + 1 :])):
                g, h = part[0].sum() / UNIT, part[1].sum() / UNIT
                tree.values[side] = float(how.rate * g / h)
        if not level or len(tree.values) >= how.leaves or depth + 1 == how.depth:
            break
        # the last level's sums of both sides are known from their parents, so only leaves that may be split again are read
        small = _histograms(rows, tree, [few for few, _ in asked], features, bins)
        for few, many in asked:
            whole = held[min(few, many)]
            held[few], held[many] = small[few], whole - small[few]
    return tree


def mean_ndcg(lists: DataFrame, k: int) -> float:
    """Mean NDCG of the first k places over the lists of listed(); 0 where there is none."""
    ordered = lists.select(_in_order(F.col("items"), lambda x: x["score"]).alias("sorted"), _ideal(F.col("items"), k).alias("best"))
    first = F.slice(F.col("sorted"), 1, k)
    dcg = _total(F.transform(first, lambda s, i: _gain(s["x"]["label"]) * _discount(i + 1.0)))
    return ordered.select((dcg / F.col("best")).alias("v")).agg(F.avg("v")).first()[0] or 0.0


def _advanced(lists: DataFrame, trees: list[Tree]) -> DataFrame:
    """The lists with the trees' values added to the scores."""
    if not trees:
        return lists

    def on(x: Column) -> Column:
        score = x["score"]
        for t in trees:
            score = score + t.value(x["bins"])
        return F.struct(x["item"].alias("item"), x["label"].alias("label"), score.alias("score"), x["bins"].alias("bins"))

    return lists.withColumn("items", F.transform("items", on))


@dataclass
class Boosted:
    """Trees in plain terms and the NDCG on the watched sessions after each round (empty where none were watched)."""

    features: list[str]
    trees: list[dict]
    watched: list[float]

    def importance(self, top: int = 6) -> list[tuple[str, float]]:
        """Each feature's share of all gains."""
        sums = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(sums, np.array(t["split_feature"], dtype=int), t["split_gain"])
        return sorted(zip(self.features, (sums / max(sums.sum(), 1e-12)).tolist(), strict=True), key=lambda x: -x[1])[:top]

    def save(self, spark: SparkSession, path: str, version: int) -> None:
        rows = [(i, json.dumps(t)) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, splits string").coalesce(1).write.mode("overwrite").json(f"{path}/trees")
        about = [(self.features, self.watched, len(self.trees), version)]
        spark.createDataFrame(about, "features array<string>, watched array<double>, trees int, feature_version int").write.mode("overwrite").json(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        about = spark.read.schema("features array<string>, watched array<double>").json(f"{path}/model").first()
        rows = spark.read.schema("tree int, splits string").json(f"{path}/trees").orderBy("tree").collect()
        return Boosted(about["features"], [json.loads(r["splits"]) for r in rows], about["watched"] or [])


def boost(rows: DataFrame, features: list[str], how: Growth = Growth()) -> Boosted:
    """LambdaRank on rows(session, item, label, features...): the trees up to the round whose NDCG on watched sessions is best.

    A share `watched` of the sessions, chosen by a hash, isn't learned from; training ends once `patience` rounds in a row haven't
    beaten the best (0 watches none and makes all rounds). It ends too when no leaf can be split. Rows are shuffled once, to
    their sessions; a round then keeps its gradients for the levels of one tree, and every TREES_ON_THE_FLY rounds the lists are
    stored with their scores, so what is lost with an executor is made again from there. Null features and labels count as 0, rows
    without session or item are left out. Without rows or without unlike labels there are no trees.
    """
    rows = rows.where("session is not null and item is not null")
    cuts = quantile_cuts(rows, features, how.bins)
    at = F.pmod(F.xxhash64("session", F.lit("watched")), F.lit(1 << 20)) < int(how.watched * (1 << 20))
    plain = rows.withColumn("score", F.lit(0.0))
    lists = stored(listed(plain, [binned(features, cuts)]).withColumn("apart", at), "lists")
    trees: list[Tree] = []
    recent: list[Tree] = []
    watched: list[float] = []
    watching = how.watched > 0 and bool(lists.where("apart").limit(1).count())
    for _ in range(how.rounds):
        now = _advanced(lists, recent)
        whole = lambda c: F.round(F.col(c) * UNIT).cast("long")
        pulls = pulled(now.where("not apart")).select("x.bins", whole("gradient").alias("g"), whole("weight").alias("h"))
        pulls = pulls.persist(StorageLevel.MEMORY_AND_DISK)
        tree = grow(pulls, len(features), how.bins, how)
        pulls.unpersist()
        if not tree.split:
            break
        trees.append(tree)
        recent.append(tree)
        if watching:
            watched.append(mean_ndcg(_advanced(lists, recent).where("apart"), how.k))
            best = max(range(len(watched)), key=lambda i: (watched[i], -i))
            if len(watched) - 1 - best >= how.patience:
                break
        if len(recent) == TREES_ON_THE_FLY:
            lists, recent = stored(_advanced(lists, recent), "lists"), []
    kept = len(trees) if not watched else 1 + max(range(len(watched)), key=lambda i: (watched[i], -i))
    return Boosted(features, [t.plain(cuts) for t in trees[:kept]], watched)


def trees_sum(trees: list[dict], names: list[str]) -> Column:
    """The sum of the trees' leaves as one native expression; a child under 0 is leaf ~child, equal goes left, a null counts as 0."""

    def node(tree: dict, i: int) -> Column:
        if i < 0:
            return F.lit(tree["leaf_value"][~i])
        f = F.coalesce(F.col(names[int(tree["split_feature"][i])]), F.lit(0.0))
        low, high = int(tree["left_child"][i]), int(tree["right_child"][i])
        return F.when(f <= tree["threshold"][i], node(tree, low)).otherwise(node(tree, high))

    def added(some: list[dict]) -> Column:
        # by halves, so that the expression of many trees stays shallow
        if len(some) > 1:
            return added(some[: len(some) // 2]) + added(some[len(some) // 2 :])
        t = some[0]
        return node(t, 0) if t["split_feature"] else F.lit(t["leaf_value"][0])

    return added(trees) if trees else F.lit(0.0)
