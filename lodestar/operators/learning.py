"""Learning to rank: training groups, training, scoring by a dumped tree model, comparison with fusion, simulated data."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import tokens
from lodestar.operators import boosting
from lodestar.operators.feedback import ranking_measures
from lodestar.operators.ranking import FEATURE_VERSION, FEATURES


def train_ranker(groups: DataFrame, trees: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 7) -> GBTRegressionModel:
    """Boosted trees on groups(f1 to f12, label), pointwise; train_listwise has the listwise objective."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(groups.na.fill(0.0, FEATURES)).select("features", F.col("label").cast("double").alias("label"))
    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(rows)


def scored_by(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.na.fill(0.0, FEATURES))
    return model.transform(ready).withColumnRenamed("prediction", "score").drop("features")


class ListwiseModel:
    """Boosted trees for a listwise objective: the score is the sum of the trees' leaves."""

    def __init__(self, grown: boosting.Boosted):
        self.grown = grown

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with score, one native expression; null features count as 0."""
        return rows.withColumn("score", boosting.trees_sum(self.grown.trees, self.grown.features))

    def save(self, spark: SparkSession, path: str) -> None:
        self.grown.save(spark, path, FEATURE_VERSION)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ListwiseModel:
        return ListwiseModel(boosting.Boosted.load(spark, path))

    def importance(self, top: int = 6) -> list[tuple[str, float]]:
        return self.grown.importance(top)


def pair_gradients(rows: DataFrame) -> DataFrame:
    """rows(session, item, label, score, ...) with gradient and weight: LambdaRank's, of NDCG over the whole list, see boosting."""
    each = boosting.pulled(boosting.listed(rows, []))
    return rows.join(each.select("session", "x.item", "gradient", "weight"), ["session", "item"])


def train_listwise(groups: DataFrame, rounds: int = 300, depth: int = 6, rate: float = 0.05, **growth) -> ListwiseModel:
    """LambdaRank on groups(session, item, label, f1 to f12) by gradient histograms, ended by watched sessions; see boosting.Growth."""
    return ListwiseModel(boosting.boost(groups, list(FEATURES), boosting.Growth(rounds=rounds, depth=depth, rate=rate, **growth)))


def training_mix(mode: str, synthetic: DataFrame, feedback: DataFrame) -> DataFrame:
    """Training rows of a mode: hybrid (both), feedback (synthetic ones where there is none) or synthetic; label_source tells which."""
    if mode not in ("hybrid", "feedback", "synthetic"):
        raise ValueError(f"unknown training mode {mode!r}")
    made, seen = synthetic.withColumn("label_source", F.lit("synthetic")), feedback.withColumn("label_source", F.lit("feedback"))
    if mode == "synthetic" or mode == "feedback" and feedback.isEmpty():
        return made
    return seen if mode == "feedback" else made.unionByName(seen)


def rule_grades(pairs: DataFrame) -> DataFrame:
    """pairs with label 0 to 3 by rule: 3 for category and colour met, 2 for the category, 1 for the colour; needs f2 and f3."""
    return pairs.withColumn("label", F.when((F.col("f2") > 0) & (F.col("f3") > 0), 3).when(F.col("f2") > 0, 2).when(F.col("f3") > 0, 1).otherwise(0))


def save_if_better(spark: SparkSession, model: ListwiseModel, path: str, new: float | None, old: float | None, report: DataFrame, force: bool = False) -> bool:
    """Saves a model and its report where it is better than what is there, or forced; whether it did."""
    if not better(new, old, force):
        return False
    model.save(spark, path)
    report.write.mode("overwrite").json(f"{path}/report")
    return True


def importance(model: GBTRegressionModel, top: int = 6) -> list[tuple[str, float]]:
    return sorted(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]


def compared_orders(rows: DataFrame, k: int = 10) -> DataFrame:
    """(ordering, ndcg): mean over sessions of rows(session, item, label, position, f1, and columns named score_...) of shown order, fusion and each score; equal values keep the shown order."""
    orders = {"shown": F.col("position").cast("double"), "fusion": -F.col("f1")} | {c: -F.col(c) for c in rows.columns if c.startswith("score_")}
    judged = rows.select(F.col("session").alias("query_id"), F.col("item").alias("doc_id"), F.col("label").alias("rel"))
    out = None
    for name, key in orders.items():
        order = Window.partitionBy("session").orderBy(key, "position")
        ranked = rows.select(F.col("session").alias("query_id"), F.col("item").alias("doc_id"), F.row_number().over(order).alias("rank"))
        one = ranking_measures(ranked, judged, k).agg(F.avg("ndcg").alias("ndcg")).select(F.lit(name).alias("ordering"), "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


def worth_training(sessions: DataFrame, least: int = 30, force: bool = False) -> bool:
    """Whether there are enough usable sessions to train on."""
    return force or sessions.select("session").distinct().limit(least).count() >= least


def better(new: float | None, old: float | None, force: bool = False) -> bool:
    """Whether a new model goes live: only if it is better than what is there, unless forced."""
    return force or (new is not None and (old is None or new > old))


def parse_trees(dump: str) -> list[dict]:
    """Trees of a boosted model's text dump: each block has num_leaves, split_feature, threshold, left_child, right_child, leaf_value."""
    trees = []
    for block in dump.split("\nTree=")[1:]:
        given = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
        numbers = {k: [float(x) for x in given.get(k, "").split()] for k in ("split_feature", "threshold", "left_child", "right_child", "leaf_value")}
        trees.append(numbers)
    return trees


def tree_score(trees: list[dict], names: list[str] = FEATURES) -> Column:
    """The sum of the trees' leaves as one native expression; a child under 0 is leaf ~child, equal goes left, a null counts as 0."""
    return boosting.trees_sum(trees, names)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A unit vector of hashed word counts: a stand-in where no text encoder is to be had; zero for a text without words."""
    cells = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    # one-element arrays bind a value to a name, so that it is worked out once
    counts = F.transform(F.array(cells), lambda cs: F.transform(places, lambda i: F.size(F.filter(cs, lambda c: c == i)).cast("double")))
    normed = F.transform(counts, lambda xs: F.struct(xs.alias("xs"), F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    return F.transform(normed, lambda s: F.transform(s["xs"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0).cast("float")))[0]


def unit_hash(*columns) -> Column:
    """A number from 0 to under 1 that depends on the given columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)).cast("double") / float(1 << 30)


def synthetic_catalog(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n products whose values follow from their number and a seed: equal on every run and at any parallelism."""
    s = F.lit(seed)

    def pick(values: list[str], salt: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (unit_hash("id", s, F.lit(salt)) * len(values) + 1).cast("int"))

    rows = spark.range(n).withColumns({"category": pick(["saree", "kurta", "shirt", "jeans", "dress", "shoes"], "c"), "color": pick(["red", "blue", "black", "white", "green"], "k"), "brand": pick(["Asha", "Nila", "Roha", "Tara"], "b"), "source": pick(["a", "b", "c"], "s")})
    price = F.floor(300 + unit_hash("id", s, F.lit("p")) * 4700)
    return rows.withColumns({"price": price.cast("double"), "mrp": F.floor(price * (1 + unit_hash("id", s, F.lit("m")))).cast("double"), "rating": F.floor(unit_hash("id", s, F.lit("r")) * 50) / 10.0, "in_stock": unit_hash("id", s, F.lit("i")) < 0.9, "name": F.concat_ws(" ", "brand", F.initcap("color"), F.initcap("category"))}).withColumn("_id", F.concat_ws("_", "source", "id"))


def cross_source_copies(products: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """products and, for a share of them, a copy at another source with a price 0.85 to 1.15 times as high."""
    s = F.lit(seed)
    copies = products.where(unit_hash("_id", s) < share).withColumns({"source": F.concat("source", F.lit("x")), "price": F.floor(F.col("price") * (0.85 + 0.3 * unit_hash("_id", s, F.lit("f")))).cast("double"), "_id": F.concat(F.lit("dup_"), "_id")})
    return products.unionByName(copies)


def simulated_clicks(shown: DataFrame, seed: int = 42) -> DataFrame:
    """shown(session, product, position, rel) with clicked: likelier high up and for relevant items, by a hash of session and place."""
    chance = (0.15 + 0.25 * F.col("rel")) / F.log2(F.col("position") + 2.0)
    return shown.withColumn("clicked", unit_hash("session", "position", F.lit(seed)) < chance)


def variants(lists: dict[str, DataFrame], fuse, rank) -> dict[str, DataFrame]:
    """Six pipelines to compare: each retriever alone, their fusion, re-ranked, diversified, and both with filters.

    lists has keyword and dense; fuse(lists) gives a fused list, rank(fused, model, diversity, filters) a result.
    """
    fused = fuse([lists["keyword"], lists["dense"]])
    return {
        "keyword": lists["keyword"], "dense": lists["dense"], "fusion": fused, "model": rank(fused, True, False, False),
        "model_diverse": rank(fused, True, True, False), "full": rank(fused, True, True, True),
    }
