"""Registered queries on learning to rank and simulated data. Those that SQL can't express are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import half_up
from lodestar.operators import feedback as E
from lodestar.operators import learning as L
from lodestar.operators import ranking as K
from lodestar.operators import retrieval as R
from lodestar.operators.matching import cut
from lodestar.plans import ranking as P
from lodestar.plans import views as V

DUMP = """tree
version=v4

Tree=0
num_leaves=3
split_feature=1 3
threshold=0.5 0.8
left_child=-1 -2
right_child=1 -3
leaf_value=0.1 0.35 0.6

Tree=1
num_leaves=2
split_feature=4
threshold=0.55
left_child=-1
right_child=-2
leaf_value=-0.05 0.07
"""


def r14_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a dumped model's score, ties in fused order."""
    rows = K.with_features(P.candidates(spark, sf_dir))
    return K.scored(rows, half_up(L.tree_score(L.parse_trees(DUMP)), 6)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def labelled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-above groups of impressions with 12 features made of the events themselves."""
    shown = E.skip_above(V.impressions(spark, sf_dir))
    zero = {f"f{i}": F.lit(0.0) for i in range(1, 13)}
    made = {"f1": 1.0 / (60 + F.col("position")), "f4": F.coalesce("value", F.lit(0.0)) / 100.0, "f5": L.unit_hash("event_id", F.lit("r")), "f2": F.when(F.col("clicked"), L.unit_hash("event_id", F.lit("c"))).otherwise(L.unit_hash("event_id", F.lit("c")) * 0.7)}
    return shown.withColumns(zero | made)


def e04_train_and_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG on the newest fifth of the sessions of four orders: as shown, by fusion, by the model in use (pointwise) and by a listwise one; both are trained on the rest, the latter until a fifth of it stops gaining."""
    rows = cut(labelled_sessions(spark, sf_dir).withColumn("item", F.col("event_id")))
    newest = E.newest_held_out(rows.groupBy("session").agg(F.max("event_id").alias("newest")), 0.2, "newest").select("session", "held_out")
    split = cut(rows.join(newest, "session"))
    learned = split.where("not held_out")
    current, listwise = L.train_ranker(learned, trees=8, depth=3), L.train_listwise(learned, rounds=12, rate=0.2, patience=3)
    tested = L.scored_by(current, split.where("held_out")).withColumnRenamed("score", "score_current")
    return L.compared_orders(listwise.transform(tested).withColumnRenamed("score", "score_new")).select("ordering", half_up(F.col("ndcg"), 6).alias("ndcg"))


def r04_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest distinct names of parts by hashed word vectors."""
    names = V.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("doc_id")).select("doc_id", L.hashed_embedding(F.col("p_name")).alias("v"))
    names = cut(names)
    return R.cosine_search(names.select(F.col("doc_id").alias("query_id"), "v"), names, 3)


def e17_click_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.impressions(spark, sf_dir).select("session", F.col("event_id").alias("product"), "position", F.col("label").alias("rel"))
    return L.simulated_clicks(rows).groupBy("rel").agg(F.count("*").alias("shown"), F.count_if("clicked").alias("clicked"))


def src24_synthetic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many products as there are parts, with copies at other sources."""
    n = V.table(spark, sf_dir, "part").count()
    return L.cross_source_copies(L.synthetic_catalog(spark, n)).groupBy("source").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


def r20_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of six pipelines over the shopping queries, by rule judgments."""
    # the listings are indexed and searched once, for the single lists and for the candidates
    listing, asked, found = P.retrieved(spark, sf_dir)
    lists = dict(zip(("keyword", "dense"), map(cut, found), strict=True))
    rows = cut(K.with_features(P.candidates_of(listing, asked, list(lists.values()))))

    def rank(fused: DataFrame, model: bool, diverse: bool, filters: bool) -> DataFrame:
        scored = K.scored(rows, half_up(L.tree_score(L.parse_trees(DUMP)), 6) if model else None)
        if filters:
            scored = scored.where(K.passes_filters(F.col("q_category"), F.lit(None).cast("double"), F.col("max_price"), F.col("min_rating"), F.col("q_size")))
        return K.diversified(scored) if diverse else scored.select("query_id", "doc_id", "score", "rank")

    found = L.variants(lists, lambda two: R.rrf(two, [1.0, 0.8]), rank)
    cat, col = F.coalesce(F.contains("name", "q_category"), F.lit(False)), F.coalesce(F.contains("color", F.get("q_colors", F.lit(0))), F.lit(False))
    judged = rows.select("query_id", "doc_id", F.when(cat & col, 3).when(cat, 2).when(col, 1).otherwise(0).alias("rel")).where("rel > 0")
    out = None
    for name, one in found.items():
        mean = E.ranking_measures(one.select("query_id", "doc_id", "rank"), judged, 10).agg(F.lit(name).alias("variant"), half_up(F.avg("ndcg"), 6).alias("ndcg"))
        out = mean if out is None else out.unionByName(mean)
    return out


QUERIES = [r14_tree_score, e04_train_and_compare, r04_hashed_embedding, e17_click_simulation, src24_synthetic_catalog, r20_ablation]
SQL = {
    "r14_tree_score": f"""with {P.CANDIDATES_SQL}, s as (select query_id, doc_id, fused_rank, floor(((case when f2 <= 0.5e0 then 0.1e0 when f4 <= 0.8e0 then 0.35e0 else 0.6e0 end) + (case when f5 <= 0.55e0 then -0.05e0 else 0.07e0 end)) * 1e6 + 0.5e0) / 1e6 as score from feat2)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, fused_rank) as rank from s""",
}
