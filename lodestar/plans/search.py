"""Whole searches over a stored catalogue: text and photo queries from retrieval to pages of explained results."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.intent import parse_queries
from lodestar.functions.vocabulary import CATEGORY_SYNONYMS
from lodestar.operators import matching as M
from lodestar.operators import ranking as K
from lodestar.operators import retrieval as R

# Weights of the keyword, dense and image lists, for text, and for callers that fuse a photo with text.
TEXT_WEIGHTS = [1.0, 1.0, 0.8]
PHOTO_TEXT_WEIGHTS = [0.8, 0.8, 1.2]
LIST = "query_id long, doc_id string, score double, rank int"


def run_retrievers(spark, branches: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], list[str]]:
    """The lists of all retrievers in order, and the names of those that failed: a failed one's list is empty.

    A branch is computed here and stored, so that its failure can't take the whole plan with it.
    """
    lists, failed = [], []
    for name, branch in branches.items():
        try:
            lists.append(M.cut(branch().select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))))
        except PySparkException as e:
            logging.getLogger(__name__).warning("%s retrieval failed: %s", name, e)
            failed.append(name)
            lists.append(spark.createDataFrame([], LIST))
    return lists, failed


def _asked(queries: DataFrame, explicit: DataFrame | None) -> DataFrame:
    """What queries(query_id, text) ask for, and the filters in force: explicit ones win over parsed ones."""
    parsed = parse_queries(queries).select("query_id", F.col("category").alias("q_category"), F.col("colors").alias("q_colors"), F.col("bindings").alias("q_bindings"), "max_price", "min_rating", F.col("size").alias("q_size"))
    none = {"x_category": "string", "x_min_price": "double", "x_max_price": "double", "x_min_rating": "double", "x_size": "string"}
    asked = parsed.join(explicit, "query_id", "left") if explicit is not None else parsed.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return K.resolve_filters(asked.withColumn("q_known", F.coalesce(F.col("q_category").isin(list(CATEGORY_SYNONYMS)), F.lit(False)))).withColumns({"max_price": F.col("f_max_price"), "min_rating": F.col("f_min_rating")})


def text_search(queries: DataFrame, catalog: DataFrame, lists: list[DataFrame], explicit: DataFrame | None = None, number: int = 1, size: int = 20, use_model=None, use_diversity: bool = True, use_filters: bool = True, images: DataFrame | None = None, weights: list[float] = TEXT_WEIGHTS) -> DataFrame:
    """A page of results for each of queries(query_id, text): parse, fuse, hydrate, score, diversify, filter, explain.

    catalog has the canonical columns and cheapest_price; lists are those of run_retrievers, fused by weights; explicit(query_id,
    x_category, x_min_price, x_max_price, x_min_rating, x_size) are filters that win over parsed ones; use_model is a score
    expression. images(query_id, doc_id, score) gives candidates that it knows their image score, others have 0.
    """
    asked = _asked(queries, explicit)
    fused = R.rrf(lists, weights).select("query_id", "doc_id", F.col("score").alias("rrf"), F.col("rank").alias("fused_rank"))
    rows = fused.join(catalog.withColumnsRenamed({"_id": "doc_id", "color": "colors"}), "doc_id").join(asked, "query_id")
    if images is not None:
        shown = images.select("query_id", "doc_id", F.col("score").alias("image_score"))
        rows = rows.drop("image_score").join(shown, ["query_id", "doc_id"], "left").na.fill(0.0, ["image_score"])
    elif "image_score" not in rows.columns:
        rows = rows.withColumn("image_score", F.lit(0.0))
    ranked = K.scored(K.with_features(rows), use_model)
    if use_diversity:
        order = K.diversified(ranked).select("query_id", "doc_id", "rank")
        ranked = ranked.drop("rank").join(order, ["query_id", "doc_id"])
    if use_filters:
        ranked = ranked.where(K.passes_filters(F.col("f_category"), F.col("f_min_price"), F.col("f_max_price"), F.col("f_min_rating"), F.col("f_size"), text=K.product_text(ranked)))
    return K.page(ranked, number, size).withColumn("why", K.explanations())


def photo_search(photos: DataFrame, catalog: DataFrame, vectors: DataFrame, explicit: DataFrame | None = None, number: int = 1, size: int = 20, k: int = 200) -> DataFrame:
    """A page of answers for each of photos(query_id, v, text): the k products nearest by cosine, the text's filters, a little for
    what else the text asks for, and nothing far below the best; see photo_ranked and responses.

    vectors(doc_id long, v) number the products by catalog.vec_id; text may be null. The ranking model has no part in this.
    """
    texts = photos.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    near = R.cosine_search(photos.select("query_id", "v"), vectors, k).select("query_id", F.col("doc_id").alias("vec_id"), F.col("score").alias("cosine"))
    rows = near.join(catalog.withColumnsRenamed({"_id": "doc_id", "color": "colors"}), "vec_id").join(_asked(texts, explicit), "query_id")
    has_text = texts.select("query_id", (F.trim("text") != "").alias("has_text"))
    ready = K.with_features(rows.withColumns({"rrf": F.col("cosine"), "image_score": F.col("cosine")}).join(has_text, "query_id"))
    passes = K.passes_filters(F.col("f_category"), F.col("f_min_price"), F.col("f_max_price"), F.col("f_min_rating"), F.col("f_size"), text=K.product_text(ready))
    return K.responses(K.page(K.photo_ranked(ready, passes=passes), number, size), visual=True)


def impressions(results: DataFrame, mode: str, model: str, at) -> DataFrame:
    """What was shown, as rows of the impression log."""
    return results.select("query_id", F.lit(mode).alias("mode"), "position", F.col("doc_id").alias("product_id"), F.array(*K.FEATURES).alias("features"), F.lit(K.FEATURE_VERSION).alias("feature_version"), F.lit(model).alias("model_version"), at.alias("timestamp"))
