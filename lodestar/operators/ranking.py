"""From fused candidates to pages of results: features, scores, source diversity, filters, explanations.

Candidates are a DataFrame with a row for each query and product; columns of the query begin with q_ (or are max_price,
min_rating), the rest are the product's. Filters come after ranking, so a page may be short although more products match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import category_matches, half_up, size_available

FEATURES = [f"f{i}" for i in range(1, 13)]
FEATURE_VERSION = 2


def price_match(price: Column, most: Column) -> Column:
    """1 without a limit, 0 over it, else less by up to 0.3 the nearer the limit."""
    p = F.coalesce(price, F.lit(0.0))
    return F.when(most.isNull() | (most == 0), F.lit(1.0)).when(p > most, F.lit(0.0)).otherwise(1.0 - 0.3 * (p / most))


def competitiveness(price: Column, cheapest: Column) -> Column:
    """The cheapest price of the product's group over its own, at most 1; 0.5 where either is unknown or not positive."""
    return F.when(price.isNull() | cheapest.isNull() | (price <= 0) | (cheapest <= 0), F.lit(0.5)).otherwise(F.least(cheapest / price, F.lit(1.0)))


def product_text(products: DataFrame) -> Column:
    """What a free-form category is looked for in: subcategory, category, name and tags, as far as the table has them."""
    return F.concat_ws(" ", *[c for c in ("subcategory", "category", "name", "tags") if c in products.columns])


def with_features(candidates: DataFrame) -> DataFrame:
    """candidates with f1 to f12; needs rrf, q_category, q_colors, q_bindings, max_price, name, category, colors, tags, price,
    rating, review_count, discount_percent, in_stock, image_score, cheapest_price. Nulls count as absent values."""
    c = F.col
    colors = F.transform(F.coalesce("colors", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    asked = F.transform(F.coalesce("q_colors", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    named = c("q_category").isNotNull() & (F.trim("q_category") != "")
    text = product_text(candidates)
    category = F.when(named & category_matches(c("q_category"), c("category"), text), F.lit(1.0)).otherwise(0.0)
    attributes = F.when(named, 1).otherwise(0) + F.size(asked)
    met = category + F.size(F.filter(asked, lambda q: F.exists(colors, lambda p: F.contains(p, q))))
    bindings = F.map_entries(F.coalesce("q_bindings", F.create_map().cast("map<string,string>")))
    body = F.lower(F.concat_ws(" ", "name", "tags"))
    bound = F.size(F.filter(bindings, lambda b: F.contains(body, b["key"]) & F.exists(colors, lambda p: F.contains(p, b["value"]))))
    values = [
        c("rrf"), category, F.when(F.arrays_overlap(asked, colors), 1.0).otherwise(0.0), price_match(c("price"), c("max_price")), F.coalesce("rating", F.lit(0.0)) / 5.0,
        F.least(F.coalesce(c("review_count").cast("double"), F.lit(0.0)) / 1000.0, F.lit(1.0)), F.coalesce(c("discount_percent").cast("double"), F.lit(0.0)) / 100.0,
        F.when(F.coalesce("in_stock", F.lit(True)), 1.0).otherwise(0.0), F.coalesce("image_score", F.lit(0.0)), F.when(attributes == 0, F.lit(0.5)).otherwise(met / attributes),
        F.when(F.size(bindings) == 0, F.lit(1.0)).otherwise(bound / F.size(bindings)), competitiveness(c("price"), c("cheapest_price")),
    ]
    return candidates.withColumns({name: half_up(v, 9) for name, v in zip(FEATURES, values, strict=True)})


def scored(features: DataFrame, score: Column | None = None) -> DataFrame:
    """rank by a model's score, or by f1 where there is none; ties keep the fused order."""
    value = F.col("f1") if score is None else F.coalesce(score, F.col("f1"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return features.withColumn("score", value).withColumn("rank", F.row_number().over(order))


def resolve_filters(intents: DataFrame) -> DataFrame:
    """Explicit filters (x_...) win over parsed ones; a parsed category counts only if it is a known one; a least price is explicit only."""
    return intents.withColumns({
        "f_category": F.coalesce("x_category", F.when(F.col("q_known"), F.col("q_category"))), "f_max_price": F.coalesce("x_max_price", "max_price"),
        "f_min_price": F.col("x_min_price"), "f_min_rating": F.coalesce("x_min_rating", "min_rating"), "f_size": F.coalesce(F.nullif("x_size", F.lit("")), "q_size"),
    })


def passes_filters(category: Column, least: Column, most: Column, rating: Column, size: Column, in_stock_only: bool = True, text: Column | None = None) -> Column:
    """The conjunction of all filters; a null filter lets everything pass, a null price or rating counts as 0, null stock as in stock.

    text: product_text() of the table; category and name without it.
    """
    price = F.coalesce(F.col("price"), F.lit(0.0))
    text = F.concat_ws(" ", "category", "name") if text is None else text
    stock = F.coalesce("in_stock", F.lit(True)) if in_stock_only else F.lit(True)
    return (
        category_matches(category, F.col("category"), text) & F.coalesce(price >= least, F.lit(True)) & F.coalesce(price <= most, F.lit(True))
        & F.coalesce(F.coalesce(F.col("rating"), F.lit(0.0)) >= rating, F.lit(True)) & stock & size_available(size, F.col("sizes"), F.col("available_sizes"))
    )


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of each query's filtered results with their total; position counts from 0 over all pages."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    total = F.count("*").over(Window.partitionBy("query_id"))
    return ranked.withColumns({"position": position.cast("long"), "total": total}).where(F.col("position").between((number - 1) * size, number * size - 1))


def diversified(ranked: DataFrame, strength: float = 0.3, most_per_source: int = 0) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's list reordered so that no source crowds the top.

    At each place a candidate's score is lessened by strength times what its source already has beyond a fair share; the
    first greatest is taken. Sources at most_per_source (0: no limit) come after all others. A query's list is what fusion
    left, 100 rows at most, so a group is bounded.
    """

    def reorder(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        source, score = rows["source"].fillna("unknown").to_numpy(), rows["score"].to_numpy(float)
        fair = 1 / max(1, len(set(source)))
        placed: dict[str, int] = {}
        left, out = list(range(len(rows))), []
        while left:
            if strength <= 0:
                out += left
                break
            shares = [max(0.0, placed.get(source[i], 0) / max(len(out), 1) - fair) if out else 0.0 for i in left]
            worth = [float("-inf") if most_per_source and placed.get(source[i], 0) >= most_per_source else score[i] - s * strength * score[i] for i, s in zip(left, shares, strict=True)]
            i = left.pop(worth.index(max(worth)))
            placed[source[i]] = placed.get(source[i], 0) + 1
            out.append(i)
        rows = rows.loc[out, ["query_id", "doc_id", "score"]]
        return rows.assign(rank=range(1, len(out) + 1))

    return ranked.select("query_id", "doc_id", "source", "score", "rank").groupBy("query_id").applyInPandas(reorder, "query_id long, doc_id string, score double, rank long")


def photo_ranked(candidates: DataFrame, near: float = 0.20, least: int = 8, passes: Column | None = None) -> DataFrame:
    """Image search: score = cosine, with text also 0.04 for each of category and colour met; in order of score, then cosine.

    Rows that don't pass go first. Of the rest those are kept whose cosine is within `near` of the best cosine, or the
    first `least` where fewer are. Needs query_id, doc_id, cosine, has_text, f2, f3.
    """
    score = F.col("cosine") + F.when(F.col("has_text"), 0.04 * (F.col("f2") + F.col("f3"))).otherwise(0.0)
    own = Window.partitionBy("query_id")
    left = candidates if passes is None else candidates.where(passes)
    rows = left.withColumn("score", half_up(score, 6)).withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), F.desc("cosine"), "doc_id")))
    close = F.col("cosine") >= half_up(F.max("cosine").over(own) - near, 9)
    marked = rows.withColumn("close", close).withColumn("n_close", F.count_if("close").over(own))
    kept = marked.where(F.when(F.col("n_close") >= least, F.col("close")).otherwise(F.col("place") <= least))
    return kept.withColumn("rank", F.row_number().over(own.orderBy("place")).cast("long")).drop("close", "n_close", "place")


def demo_ranked(pairs: DataFrame, k: int = 15) -> DataFrame:
    """The rule-based ranker of simulations over pairs of a query and a product: 3 for a category met, 2.5 for a colour met, 1 for
    each of the query's terms in the name, a fifth of the rating, and noise; the k best of each query, ties to the lesser doc_id.

    Needs query_id, doc_id, q_category, q_colors, q_terms, name, category, colors, rating, noise; subcategory if there is one.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, wanted = low("name"), F.lower(F.coalesce("q_category", F.lit("")))
    inside = F.contains(low("subcategory"), wanted) if "subcategory" in pairs.columns else F.lit(False)
    category = (wanted != "") & ((wanted == low("category")) | inside | F.contains(name, wanted))
    asked, own = F.transform("q_colors", F.lower), F.transform("colors", F.lower)
    color = F.coalesce(F.arrays_overlap(asked, own), F.lit(False)) | F.exists(asked, lambda c: F.contains(name, c))
    terms = F.size(F.filter(F.transform("q_terms", F.lower), lambda t: F.contains(name, t)))
    score = F.when(category, 3.0).otherwise(0.0) + F.when(color, 2.5).otherwise(0.0) + terms + F.coalesce("rating", F.lit(0.0)) * 0.2 + F.coalesce("noise", F.lit(0.0))
    return ranked_pairs(pairs.withColumn("score", half_up(score, 6)), k)


def ranked_pairs(pairs: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def responses(page_: DataFrame, visual: bool = False) -> DataFrame:
    """The results of a page as they are answered: _score, _score_kind, _similarity (of photos), _explanation, _query_id, _position,
    source ("unknown" without one), _cross_platform (null outside groups of equal products).

    Needs score, position and total of page(), the columns of explanations() or, for photos, cosine; cheapest_price,
    cheapest_source, group_size and price_rank, if it has them, make the comparison with other sources.
    """
    have = page_.columns
    cross = ("cheapest_price", "cheapest_source", "group_size", "price_rank")
    other = F.when(F.col("group_size").isNotNull(), F.struct(*cross)) if set(cross) <= set(have) else F.lit(None).cast("struct<cheapest_price: double>")
    similar = half_up(F.col("cosine"), 4) if visual else F.lit(None).cast("double")
    why = F.array(F.concat(F.lit("looks "), F.bround(F.col("cosine") * 100, 0).cast("int").cast("string"), F.lit("% similar to your photo"))) if visual else explanations()
    return page_.withColumns({
        "_score": F.col("score"), "_score_kind": F.lit("visual" if visual else "ltr"), "_similarity": similar, "_explanation": why, "_query_id": F.col("query_id"), "_position": F.col("position"),
        "source": F.coalesce("source", F.lit("unknown")), "_cross_platform": other,
    })


def explanations() -> Column:
    """Why a result is shown, in a fixed order; needs q_category, q_colors, max_price, category, name, colors, price, in_stock, rrf, score."""
    text = F.lower(F.concat_ws(" ", "category", "name"))
    colors = F.transform(F.coalesce("colors", F.array().cast("array<string>")), F.lower)
    return F.array_compact(F.array(
        F.when(F.contains(text, F.lower("q_category")), F.lit("matched category")), F.when(F.arrays_overlap(F.transform("q_colors", F.lower), colors), F.lit("matched color")),
        F.when(F.coalesce("price", F.lit(0.0)) <= F.col("max_price"), F.lit("within budget")), F.when(F.coalesce("in_stock", F.lit(True)), F.lit("in stock")),
        F.concat(F.lit("hybrid relevance "), F.format_string("%.3f", half_up(F.col("rrf"), 3))), F.concat(F.lit("rerank score "), F.format_string("%.3f", half_up(F.col("score"), 3))),
    ))
