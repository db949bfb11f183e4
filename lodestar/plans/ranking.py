"""Registered queries on listings: filters, features, ranking, matching groups, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import discount_half_even, half_up, size_order
from lodestar.operators import matching as M
from lodestar.operators import ranking as K
from lodestar.operators import retrieval as R
from lodestar.operators.tables import stored
from lodestar.operators.textindex import text_index
from lodestar.plans import views as V
from lodestar.plans.retrieval import COSINE_SQL, _top

LISTING_COLUMNS = ["name", "category", "color", "brand", "price", "mrp", "rating", "review_count", "in_stock", "sizes", "available_sizes", "source", "source_name"]


def retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The stored listings, the shopping queries, and of each its 100 best by words and by popularity."""
    # read several times below, as a stored catalogue would be
    listing, asked = stored(V.listing(spark, sf_dir), "listing"), V.intents(spark)
    named = listing.select(F.col("id").alias("doc_id"), F.col("name").alias("text"), "review_count")
    texts = asked.select("query_id", "text")
    # popular ones: of the listings that share a word with the query
    index = text_index(named, "review_count")
    return listing, asked, [R.search_index(texts, index, 100, by) for by in ("tf", "worth")]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused top 100 of each shopping query, hydrated from the listings, with the group's cheapest price."""
    return candidates_of(*retrieved(spark, sf_dir))


def candidates_of(listing: DataFrame, asked: DataFrame, lists: list[DataFrame]) -> DataFrame:
    fused = stored(R.rrf(lists, [1.0, 0.8]), "fused")
    # of the listings' groups only those that a candidate is in
    priced = listing.select("id", "source_product_id", "price")
    own = priced.join(fused.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("source_product_id").distinct()
    near = stored(priced.join(own, "source_product_id", "left_semi"), "groups")
    groups = M.dedup_index(near, M.known_groups(near)).select(F.col("id").alias("doc_id"), "cheapest_id", "cheapest_price", "group_size", "price_rank")
    rows = fused.select("query_id", "doc_id", F.col("score").alias("rrf"), F.col("rank").alias("fused_rank")).join(listing.withColumnRenamed("id", "doc_id"), "doc_id")
    full = rows.join(groups, "doc_id", "left").join(asked.drop("text"), "query_id")
    return full.withColumns({
        "colors": F.array_compact(F.array("color")), "tags": F.array(F.lower("product_type")), "discount_percent": discount_half_even(F.col("price"), F.col("mrp")),
        "image_score": F.lit(0.0), "q_bindings": F.create_map(F.lit("bolt"), F.lit("blue")),
    })


CANDIDATES_SQL = f"""{V.LISTING_SQL}, {V.INTENTS_SQL},
q as (select query_id, term, count(*) as qtf from (select query_id, unnest(string_split(lower(text), ' ')) as term from intents) where term <> '' group by 1, 2),
lw as (select id as doc_id, term, count(*) as tf from (select id, unnest(string_split(name, ' ')) as term from listing) group by 1, 2),
words as (select query_id, doc_id, floor(sum(qtf * tf) / 2e0 * 1e6 + 0.5e0) / 1e6 as score from q join lw using (term) group by 1, 2),
popular as (select query_id, doc_id, review_count::double as score from words join listing on id = doc_id),
la as {_top('words', 100)}, lb as {_top('popular', 100)},
fused0 as (select query_id, doc_id, floor((coalesce(1e0 / (60 + a.rank), 0) + coalesce(0.8e0 / (60 + b.rank), 0)) * 1e9 + 0.5e0) / 1e9 as score
           from la a full join lb b using (query_id, doc_id)),
fused as (select query_id, doc_id, score as rrf, rank as fused_rank from {_top('fused0', 100)}),
grouped as (select source_product_id, count(*) as group_size, min(price) as cheapest_price from listing group by 1 having count(*) > 1),
dedup as (select id, 'g' || source_product_id as group_id, first_value(id) over w as cheapest_id, cheapest_price, group_size, row_number() over w as price_rank
          from listing join grouped using (source_product_id) window w as (partition by source_product_id order by price, id)),
cand as (select f.*, l.*, d.cheapest_id, d.cheapest_price, d.group_size, d.price_rank, q_category, q_colors, max_price, min_rating, q_size,
                case when l.mrp > l.price then round_even((l.mrp - l.price) / l.mrp * 100, 0)::int else 0 end as discount_percent
         from fused f join listing l on l.id = f.doc_id left join dedup d on d.id = l.id join intents using (query_id)),
feat as (select *, rrf as f1, (case when q_category is not null and (q_category = category or regexp_matches(category || ' ' || name || ' ' || lower(product_type), '\\b' || q_category || '\\b')) then 1e0 else 0e0 end) as f2,
                (case when list_contains(q_colors, color) then 1e0 else 0e0 end) as f3,
                (case when max_price is null then 1e0 when price > max_price then 0e0 else 1e0 - 0.3e0 * (price / max_price) end) as f4,
                rating / 5e0 as f5, least(review_count / 1000e0, 1e0) as f6, discount_percent / 100e0 as f7, (case when in_stock then 1e0 else 0e0 end) as f8, 0e0 as f9,
                (case when name like '%bolt%' and color = 'blue' then 1e0 else 0e0 end) as f11, coalesce(least(cheapest_price / price, 1e0), 0.5e0) as f12
         from cand),
feat2 as (select *, (case when q_category is null and len(q_colors) = 0 then 0.5e0 else (f2 + f3) / ((q_category is not null)::int + len(q_colors)) end) as f10 from feat)"""


def f06_filter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing against every query's filters: queries are a fixed short list."""
    asked = V.intents(spark).select("query_id", "q_category", "max_price", "min_rating", "q_size")
    both = V.listing(spark, sf_dir).crossJoin(F.broadcast(asked))
    kept = both.where(K.passes_filters(F.col("q_category"), F.lit(None).cast("double"), F.col("max_price"), F.col("min_rating"), F.col("q_size")))
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def f05_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions.text import size_available

    wanted = spark.createDataFrame([(s,) for s in ["M", "size", "2xl", "UK 28", "xx large", ""]], "want string")
    # a listing's sizes are sets of a few letters: the rule is asked once for each two of them
    kinds = V.listing(spark, sf_dir).groupBy("sizes", "available_sizes").agg(F.count("*").alias("listings"))
    there = size_available(F.col("want"), F.col("sizes"), F.col("available_sizes"))
    return kinds.crossJoin(F.broadcast(wanted)).groupBy("want").agg(F.sum(F.when(there, F.col("listings")).otherwise(0)).alias("n"))


def r11_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_features(candidates(spark, sf_dir)).select("query_id", "doc_id", *K.FEATURES)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scored(K.with_features(candidates(spark, sf_dir)))


def r17_rank_no_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _ranked(spark, sf_dir).where(K.passes_filters(F.col("q_category"), F.lit(None).cast("double"), F.col("max_price"), F.col("min_rating"), F.col("q_size")))
    return K.page(kept, 1, 20).select("query_id", "doc_id", "score", "position", "total")


def r15_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.diversified(_ranked(spark, sf_dir))


def p02_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query_id", "doc_id", F.array_join(K.explanations(), "; ").alias("why"))


def p04_cross_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = V.listing(spark, sf_dir).select(F.col("id").alias("cheapest_id"), F.col("source_name").alias("cheapest_source"))
    return candidates(spark, sf_dir).where("cheapest_id is not null").join(shops, "cheapest_id").select("query_id", "doc_id", "cheapest_price", "cheapest_source", F.col("group_size").alias("available_on"), "price_rank")


def r18_photo_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 50 as photos against all; a label in common counts as the text's category."""
    all_ = V.vectors(spark, sf_dir)
    asked = all_.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "v", F.col("label").alias("q_label"))
    near = R.cosine_search(asked.select("query_id", "v"), all_, 200)
    rows = near.join(all_.select("doc_id", "label"), "doc_id").join(asked.select("query_id", "q_label"), "query_id")
    same = F.when(F.col("label") == F.col("q_label"), 1.0).otherwise(0.0)
    ready = rows.select("query_id", "doc_id", F.col("score").alias("cosine"), (F.col("query_id") % 100 == 0).alias("has_text"), same.alias("f2"), F.lit(0.0).alias("f3"))
    # every third item stands for one that the text's filters rule out
    return K.photo_ranked(ready, passes=~F.col("has_text") | (F.col("doc_id") % 3 != 0)).select("query_id", "doc_id", "score", "rank")


def d01_title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names of parts whose words are half in common or more: what parts share a name is seen first."""
    from lodestar.functions.text import title_tokens

    names = V.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct()
    pairs = M.title_pairs(names.select(F.col("name").alias("id"), title_tokens(F.col("name")).alias("t")), least=0.5)
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vectors(spark, sf_dir).select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("source"), F.col("label").alias("category"), F.concat(F.lit("b"), F.col("doc_id") % 3).alias("brand"),
        F.lit("").alias("name"), (F.lit(10.0) + F.col("doc_id") % 40).alias("price"), F.lit(None).cast("string").alias("gtin"), "v",
    )


def d02_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_pairs(_items(spark, sf_dir), least=0.30)


def d03_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return M.match_groups(M.match_pairs(items, least=0.30), items)


def d04_known_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.known_groups(V.listing(spark, sf_dir)).groupBy("group_id").agg(F.count("*").alias("members"))


def d05_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = stored(V.listing(spark, sf_dir).select("id", "source_product_id", "price"), "listing")
    return M.dedup_index(listing, M.known_groups(listing))


def d06_price_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = stored(V.listing(spark, sf_dir).select("id", "source_product_id", "price"), "listing")
    # the cheapest price needs no ranks, and a group's listings are found by its number
    return listing.join(M.cheapest_of_groups(listing), "source_product_id", "left").select("id", half_up(K.competitiveness(F.col("price"), F.col("cheapest_price")), 6).alias("competitiveness"))


def t08_size_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = V.listing(spark, sf_dir).select(F.explode("sizes").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    return each.select("size", "n", F.row_number().over(Window.orderBy(size_order(F.col("size")))).cast("long").alias("place"))


def w07_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin over sources: by the number within a source, then by source."""
    own = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("review_count"), "id")) - 1
    return V.listing(spark, sf_dir).select("id", "source", own.cast("long").alias("turn"))


_PASS = """(q_category is null or q_category = category or regexp_matches(category || ' ' || name, '\\b' || q_category || '\\b')) and (max_price is null or price <= max_price) and (min_rating is null or rating >= min_rating) and in_stock
and (q_size is null or list_contains(available_sizes, q_size))"""
QUERIES = [
    f06_filter_set, f05_size_filter, r11_features, r17_rank_no_div, r15_diversify, p02_explain, p04_cross_platform, r18_photo_rank, d01_title_jaccard, d02_match_pairs, d03_components,
    d04_known_groups, d05_dedup_index, d06_price_comp, t08_size_order, w07_interleave,
]
_PAIRS_SQL = """
e as (select vec_id as id, vec_id % 4 as source, label as category, 10e0 + vec_id % 40 as price, vec_id % 3 as brand, embedding::double[] as v from embeddings),
p as (select x.id as a, y.id as b, x.source as sa, y.source as sb, x.brand as ba, y.brand as bb, x.price as pa, y.price as pb, floor(list_dot_product(x.v, y.v) * 1e6 + 0.5e0) / 1e6 as similarity
      from e x join e y on x.category is not distinct from y.category and x.id <> y.id),
near as (select * from p where similarity >= 0.30e0 qualify row_number() over (partition by a order by similarity desc, b) <= 10),
pairs as (select a, b, similarity from near where a < b and sa <> sb and ba = bb and greatest(pa, pb) / least(pa, pb) <= 3)"""
SQL = {
    "f06_filter_set": f"with {V.LISTING_SQL}, {V.INTENTS_SQL} select query_id, count(*) as n, min(id) as first_id, max(id) as last_id from listing, intents where {_PASS} group by 1",
    "f05_size_filter": f"""with {V.LISTING_SQL}, w(want, norm) as (values ('M', 'M'), ('size', 'SIZE'), ('2xl', 'XXL'), ('UK 28', '28'), ('xx large', 'XXLARGE'), ('', null))
select want, count_if(norm is null or list_contains(available_sizes, norm))::bigint as n from listing, w group by 1""",
    "r11_features": f"with {CANDIDATES_SQL} select query_id, doc_id, " + ", ".join(f"floor(f{i} * 1e9 + 0.5e0) / 1e9 as f{i}" for i in range(1, 13)) + " from feat2",
    "r17_rank_no_div": f"""with {CANDIDATES_SQL}, kept as (select query_id, doc_id, f1 as score, row_number() over (partition by query_id order by f1 desc, fused_rank) as rank from feat2 where {_PASS})
select query_id, doc_id, score, row_number() over w - 1 as position, count(*) over (partition by query_id) as total from kept window w as (partition by query_id order by rank) qualify position < 20""",
    "p02_explain": f"""with {CANDIDATES_SQL} select query_id, doc_id, concat_ws('; ', case when contains(category || ' ' || name, q_category) then 'matched category' end, case when list_contains(q_colors, color) then 'matched color' end,
case when price <= max_price then 'within budget' end, case when in_stock then 'in stock' end, 'hybrid relevance ' || format('{{:.3f}}', floor(rrf * 1e3 + 0.5e0) / 1e3), 'rerank score ' || format('{{:.3f}}', floor(rrf * 1e3 + 0.5e0) / 1e3)) as why from feat2""",
    "p04_cross_platform": f"with {CANDIDATES_SQL} select c.query_id, c.doc_id, c.cheapest_price, l.source_name as cheapest_source, c.group_size as available_on, c.price_rank from cand c join listing l on l.id = c.cheapest_id",
    "r18_photo_rank": f"""with {COSINE_SQL}, t as {_top('cos', 200)},
s as (select query_id, doc_id, score as cosine, floor((score + case when query_id % 100 = 0 and x.label = y.label then 0.04e0 else 0 end) * 1e6 + 0.5e0) / 1e6 as score
      from t join embeddings x on x.vec_id = query_id join embeddings y on y.vec_id = doc_id where query_id % 100 <> 0 or doc_id % 3 <> 0),
r as (select *, row_number() over (partition by query_id order by score desc, cosine desc, doc_id) as place, cosine >= floor((max(cosine) over (partition by query_id) - 0.2e0) * 1e9 + 0.5e0) / 1e9 as close from s),
c as (select *, count_if(close) over (partition by query_id) as n_close from r)
select query_id, doc_id, score, row_number() over (partition by query_id order by place) as rank from c where case when n_close >= 8 then close else place <= 8 end""",
    "d01_title_jaccard": """with n as (select distinct p_name || ' ' || lower(p_type) as name from part), t as (select name, list_distinct(list_filter(regexp_extract_all(name, '[a-z0-9]+'), lambda w: len(w) > 1 and w not in ('men', 'mens', 'women', 'womens', 'for', 'with', 'and', 'the', 'of', 'in', 'fit', 'regular', 'new'))) as t from n)
select x.name as a, y.name as b, floor(len(list_intersect(x.t, y.t))::double / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) * 1e6 + 0.5e0) / 1e6 as similarity from t x join t y on x.name < y.name and 2 * len(list_intersect(x.t, y.t)) >= len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) and len(x.t) > 0""",
    "d02_match_pairs": f"with {_PAIRS_SQL} select * from pairs",
    "d03_components": f"""with recursive {_PAIRS_SQL}, mirror as (select a, b from pairs union select b, a from pairs), reach(id, other) as (select a, a from mirror union select r.id, m.b from reach r join mirror m on m.a = r.other),
comp as (select id, min(other) as component from reach group by 1)
select 'match_' || component as group_id, id from comp where component in (select component from comp group by 1 having count(distinct id % 4) > 1)""",
    "d04_known_groups": f"with {V.LISTING_SQL} select 'g' || source_product_id as group_id, count(*) as members from listing group by source_product_id having count(*) > 1",
    "d05_dedup_index": f"with {CANDIDATES_SQL} select id, group_id, cheapest_id, cheapest_price, group_size, price_rank from dedup",
    "d06_price_comp": f"with {CANDIDATES_SQL} select l.id, floor(coalesce(least(cheapest_price / price, 1e0), 0.5e0) * 1e6 + 0.5e0) / 1e6 as competitiveness from listing l left join dedup d on d.id = l.id",
    "t08_size_order": f"""with {V.LISTING_SQL}, s as (select unnest(sizes) as size from listing) select size, count(*) as n, row_number() over (order by coalesce(list_position(['XXS', 'XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL', 'XXXXL'], size), 100 + try_cast(size as int))) as place from s group by size""",
    "w07_interleave": f"with {V.LISTING_SQL} select id, source, row_number() over (partition by source order by review_count desc, id) - 1 as turn from listing",
}
