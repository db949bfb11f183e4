"""Registered queries that are whole searches: parts as products of a shop, by text with an image list and by photo with text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import half_up
from lodestar.operators import ranking as K
from lodestar.operators import retrieval as R
from lodestar.operators.tables import stored
from lodestar.plans import search as S
from lodestar.plans import views as V
from lodestar.plans.retrieval import _top

KINDS = ["saree", "kurta", "shirt", "jeans", "dress"]
HALF = 32


def _kind() -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("p_size") % len(KINDS) + 1)


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a product, numbered as vectors are by vec_id."""
    first = F.split("p_name", " ")[0]
    return V.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("_id"), F.col("p_partkey").alias("vec_id"), F.concat_ws(" ", "p_name", _kind()).alias("name"), _kind().alias("category"),
        F.array_compact(F.array(F.when(first.isin("red", "blue"), first))).alias("color"), F.array(F.lower("p_type")).alias("tags"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") / 10.0).alias("rating"), (F.col("p_partkey") % 2000).alias("review_count"), F.lit(0).alias("discount_percent"), (F.col("p_partkey") % 7 != 0).alias("in_stock"),
        F.array(F.lit("M")).alias("sizes"), F.array(F.lit("M")).alias("available_sizes"), F.col("p_brand").alias("source"), F.lit(None).cast("double").alias("cheapest_price"),
    )


def _explicit(asked: DataFrame) -> DataFrame:
    """Every fourth query has a least rating of its own, every sixth a category instead of the parsed one."""
    none = {"x_min_price": "double", "x_max_price": "double", "x_size": "string"}
    turn = F.floor(F.col("query_id") / 50)
    chosen = asked.select("query_id", F.when(turn % 6 == 5, F.lit("shirt")).alias("x_category"), F.when(turn % 4 == 3, F.lit(2.0)).alias("x_min_rating"))
    return chosen.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def _half(first: int) -> Column:
    return F.slice("v", first, HALF).alias("v")


def _named(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.concat(F.lit("p"), "doc_id").alias("doc_id"), "score", "rank")


def q_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages for texts made of the parts whose number is divisible by 50: keywords, vectors of text (an embedding's first half) and
    of images (its second half) fused, image scores as a feature, ranked by a weighted sum, explicit filters over parsed ones."""
    catalog = stored(shop(spark, sf_dir), "shop")
    mine = V.table(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    asked = mine.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", _kind(), F.when(F.col("p_partkey") % 100 == 0, F.lit("under 950"))).alias("text"))
    vectors = V.vectors(spark, sf_dir).join(catalog.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    owned = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    words = catalog.select(F.col("_id").alias("doc_id"), F.col("name").alias("text"))

    def nearest(first: int) -> DataFrame:
        return _named(R.cosine_search(owned.select("query_id", _half(first)), vectors.select("doc_id", _half(first)), 100))

    branches = {"keyword": lambda: R.tf_search(asked, words, 100), "dense": lambda: nearest(1), "image": lambda: nearest(HALF + 1)}
    lists, _ = S.run_retrievers(spark, branches)
    model = half_up(F.col("f1") * 20.0 + F.col("f2") * 0.3 + F.col("f3") * 0.2 + F.col("f9") * 0.5, 6)
    page = S.text_search(asked, catalog, lists, _explicit(asked), use_model=model, use_diversity=False, images=lists[2])
    return page.select("query_id", "doc_id", "score", "f9", "position", "total", F.array_join("why", "; ").alias("why"))


def q_photo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages for the vectors whose id is divisible by 50 as photos, half of them with a text, with the text's and explicit filters."""
    catalog, vectors = shop(spark, sf_dir), V.vectors(spark, sf_dir).select("doc_id", "v")
    of_part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", _kind()).alias("name"), _kind().alias("kind"))
    photos = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id").join(of_part, "query_id", "left")
    turn = F.floor(F.col("query_id") / 50) % 4
    asked = photos.select("query_id", "v", F.when(turn == 1, F.col("name")).when(turn == 2, F.lit("")).when(turn == 3, F.concat("kind", F.lit(" under 950"))).alias("text"))
    found = S.photo_search(asked, catalog, vectors, _explicit(asked))
    return found.select("query_id", "doc_id", "_score", "_similarity", "_position", "total", "source", F.array_join("_explanation", "; ").alias("why"))


_SHOP = f"""
shop as (select 'p' || p_partkey as id, p_partkey as vec_id, p_name || ' ' || {KINDS}[p_size % 5 + 1] as name, {KINDS}[p_size % 5 + 1] as category,
         case when split_part(p_name, ' ', 1) in ('red', 'blue') then split_part(p_name, ' ', 1) end as color, p_retailprice as price, p_size / 10e0 as rating, p_partkey % 7 <> 0 as in_stock, p_brand as source from part),
e as (select vec_id, embedding::double[] as v from embeddings)"""
# what a text asks for; explicit filters win
_WANTS = """
parsed as (select query_id, nullif(regexp_extract(text, '\\b(saree|kurta|shirt|jeans|dress)\\b', 1), '') as q_category, list_filter(['red', 'blue'], lambda c: regexp_matches(text, '\\b' || c || '\\b')) as q_colors,
           try_cast(nullif(regexp_extract(text, 'under (\\d+)', 1), '') as double) as max_price, case when (query_id // 50) % 6 = 5 then 'shirt' end as x_category, case when (query_id // 50) % 4 = 3 then 2e0 end as min_rating from asked),
wants as (select query_id, q_category, q_colors, max_price, min_rating, coalesce(x_category, q_category) as f_category from parsed)"""
_KEPT = "(f_category is null or f_category = category) and (max_price is null or price <= max_price) and (min_rating is null or rating >= min_rating) and in_stock"
_MET = "(case when q_category = category then 1e0 else 0e0 end) as f2, (case when list_contains(q_colors, color) then 1e0 else 0e0 end) as f3"


def _cosines(name: str, part: str) -> str:
    """The cosines of photos' or texts' own vectors, or halves of them, with all products'."""
    return f"""{name}0 as (select vec_id, {part} as v, sqrt(list_sum(list_transform({part}, lambda x: x * x))) as n from e),
{name} as (select a.vec_id as query_id, b.vec_id as doc_id, floor(list_dot_product(a.v, b.v) / (a.n * b.n) * 1e6 + 0.5e0) / 1e6 as score from {name}0 a, {name}0 b
where a.vec_id % 50 = 0 and a.vec_id in (select vec_id from of_query) and b.vec_id in (select vec_id from of_product))"""


QUERIES = [q_text_search, q_photo_search]
SQL = {
    "q_text_search": f"""with {_SHOP},
asked as (select p_partkey as query_id, p_name || ' ' || {KINDS}[p_size % 5 + 1] || case when p_partkey % 100 = 0 then ' under 950' else '' end as text from part where p_partkey % 50 = 0), {_WANTS},
of_query as (select vec_id from shop), of_product as (select vec_id from shop), {_cosines('dense', f'v[1:{HALF}]')}, {_cosines('image', f'v[{HALF + 1}:]')},
q as (select query_id, term, count(*) as qtf from (select query_id, unnest(string_split(text, ' ')) as term from asked) group by 1, 2),
w as (select id as doc_id, term, count(*) as tf from (select id, unnest(string_split(name, ' ')) as term from shop) group by 1, 2),
words as (select query_id, doc_id, floor(sum(qtf * tf) / 3e0 * 1e6 + 0.5e0) / 1e6 as score from q join w using (term) group by 1, 2),
la as {_top('words', 100)}, lb as (select query_id, 'p' || doc_id as doc_id, rank from {_top('dense', 100)}), lc as (select query_id, 'p' || doc_id as doc_id, score as f9, rank from {_top('image', 100)}),
fused0 as (select query_id, doc_id, max(f9) as f9, floor(sum(part) * 1e9 + 0.5e0) / 1e9 as score from (select query_id, doc_id, 1e0 / (60 + rank) as part, null as f9 from la union all select query_id, doc_id, 1e0 / (60 + rank), null from lb
           union all select query_id, doc_id, 0.8e0 / (60 + rank), f9 from lc) group by 1, 2),
fused as (select query_id, doc_id, score as rrf, row_number() over (partition by query_id order by score desc, doc_id) as fused_rank, coalesce(f9, 0e0) as f9 from fused0 qualify fused_rank <= 100),
rows0 as (select *, {_MET} from fused join shop on id = doc_id join wants using (query_id)),
ranked as (select *, floor((rrf * 20e0 + f2 * 0.3e0 + f3 * 0.2e0 + f9 * 0.5e0) * 1e6 + 0.5e0) / 1e6 as score from rows0),
kept as (select *, row_number() over w - 1 as position, count(*) over (partition by query_id) as total from ranked where {_KEPT} window w as (partition by query_id order by score desc, fused_rank))
select query_id, doc_id, score, f9, position, total, concat_ws('; ', case when contains(category || ' ' || name, q_category) then 'matched category' end, case when list_contains(q_colors, color) then 'matched color' end,
case when price <= max_price then 'within budget' end, case when in_stock then 'in stock' end, 'hybrid relevance ' || format('{{:.3f}}', floor(rrf * 1e3 + 0.5e0) / 1e3), 'rerank score ' || format('{{:.3f}}', floor(score * 1e3 + 0.5e0) / 1e3)) as why
from kept where position < {20}""",
    "q_photo_search": f"""with {_SHOP},
asked as (select e.vec_id as query_id, case (e.vec_id // 50) % 4 when 1 then name when 2 then '' when 3 then category || ' under 950' end as text from e left join shop on shop.vec_id = e.vec_id where e.vec_id % 50 = 0), {_WANTS},
of_query as (select vec_id from e), of_product as (select vec_id from e), {_cosines('cos', 'v')},
near as (select query_id, doc_id as vec_id, score as cosine from {_top('cos', 200)}),
rows0 as (select *, coalesce(trim(text), '') <> '' as has_text, {_MET} from near join shop using (vec_id) join wants using (query_id) join asked using (query_id)),
s as (select *, floor((cosine + case when has_text then 0.04e0 * (f2 + f3) else 0e0 end) * 1e6 + 0.5e0) / 1e6 as score from rows0 where {_KEPT}),
r as (select *, row_number() over (partition by query_id order by score desc, cosine desc, id) as place, cosine >= floor((max(cosine) over (partition by query_id) - 0.2e0) * 1e9 + 0.5e0) / 1e9 as close from s),
c as (select *, count_if(close) over (partition by query_id) as n_close from r),
k as (select *, row_number() over (partition by query_id order by place) - 1 as position, count(*) over (partition by query_id) as total from c where case when n_close >= 8 then close else place <= 8 end)
select query_id, id as doc_id, score as _score, floor(cosine * 1e4 + 0.5e0) / 1e4 as _similarity, position as _position, total, source, 'looks ' || round_even(cosine * 100, 0)::int || '% similar to your photo' as why from k where position < {20}""",
}
