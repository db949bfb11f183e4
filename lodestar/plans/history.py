"""Registered queries on price history, feedback, measures and analytics, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import half_up
from lodestar.operators import analytics as A
from lodestar.operators import catalog as C
from lodestar.operators import feedback as E
from lodestar.operators import retrieval as R
from lodestar.operators.tables import stored
from lodestar.operators.textindex import text_index
from lodestar.operators.matching import cut
from lodestar.plans import views as V
from lodestar.plans.retrieval import BM25_SQL, _top

AS_OF = "2001-06-30"


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd")


def w01_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.price_changes(V.price_observations(spark, sf_dir)).select("part", "n", _day("at").alias("day"), "price", "price_changed")


CHANGES_SQL = f"""{V.OBSERVED_SQL},
stepped as (select *, lag(price) over w as p0, lag(in_stock) over w as s0, lag(n) over w as n0 from observed window w as (partition by part order by n)),
changes as (select part, n, ts, price, in_stock, n0 is not null and p0 <> price as price_changed from stepped where n0 is null or p0 <> price or s0 <> in_stock)"""


def w02_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stored(C.price_changes(V.price_observations(spark, sf_dir)), "changes")
    rows = C.history_summary(changes, F.lit(AS_OF).cast("timestamp_ntz"))
    return rows.withColumns({"tracked_since": _day("tracked_since"), "last_change": _day("last_change")})


def w05_skip_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.skip_above(V.impressions(spark, sf_dir)).select("session", "position", "event_id", "clicked")


SKIP_SQL = f"""{V.IMPRESSIONS_SQL},
kept as (select * from impressions qualify position <= max(position) filter (clicked) over (partition by session) + 1),
groups as (select * from kept qualify bool_or(clicked) over (partition by session) and not bool_and(clicked) over (partition by session))"""


def w06_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = V.impressions(spark, sf_dir).groupBy("session").agg(F.max("event_id").alias("newest"))
    return E.newest_held_out(sessions, 0.2, "newest").select("session", "held_out")


def w08_click_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded labels and a pseudo fusion score by place for each shown item of a session."""
    return V.impressions(spark, sf_dir).select("session", "event_id", "label", half_up(F.lit(1.0) / (60 + F.col("position")), 9).alias("pseudo_rrf"))


def w09_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's exponential moving average of value, 0.8 old and 0.2 new, in order of time."""
    return A.moving_average(V.table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"]).select("user_id", half_up(F.col("ema"), 4).alias("ema"))


def w10_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5000 events; the number is the buffer's size."""
    return V.table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(5000).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


def w11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.impressions(spark, sf_dir)
    # the first ten shown of a session, and its first click wherever it is
    shown = rows.where("position < 10").groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"]).alias("shown"))
    clicked = rows.where("clicked").groupBy("session").agg(F.min_by("event_id", "position").alias("clicked_id"))
    return E.hard_negatives(shown.join(clicked, "session")).select("session", "product", "label", "shown_rank")


def e01_training_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.impressions(spark, sf_dir)
    shown = rows.select(F.col("session").alias("query_id"), F.col("event_id").alias("product_id"), "position", F.lit(2).alias("feature_version"), F.when(F.col("event_id") % 3 == 0, F.lit("image")).when(F.col("event_id") % 3 == 1, F.lit("text")).alias("mode"))
    clicks = rows.where("clicked").select(F.col("session").alias("query_id"), F.col("event_id").alias("clicked_id"))
    return E.training_sessions(shown, clicks, 2).select("query_id", "product_id", "position", "clicked")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel): 3 if the document contains the item's text, else the quality label of documents that BM25 finds."""
    items, docs = V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir)
    found = R.bm25_search(items, docs, 20).select("query_id", "doc_id")
    texts = found.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "query_id").join(V.table(spark, sf_dir, "labels"), "doc_id", "left")
    # a judgment table is read several times by every measure
    return cut(texts.select("query_id", "doc_id", F.when(F.contains("text", "item"), 3).otherwise(F.coalesce("quality", F.lit(0))).alias("rel")))


JUDGED_SQL = f"""{BM25_SQL}, t as {_top('bm', 20)},
judged as (select query_id, doc_id, (case when contains(d.text, b.text) then 3 else coalesce(quality, 0) end)::int as rel
           from t join documents d using (doc_id) join benchmark b on item_id = query_id left join labels using (doc_id)),
ranked as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as rank from judged),
ideal as (select query_id, sum((pow(2, rel) - 1) / log2(r + 1)) as idcg from (select *, row_number() over (partition by query_id order by rel desc, doc_id) as r from judged) where r <= 10 group by 1),
got as (select query_id, sum(case when rank <= 10 then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) as dcg, count_if(rank <= 10 and rel >= 2) as hits, count_if(rel >= 2) as n_good,
               min(rank) filter (rel >= 2 and rank <= 20) as first from ranked join judged using (query_id, doc_id) group by 1)"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judgments(spark, sf_dir)
    order = judged.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).alias("rank"))
    return E.ranking_measures(order, judged, 10)


def e06_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("query_id", half_up(F.col("ndcg"), 6).alias("ndcg"))


def e07_ndcg_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("query_id", half_up(F.col("ndcg_legacy"), 6).alias("ndcg"))


def e08_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("query_id", half_up(F.col("recall"), 6).alias("recall"))


def e09_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).agg(half_up(F.avg("rr"), 6).alias("mrr"))


def e10_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each query's first ten by plain term frequency that has a judgment."""
    top = R.tf_search(V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir), 20)
    return E.ranking_measures(top, judgments(spark, sf_dir), 10).select("query_id", half_up(F.col("judged"), 6).alias("judged"))


def e11_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judgments(spark, sf_dir)
    top = R.bm25_search(V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir), 10)
    return E.binary_measures(top, judged.where("rel = 3"), 10).select("query_id", "hit", half_up(F.col("rr"), 6).alias("rr"), half_up(F.col("ndcg"), 6).alias("ndcg"))


def e12_rule_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 for category and colour, 2 for category, 1 for colour, by substring, counted over all listings of each query."""
    asked = V.intents(spark).select("query_id", "q_category", F.get("q_colors", F.lit(0)).alias("q_color"))
    cat = F.coalesce(F.contains("name", "q_category"), F.lit(False))
    col = F.coalesce(F.contains("color", "q_color"), F.lit(False))
    rows = V.listing(spark, sf_dir).select("name", "color").crossJoin(F.broadcast(asked)).withColumn("rel", F.when(cat & col, 3).when(cat, 2).when(col, 1).otherwise(0))
    return rows.where("rel > 0").groupBy("query_id", "rel").agg(F.count("*").alias("n"))


def e13_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir)
    index = text_index(docs)
    a, b = R.search_index(queries, index, 10), R.search_index(queries, index, 10, "tf")
    lists = a.select(F.lit(1).alias("variant"), "query_id", "doc_id", "rank").unionByName(b.select(F.lit(2).alias("variant"), "query_id", "doc_id", "rank"))
    known = judgments(spark, sf_dir).where("rel = 3")
    return E.pooled(lists, known, 10)


def e15_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nearest_rank(V.table(spark, sf_dir, "events"), "value", [0.5, 0.95])


def e18_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert on every listing for a customer, at nine tenths of its highest price."""
    listing = V.listing(spark, sf_dir)
    alerts = listing.select(F.col("id").alias("alert_id"), F.col("id").alias("product_id"), F.lower("brand").alias("email"), half_up(F.col("mrp") * 0.9, 2).alias("target_price"), F.lit(True).alias("active"))
    due = C.due_alerts(alerts, listing)
    left = C.after_notice(alerts, due).where("active").groupBy("email").agg(F.count("*").alias("waiting"))
    return due.groupBy("email").agg(F.count("*").alias("sent"), F.min("notified_price").alias("least")).join(left, "email", "full")


def a09_alert_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every customer for the part of their own number, against alerts that their orders stand for."""
    customers = V.table(spark, sf_dir, "customer")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@shop.example"))
    requests = customers.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("product_id"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(mail).alias("email"), (F.col("c_acctbal") / 4).alias("target_price"))
    products = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    held = V.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.upper(mail).alias("email"), (F.col("o_orderstatus") != "P").alias("active"))
    return C.alert_errors(requests, products, held, 10)


def a03_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.listing(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("store").alias("kind"), F.col("source_name").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")))).alias("x")).select("x.*")
    return A.top_counts(rows, "kind", "name", 12)


def a04_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.listing(spark, sf_dir).agg(F.bool_or(F.col("rating") > 0).alias("has_ratings"), F.max("review_count").alias("most_reviews"), F.countDistinct("source").alias("n_sources"))


def a05_analytics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "error"), F.lit("search")).when(F.col("event_type") == "click", F.lit("click"))
    rows = events.select(kind.alias("type"), F.col("user_id").cast("string").alias("query_id"), F.get_json_object("props", "$.k").alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("total"), F.col("value").alias("latency_ms")).where("type is not null")
    return A.search_summary(rows)


def a08_site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = V.listing(spark, sf_dir).select(F.col("source").alias("site"), "in_stock", "price", "id")
    sites = V.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("site"))
    runs = V.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("site"), F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("status"))
    return A.site_stats(sites, listing, runs)


def j10_missing_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings not seen in shipments since 1998, at the suppliers of even number, become inactive."""
    stored = V.listing(spark, sf_dir).select("id", F.col("source").alias("site"), F.lit(True).alias("active"))
    lines = V.table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'")
    seen = lines.select(F.concat(F.lit("p"), "l_partkey", F.lit("_s"), "l_suppkey").alias("id")).distinct()
    done = V.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("site"))
    return C.mark_missing(stored, seen, done).groupBy("site", "active").agg(F.count("*").alias("n"))


def u07_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last shipment of each part, by all columns."""
    lines = V.table(spark, sf_dir, "lineitem")
    return C.latest(lines, "l_partkey", *V.OBSERVED_ORDER).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", _day("l_shipdate").alias("day"))


def snk02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts shipped before 1998 are stored, those shipped since are seen again or new."""
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate", "l_quantity")
    old = lines.where("l_shipdate < timestamp_ntz'1998-01-01 00:00:00'").groupBy("id").agg(F.lit("a").alias("site"), F.sum("l_quantity").cast("string").alias("data"), F.lit("1").alias("first_seen"), F.lit("1").alias("last_seen"), F.lit(False).alias("active"))
    new = lines.where("l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'").groupBy("id").agg(F.lit("b").alias("site"), F.sum("l_quantity").cast("string").alias("data"))
    return C.upsert(old, new, F.lit("2")).withColumn("data", F.col("data").cast("double"))


QUERIES = [
    w01_price_changes, w02_history_summary, w05_skip_above, w06_holdout, w08_click_groups, w09_ema, w10_ring_buffer, w11_hard_negatives, e01_training_sessions, e06_ndcg, e07_ndcg_legacy,
    e08_recall, e09_mrr, e10_judged, e11_binary, e12_rule_judgments, e13_pooling, e15_percentiles, e18_alerts, a09_alert_quota, a03_store_counts, a04_flags, a05_analytics_summary, a08_site_stats,
    j10_missing_inactive, u07_merge_latest, snk02_upsert,
]
SQL = {
    "w01_price_changes": f"with {CHANGES_SQL} select part, n, strftime(ts, '%Y-%m-%d') as day, price, price_changed from changes",
    "w02_history_summary": f"""with {CHANGES_SQL},
x as (select *, last_value(price) over (partition by part order by n rows between unbounded preceding and unbounded following) as current, lag(price) over (partition by part order by n) as before,
             count(*) over (partition by part) - row_number() over (partition by part order by n) as rest from changes),
s as (select part, count(*) as points, min_by(ts, n) as first, any_value(current) as price, max_by(price, n) filter (price <> current and rest > 0) as previous_price,
             coalesce(max_by(ts, n) filter (before <> price), min_by(ts, n)) as last_change,
             min(price) filter (ts >= timestamp '{AS_OF}' - interval 30 day) as low, max(price) filter (ts >= timestamp '{AS_OF}' - interval 30 day) as high,
             string_agg(strftime(ts, '%Y-%m-%d') || ':' || format('{{:.2f}}', price), ',' order by n) filter (rest < 30) as series from x group by part)
select part, points, strftime(first, '%Y-%m-%d') as tracked_since, price, previous_price, previous_price is not null and price < previous_price as price_dropped, strftime(last_change, '%Y-%m-%d') as last_change,
       least(coalesce(low, price), price) as lowest, greatest(coalesce(high, price), price) as highest, previous_price is not null and price <= least(coalesce(low, price), price) as is_lowest, series from s""",
    "w05_skip_above": f"with {SKIP_SQL} select session, position, event_id, clicked from groups",
    "w06_holdout": f"""with {V.IMPRESSIONS_SQL}, s as (select session, max(event_id) as newest from impressions group by 1)
select session, row_number() over (order by newest desc) <= greatest(1, floor((select count(*) from s) * 0.2e0)) as held_out from s""",
    "w08_click_groups": f"with {V.IMPRESSIONS_SQL} select session, event_id, label, floor(1e0 / (60 + position) * 1e9 + 0.5e0) / 1e9 as pseudo_rrf from impressions",
    "w09_ema": """with e as (select user_id, value, row_number() over w - 1 as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id))
select user_id, floor(sum(value * (case when i = 0 then pow(0.8e0, n - 1) else 0.2e0 * pow(0.8e0, n - 1 - i) end)) * 1e4 + 0.5e0) / 1e4 as ema from e group by 1""",
    "w10_ring_buffer": "select event_type, count(*) as n, min(event_id) as oldest from (select * from events order by event_id desc limit 5000) group by 1",
    "w11_hard_negatives": f"""with {V.IMPRESSIONS_SQL}, c as (select session, min_by(event_id, position) as clicked_id from impressions where clicked group by 1)
select session, clicked_id as product, 3::int as label, null::int as shown_rank from c
union all select session, event_id, 0, (position + 1)::int from impressions join c using (session) where position < 10 and event_id <> clicked_id""",
    "e01_training_sessions": f"""with {V.IMPRESSIONS_SQL} select session as query_id, event_id as product_id, position, clicked from impressions
where event_id % 3 <> 0 and session in (select session from impressions where clicked)""",
    "e06_ndcg": f"with {JUDGED_SQL} select query_id, floor(case when idcg > 0 then dcg / idcg end * 1e6 + 0.5e0) / 1e6 as ndcg from got join ideal using (query_id)",
    "e07_ndcg_legacy": f"with {JUDGED_SQL} select query_id, floor((case when idcg > 0 then dcg / idcg when dcg = 0 then 1 else 0 end) * 1e6 + 0.5e0) / 1e6 as ndcg from got join ideal using (query_id)",
    "e08_recall": f"with {JUDGED_SQL} select query_id, floor(case when n_good > 0 then hits / n_good::double end * 1e6 + 0.5e0) / 1e6 as recall from got",
    "e09_mrr": f"with {JUDGED_SQL} select floor(avg(coalesce(1e0 / first, 0)) * 1e6 + 0.5e0) / 1e6 as mrr from got",
    "e10_judged": f"""with {JUDGED_SQL}, p as {_top('plain', 20)}, j as (select p.query_id, count_if(rank <= 10 and rel is not null) as k, count_if(rank <= 10) as n from p left join judged using (query_id, doc_id) group by 1)
select query_id, floor(k / n::double * 1e6 + 0.5e0) / 1e6 as judged from j""",
    "e11_binary": f"""with {JUDGED_SQL}, p as {_top('bm', 10)}, h as (select p.query_id, count(rel) as n, min(rank) filter (rel is not null) as first, coalesce(sum(1 / log2(rank + 1)) filter (rel is not null), 0) as dcg
from p left join (select * from judged where rel = 3) using (query_id, doc_id) group by 1)
select query_id, n > 0 as hit, floor(coalesce(1e0 / first, 0) * 1e6 + 0.5e0) / 1e6 as rr, floor((case when n > 0 then dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) else 0 end) * 1e6 + 0.5e0) / 1e6 as ndcg from h""",
    "e12_rule_judgments": f"""with {V.LISTING_SQL}, {V.INTENTS_SQL}, r as (select query_id, coalesce(contains(name, q_category), false) as cat, coalesce(contains(color, q_colors[1]), false) as col from listing, intents),
g as (select query_id, (case when cat and col then 3 when cat then 2 when col then 1 else 0 end)::int as rel from r) select query_id, rel, count(*) as n from g where rel > 0 group by 1, 2""",
    "e13_pooling": f"""with {JUDGED_SQL}, a as {_top('bm', 10)}, b as {_top('plain', 10)}, u as (select 1 as variant, query_id, doc_id, rank from a union all select 2, query_id, doc_id, rank from b),
f as (select query_id, doc_id, min(variant * 1000 + rank) as pos from u group by 1, 2), o as (select *, row_number() over (partition by query_id order by pos, doc_id) as place from f)
select query_id, doc_id, place from o anti join (select * from judged where rel = 3) using (query_id, doc_id)""",
    "e15_percentiles": """with v as (select value, row_number() over (order by value) - 1 as place, count(*) over () as n from events), s(share) as (values (0.5e0), (0.95e0))
select share, value from v, s where place = round_even(share * (n - 1), 0)""",
    "e18_alerts": f"""with {V.LISTING_SQL}, x as (select lower(brand) as email, price, in_stock and price > 0 and price <= floor(mrp * 0.9e0 * 100e0 + 0.5e0) / 100e0 as due from listing)
select email, nullif(count_if(due), 0)::bigint as sent, min(price) filter (due) as least, nullif(count_if(not due), 0)::bigint as waiting from x group by 1""",
    "a09_alert_quota": """with m as (select c_custkey, c_acctbal / 4 as target, case when c_custkey % 7 = 0 then lower(c_name) else lower(replace(c_name, '#', '.')) || '@shop.example' end as email, lower(replace(c_name, '#', '.')) || '@shop.example' as own from customer),
h as (select own as email, count(*) as held from orders join m on o_custkey = c_custkey where o_orderstatus <> 'P' group by 1)
select c_custkey as request_id, (case when p_retailprice is null then 404 when not regexp_full_match(m.email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') then 400 when target <= 0 or target >= p_retailprice then 400 when coalesce(held, 0) >= 10 then 429 end)::int as error
from m left join part on p_partkey = c_custkey left join h on h.email = m.email""",
    "a03_store_counts": f"""with {V.LISTING_SQL}, x as (select 'store' as kind, source_name as name from listing union all select 'category', category from listing)
select kind, name, count(*) as n from x group by 1, 2 qualify row_number() over (partition by kind order by count(*) desc, name) <= 12""",
    "a04_flags": f"with {V.LISTING_SQL} select bool_or(rating > 0) as has_ratings, max(review_count) as most_reviews, count(distinct source) as n_sources from listing",
    "a05_analytics_summary": """with s as (select event_type, user_id, json_extract_string(props, '$.k') as query, value from events),
t as (select query, count(*) as c from s where event_type in ('view', 'error') group by 1 order by c desc, query limit 5)
select count_if(event_type in ('view', 'error'))::bigint as searches, count_if(event_type = 'click')::bigint as clicks,
 floor(count(distinct user_id) filter (event_type in ('view', 'error') and user_id in (select user_id from s where event_type = 'click')) / (count(distinct user_id) filter (event_type in ('view', 'error')))::double * 1e4 + 0.5e0) / 1e4 as click_through_rate,
 floor(count_if(event_type = 'error') / count_if(event_type in ('view', 'error'))::double * 1e4 + 0.5e0) / 1e4 as zero_result_rate,
 floor(avg(value) filter (event_type in ('view', 'error')) * 1e2 + 0.5e0) / 1e2 as avg_latency_ms,
 (select string_agg(query || ':' || c, ',' order by c desc, query) from t) as top_queries from s""",
    "a08_site_stats": f"""with {V.LISTING_SQL}, r as (select 's' || l_suppkey as site, max(l_orderkey) as last_run, max_by(l_returnflag, (l_orderkey, l_returnflag)) as last_status from lineitem group by 1),
p as (select source as site, count(*) as products, count_if(in_stock)::bigint as in_stock, max(price) as highest from listing group by 1)
select 's' || s_suppkey as site, coalesce(products, 0) as products, coalesce(in_stock, 0) as in_stock, highest, last_run, last_status from supplier left join p on p.site = 's' || s_suppkey left join r on r.site = 's' || s_suppkey""",
    "j10_missing_inactive": f"""with {V.LISTING_SQL}, seen as (select distinct 'p' || l_partkey || '_s' || l_suppkey as id from lineitem where l_shipdate >= timestamp '1998-01-01'),
x as (select source as site, not (substr(source, 2)::bigint % 2 = 0 and id not in (select id from seen)) as active from listing) select site, active, count(*) as n from x group by 1, 2""",
    "u07_merge_latest": """select l_partkey, l_orderkey, l_linenumber, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem
qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc) = 1""",
    "snk02_upsert": """with o as (select l_partkey as id, sum(l_quantity) as q from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), n as (select l_partkey as id, sum(l_quantity) as q from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1)
select id, case when n.q is null then 'a' else 'b' end as site, coalesce(n.q, o.q) as data, case when o.q is null then '2' else '1' end as first_seen, case when n.q is null then '1' else '2' end as last_seen, n.q is not null as active from o full join n using (id)""",
}
