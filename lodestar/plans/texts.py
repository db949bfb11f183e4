"""Registered queries on names, pages, shopping queries and streams as batches, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V
from lodestar.functions.intent import PARSED, parse_queries, parsed_by_cache, whole_word
from lodestar.operators import suggest as S
from lodestar.operators.catalog import latest
from lodestar.operators.normalize import canonical
from lodestar.plans import views
from lodestar.sources import robots
from lodestar.streaming import windows as W

#: What stands before and after parts' names in queries; {price} and {size} are the part's.
BEFORE = (
    "black shirt", "M size kurta", "red kurta and white shirt", "nike shoes", "H&M hoodie", "blue denim", "white sneakers uk 8", "saree in maroon", "kurta set", "beige tote with navy belt", "", "jeans 32 waist", "tee size: 2xl", "red", "gift", "100 200",
)
AFTER = ("size L", "under {price}", "below rs. {price}", "less than {price}", "< {price} for mom", "4.5+ star", "above 4", "size: {size}", "{size} waist", "xl", "", "M size", "3 rating blue shirt & red belt")


def qp_parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name in a query of its own, with a price and a size of the part."""
    part = views.dealt(views.table(spark, sf_dir, "part"), "p_partkey")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
    after = F.replace(F.replace(pick(AFTER, F.floor(F.col("p_partkey") / 3)), F.lit("{price}"), F.floor("p_retailprice").cast("string")), F.lit("{size}"), F.col("p_size").cast("string"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", pick(BEFORE, F.col("p_partkey")), "p_name", after).alias("text"))
    rows = parse_queries(asked)
    pairs = F.sort_array(F.transform(F.map_entries("bindings"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("query_id", "size", "cleaned", F.array_join("colors", ",").alias("colors"), "max_price", "min_rating", "brand", "category", F.array_join("terms", ",").alias("terms"), F.array_join(pairs, ",").alias("bindings"))


def qp9_parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name and size asked at noon, some in capitals, by a cache that holds those of every third part, up to two hours old."""
    part, noon = views.table(spark, sf_dir, "part"), F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    plain = F.concat_ws(" ", "p_name", "p_size")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper(plain))).otherwise(plain).alias("text"))
    marked = parse_queries(part.where("p_partkey % 3 = 0").select("p_partkey", plain.alias("text"))).withColumn("category", F.lit("kept"))
    minutes = (F.col("p_partkey") % 120).cast("int")
    cache = marked.select(F.col("text").alias("key"), F.struct(*PARSED).alias("intent"), (noon - F.make_dt_interval(mins=minutes)).alias("parsed_at"))
    found, after = parsed_by_cache(asked, cache, noon)
    size = after.agg(F.count("*").alias("n_after"))
    age = (F.unix_timestamp(noon) - F.unix_timestamp("parsed_at")) / 60
    return found.select("query_id", "cached", age.cast("long").alias("minutes"), "intent.category", F.array_join("intent.colors", ",").alias("colors")).crossJoin(F.broadcast(size))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]::varchar[]"


def _cases(pairs) -> str:
    return " ".join(f"when {k} then {v}" for k, v in pairs)


_COLORS = "(" + ", ".join(map(_q, V.QUERY_COLORS)) + ")"
_BIND = _q(r"(\w+)\s+(\w+)\s+(?:and|with|&)\s+(\w+)\s+(\w+)")
_SIZES = list(enumerate(V.SIZE_PATTERNS))
QP_SQL = rf"""with a as (select p_partkey as query_id, concat_ws(' ', ({_listed(BEFORE)})[p_partkey % {len(BEFORE)} + 1], p_name,
replace(replace(({_listed(AFTER)})[(p_partkey // 3) % {len(AFTER)} + 1], '{{price}}', floor(p_retailprice)::bigint::varchar), '{{size}}', p_size::varchar)) as text from part),
l as (select query_id, lower(text) as low, case {_cases((f"regexp_matches(lower(text), {_q(p)})", i) for i, p in _SIZES)} end as hit from a),
s as (select query_id, upper(case hit {_cases((i, f"regexp_extract(low, {_q(p)}, 1)") for i, p in _SIZES)} end) as b,
      coalesce(case hit {_cases((i, f"trim(regexp_replace(regexp_replace(low, {_q(p)}, ' '), '[ ]+', ' ', 'g'))") for i, p in _SIZES)} end, low) as q from l),
c as (select query_id, replace(case b {_cases((_q(k), _q(v)) for k, v in V.SIZE_ALIASES.items())} else b end, ' ', '') as size, q as cleaned,
      list_filter({_listed(V.QUERY_COLORS)}, lambda x: regexp_matches(q, '\b' || x || '\b')) as colors,
      coalesce({", ".join(f"nullif(regexp_extract(q, {_q(p)}, 1), '')" for p in V.MAX_PRICE_PATTERNS)})::double as max_price,
      coalesce(nullif(regexp_extract(q, '(\d+(?:\.\d+)?)\s*\+?\s*(?:star|rating)', 1), ''), nullif(regexp_extract(q, 'above\s+(\d+(?:\.\d+)?)', 1), ''))::double as min_rating,
      case {_cases((f"regexp_matches(q, {_q(whole_word([b]))})", _q(b.capitalize())) for b in V.QUERY_BRANDS)} end as brand,
      case {_cases((f"regexp_matches(q, {_q(whole_word([c, *s]))})", _q(c)) for c, s in V.CATEGORY_SYNONYMS.items())} end as category,
      regexp_extract(q, {_BIND}, 1) as c1, regexp_extract(q, {_BIND}, 2) as i1, regexp_extract(q, {_BIND}, 3) as c2, regexp_extract(q, {_BIND}, 4) as i2 from s),
t as (select *, list_concat(list_filter(case category {_cases((_q(c), _listed([c, *s])) for c, s in V.CATEGORY_SYNONYMS.items())} else []::varchar[] end, lambda x: x = category or regexp_matches(cleaned, '\b' || x || '\b')),
      list_filter(regexp_extract_all(cleaned, '[a-z0-9-]+'), lambda x: x not in ({", ".join(map(_q, V.QUERY_STOP_WORDS))}) and not regexp_full_match(x, '[0-9]+'))) as found from c)
select query_id, size, cleaned, array_to_string(colors, ',') as colors, max_price, min_rating, brand, category,
 array_to_string(list_sort(list_distinct(list_concat(case when len(found) > 0 then found when len(colors) > 0 then colors else [cleaned] end,
   flatten(list_transform(colors, lambda x: case x when 'red' then ['red', 'maroon'] when 'blue' then ['blue', 'navy'] else [x] end))))), ',') as terms,
 array_to_string(list_sort(list_filter([case when c1 in {_COLORS} and not (i1 = i2 and c2 in {_COLORS}) then i1 || '=' || c1 end, case when c2 in {_COLORS} then i2 || '=' || c2 end], lambda x: x is not null)), ',') as bindings from t"""


def n02_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


def n18_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str):
        return F.coalesce(F.try_parse_url(F.col("url"), F.lit(name)), F.lit(""))

    return views.table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


ROBOTS = """User-agent: otherbot
Disallow: /

User-agent: *
User-agent: lodestar
Disallow: /*/8   # pages that begin with 8
Disallow: /de/
Allow: /de/*0$
Disallow: /*?page=
Allow: /fr/*?page=2&ref=x
Disallow:
"""


def f12_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules for every host; addresses of all pages."""
    pages = views.table(spark, sf_dir, "pages").select("url", F.try_parse_url("url", F.lit("HOST")).alias("host")).distinct()
    files = pages.select("host").distinct().withColumn("text", F.lit(ROBOTS))
    return robots.allowed(pages, robots.rules(files), "Lodestar/1.0").select("url", "allowed")


SPELLINGS = ["Navy-Blue", "off-white silk", "wine", "MULTI cotton blend", "teal denim"]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(T.strings(SPELLINGS), (F.col("p_partkey") % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), extra).alias("name"))


_NAMED_SQL = f"named as (select p_partkey, p_name || ' ' || lower(p_type) || ' ' || list_extract({_listed(SPELLINGS)}, p_partkey % 5 + 1) as name from part)"


def n07_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("p_partkey", F.array_join(T.infer_colors([F.col("name")]), ",").alias("colors"))


def n09_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("p_partkey", F.array_join(T.infer_materials([F.col("name")]), ",").alias("materials"))


def n12_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, mrp = F.col("price"), F.col("mrp")
    return views.listing(spark, sf_dir).select("id", T.discount_half_even(price, mrp).alias("half_even"), T.discount_truncated(price, mrp).alias("truncated"))


def n13_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.contains(F.lower("name"), F.lower("brand")), F.lit("")).otherwise(F.col("brand"))
    return views.listing(spark, sf_dir).select("id", T.joined(brand, F.col("name"), F.col("category"), F.col("color"), F.col("product_type")).alias("text"))


def n15_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of sizes made of each part's size number."""
    ways = [F.concat(F.lit("uk "), "p_size"), F.concat("p_size", F.lit(" IND")), F.lit("2xl"), F.lit(" free  size"), F.lit("x-large"), F.concat(F.lit("IN-"), "p_size")]
    return views.table(spark, sf_dir, "part").select("p_partkey", T.normalize_size(F.element_at(F.array(*ways), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("size"))


def n01_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.format_number("p_retailprice", 2)
    ways = [F.concat(F.lit("Rs. "), two), F.concat(F.lit("$"), two), F.lit("n/a"), F.concat(two, F.lit("/-")), F.lit("")]
    return views.table(spark, sf_dir, "part").select("p_partkey", T.to_price(F.element_at(F.array(*ways), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("price"))


def n05_clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("p_name", "p_brand", "p_type", F.concat(F.lit("  New   "), "p_type"), F.lit("a"), F.lit("one two three four five"), F.upper("p_name"))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.clean_tags(tags), "|").alias("tags"))


def p01_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as exports of four shops, in each one's own fields, made canonical."""
    part = views.table(spark, sf_dir, "part")

    def pick(values: list[str], number):
        return F.element_at(T.strings(values), (number % len(values) + 1).cast("int"))

    def export(k: int, shop: str) -> DataFrame:
        name = {c: f for f, c in V.SHOP_FIELDS[shop].items()}
        return part.where(F.col("p_partkey") % len(V.SHOP_FIELDS) == k).select(
            F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias(name["name"]), pick(["Men's Shirts", "kurti", "Tops"], F.col("p_size")).alias(name["category"]),
            pick(["Red, Blue", "red/ navy", " Teal "], F.col("p_partkey")).alias(name["color"]), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias(name["price"]),
            F.format_number(F.col("p_retailprice") * 1.25, 2).alias(name["mrp"]), pick(["In Stock", "no"], F.col("p_size")).alias(name["in_stock"]),
        )

    out = reduce(DataFrame.unionByName, [canonical(export(k, shop), shop) for k, shop in enumerate(V.SHOP_FIELDS)])
    return out.select("_id", "name", "category", F.array_join("color", ",").alias("color"), "price", "mrp", "discount_percent", "in_stock", "source")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split("p_name", " ")
    return views.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), word[1].alias("category"), F.array(word[0]).alias("colors"), F.array(F.lower("p_type")).alias("tags"))


def r19_suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = spark.createDataFrame([(1, "gi"), (2, " Ri"), (3, "w"), (4, "small"), (5, "eco"), (6, "zz"), (7, "an")], "query_id long, text string")
    return S.by_prefix(typed, S.catalogue_terms(_products(spark, sf_dir))).select("query_id", "term", F.col("place").cast("long").alias("place"))


def r19_suggest_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "gizmoo"), (2, "widgt"), (3, "plat"), (4, "smal"), (5, "xyzzy")], "query_id long, text string")
    return S.suggestions(asked, S.catalogue_terms(_products(spark, sf_dir))).select("query_id", F.array_join("terms", ",").alias("terms"))


def n20_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.from_json(T.lenient_json(F.col("props")), "k long")["k"].alias("k"))


def st01_cdc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users' rows: the last one of a user counts, and an error deletes."""
    return latest(views.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").where("event_type <> 'error'").select("user_id", "event_id", "value")


def _minute(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias("start")


def st07_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in each hour over a limit of 2 (events are sparse)."""
    return W.rate_limited(views.table(spark, sf_dir, "events"), "user_id", "1 hour", 2).select("user_id", _minute("start"), "n", "refused")


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(views.table(spark, sf_dir, "events"), "1 hour").select(_minute("start"), "event_type", "n")


def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding(views.table(spark, sf_dir, "events"), "2 hours", "1 hour").select(_minute("start"), "n")


def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(views.table(spark, sf_dir, "events"), "user_id", "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = [
    qp_parse_queries, qp9_parse_cache, n02_strip_html, n18_url_parts, f12_robots, n07_colors, n09_materials, n12_discounts, n13_embedding_text, n15_sizes, n01_prices, n05_clean_tags, p01_rename, r19_suggest_prefix,
    r19_suggest_fuzzy, n20_json_props, st01_cdc_latest, st07_rate_limit, ext_tumbling, ext_sliding, ext_session,
]
_FAMILY = "case n " + _cases((_q(k), _listed(list(dict.fromkeys([k, *v])))) for k, v in V.COLOR_FAMILIES.items()) + " else []::varchar[] end"
_COLOR_RE = _q(rf"(?i)\b({T.either([*V.COLOR_FAMILIES, 'off-white'])})\b")
_MATERIAL_RE = _q(rf"(?i)\b({T.either(V.MATERIALS)})\b")
SQL = {
    "qp_parse_queries": QP_SQL,
    "qp9_parse_cache": """with a as (select p_partkey, p_name || ' ' || p_size as key, p_name from part), c as (select key, min(p_partkey % 120) as minutes from a where p_partkey % 3 = 0 and p_partkey % 120 < 60 group by key),
n as (select count(distinct key) as n_after from a)
select p_partkey as query_id, c.key is not null as cached, coalesce(minutes, 0)::bigint as minutes, case when c.key is not null then 'kept' end as category, case when p_name like 'red %' then 'red' when p_name like 'blue %' then 'blue' else '' end as colors, n_after
from a left join c using (key), n""",
    "n02_strip_html": r"""with e as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as t from pages)
select page_id, case when length(t) > 500 then regexp_replace(left(t, 500), ' [^ ]*$', '') || '…' else t end as plain from e""",
    "n18_url_parts": r"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as query from pages""",
    "f12_robots": r"""with u as (select distinct url, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '(\?[^#]+)', 1) as path from pages),
r(pattern, re, allow) as (values ('/*/8', '^/.*/8', false), ('/de/', '^/de/', false), ('/de/*0$', '^/de/.*0$', true), ('/*?page=', '^/.*\?page=', false), ('/fr/*?page=2&ref=x', '^/fr/.*\?page=2&ref=x', true))
select url, coalesce(max_by(allow, length(pattern) * 2 + allow::int), true) as allowed from u left join r on regexp_matches(path, re) group by url""",
    "n07_colors": f"""with {_NAMED_SQL}, m as (select p_partkey, list_transform(regexp_extract_all(name, {_COLOR_RE}, 1), lambda x: replace(lower(x), '-', ' ')) as ns from named),
f as (select p_partkey, flatten(list_transform(ns, lambda n: {_FAMILY})) as fs from m)
select p_partkey, array_to_string(list_filter(fs, lambda x, i: list_position(fs, x) = i), ',') as colors from f""",
    "n09_materials": f"""with {_NAMED_SQL}, m as (select p_partkey, list_transform(regexp_extract_all(name, {_MATERIAL_RE}, 1), lambda x: lower(x)) as fs from named)
select p_partkey, array_to_string(list_filter(fs, lambda x, i: list_position(fs, x) = i), ',') as materials from m""",
    "n12_discounts": f"with {views.LISTING_SQL} select id, (case when mrp > price then round_even((mrp - price) / mrp * 100, 0) else 0 end)::int as half_even, (case when mrp > price then trunc((mrp - price) / mrp * 100) else 0 end)::int as truncated from listing",
    "n13_embedding_text": f"with {views.LISTING_SQL} select id, concat_ws(' ', case when not contains(lower(name), lower(brand)) then brand end, name, category, color, product_type) as text from listing",
    "n15_sizes": "select p_partkey, case p_partkey % 6 when 2 then 'XXL' when 3 then 'ONE SIZE' when 4 then 'XL' else p_size::varchar end as size from part",
    "n01_prices": "select p_partkey, case p_partkey % 5 when 0 then ('.' || format('{:.2f}', p_retailprice)) when 1 then format('{:.2f}', p_retailprice) when 3 then format('{:.2f}', p_retailprice) end as s, try_cast(s as double) as price from part",
    "n05_clean_tags": "select p_partkey, p_name || '|' || lower(p_type) || '|new ' || lower(p_type) as tags from part",
    "p01_rename": """with s as (select *, ['amazon', 'myntra', 'ajio', 'flipkart'][p_partkey % 4 + 1] as source, format('{:.2f}', p_retailprice)::double as price, format('{:.2f}', p_retailprice * 1.25e0)::double as mrp from part)
select source || '_' || p_partkey as _id, p_name as name, ['shirt', 'kurta', 'tshirt'][p_size % 3 + 1] as category, ['red,blue', 'red,navy', 'teal'][p_partkey % 3 + 1] as color, price, mrp,
(case when mrp > price then trunc((mrp - price) / mrp * 100) else 0 end)::int as discount_percent, p_size % 2 = 0 as in_stock, source from s""",
    "r19_suggest_prefix": """with t as (select distinct unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) as term from part), q(query_id, q) as (values (1::bigint, 'gi'), (2, 'ri'), (4, 'small'), (5, 'eco'), (6, 'zz'), (7, 'an'))
select query_id, term, row_number() over (partition by query_id order by term) as place from q join t on starts_with(term, q) qualify place <= 5""",
    "n20_json_props": "select event_id, json_extract(props, '$.k')::bigint as k from events",
    "st01_cdc_latest": "select user_id, event_id, value from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type <> 'error'",
    "st07_rate_limit": "select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, count(*) as n, count(*) - 2 as refused from events group by user_id, date_trunc('hour', ts) having count(*) > 2",
    "ext_tumbling": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by date_trunc('hour', ts), event_type",
    "ext_sliding": "select strftime(h, '%Y-%m-%d %H:%M') as start, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as h from events) group by h",
    "ext_session": """with e as (select user_id, ts, event_id, (ts >= lag(ts) over w + interval 12 hour or lag(ts) over w is null)::int as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""",
}
SQL["n01_prices"] = f"select p_partkey, price from ({SQL['n01_prices']})"
