"""Behaviour of single operators on rows of our own."""

import datetime as dt
import gzip
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions import text as T
from lodestar.operators import catalog as C
from lodestar.operators import feedback as E
from lodestar.operators import learning as L
from lodestar.operators import matching as M
from lodestar.operators import normalize as N
from lodestar.operators import ranking as K
from lodestar.operators import retrieval as R
from lodestar.operators import suggest as S
from lodestar.sources import catalog as SC
from lodestar.sources import pages as PG
from lodestar.sources import robots as RB
from lodestar.sources import sinks as SK
from lodestar.streaming import changes as ST


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_tokens_join_over_deleted_marks(spark):
    assert column(spark, ["T-Shirt, RED\nnew  one", None, "é!"], "string", T.tokens) == [["tshirt", "rednew", "one"], [], []]


def test_sizes(spark):
    assert column(spark, ["2xl", "UK 8", "8 ind", "Free  Size", " x-large ", "", None, "M"], "string", T.normalize_size) == ["XXL", "8", "8", "ONE SIZE", "XL", None, None, "M"]
    sizes = spark.createDataFrame([("XL",), ("28",), ("S",), ("XXL",), ("32",), ("M",), ("W",)], "s string")
    assert [r.s for r in sizes.orderBy(T.size_order(F.col("s"))).collect()] == ["S", "M", "XL", "XXL", "28", "32", "W"]


@pytest.mark.parametrize(("want", "sizes", "available", "yes"), [("L", ["S", "L"], ["S"], False), ("L", ["S", "L"], None, True), ("L", [], None, True), ("XL", ["Free Size"], [], True), (None, ["S"], [], True), ("L", None, None, True), ("L", ["L"], [], False)])
def test_size_available(spark, want, sizes, available, yes):
    row = spark.createDataFrame([(want, sizes, available)], "w string, s array<string>, a array<string>")
    assert row.select(T.size_available(F.col("w"), F.col("s"), F.col("a"))).first()[0] is yes


def test_category_matches(spark):
    rows = [("tshirt", "tee", "", True), ("tshirt", "shirt", "tee", False), ("tee", "steel", "steel frame", False), ("watch", "gadgets", "sports watch", True), (None, "x", "", True), ("co-ord set", "misc", "a co-ord for two", True)]
    df = spark.createDataFrame(rows, "w string, c string, t string, yes boolean")
    assert df.where(T.category_matches(F.col("w"), F.col("c"), F.col("t")) != F.col("yes")).collect() == []


def test_prices_cases_and_codes(spark):
    assert column(spark, ["Rs 1,299", "1.2.3", "n/a", "", None], "string", T.to_price) == [1299.0, None, None, None, None]
    assert column(spark, ["RARE RABBIT", "powerlook-apparels", "H&M Kids", ""], "string", T.nice_case) == ["Rare Rabbit", "Powerlook Apparels", "H&M Kids", ""]
    assert column(spark, ["BEARSKY-RD", "Blue Shirt", "AB"], "string", T.looks_like_code) == [True, False, False]
    assert column(spark, [["Red", "red", "Colour_White", "x", "123", "a b c d e", " Silk  Saree "]], "array<string>", T.clean_tags) == [["red", "silk saree"]]
    assert column(spark, ["Navy Blue & off-white wine"], "string", lambda c: T.infer_colors([c])) == [["navy blue", "navy", "blue", "off white", "white", "wine", "maroon", "red"]]
    assert column(spark, ["https://cdn.shopify.com/a/b.jpg?v=1&width=9", "https://x.org/b.jpg"], "string", lambda c: T.thumbnail_url(c, 400)) == ["https://cdn.shopify.com/a/b.jpg?v=1&width=400", "https://x.org/b.jpg"]


def test_discounts_round_two_ways(spark):
    df = spark.createDataFrame([(97.5, 100.0), (799.0, 1099.0), (100.0, 100.0)], "p double, m double")
    got = df.select(T.discount_half_even(F.col("p"), F.col("m")), T.discount_truncated(F.col("p"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(2, 2), (27, 27), (0, 0)]


RAW = {f: None for f in PG.FIELDS} | {"site": "s1"}


def raw(**given):
    return RAW | {"tags": [], "images": [], "options": [], "variants": [], "url": "u"} | given


def variant(price, compare=None, available=True, options=()):
    return {"price": price, "compare_at_price": compare, "available": available, "options": list(options), "sku": None}


def normalized(spark, *products, non_fashion=False):
    sites = spark.createDataFrame([("s1", "Shop One", None, "women", "INR", non_fashion)], "site string, site_name string, site_brand string, default_gender string, site_currency string, include_non_fashion boolean")
    rows = spark.createDataFrame([tuple(p[f] for f in [*PG.FIELDS, "site"]) for p in products], schemas.RAW_PRODUCT + ", site string")
    return {r.source_product_id: r for r in N.normalized(rows, sites).collect()}


def test_normalizes_listings(spark):
    got = normalized(
        spark,
        raw(source_product_id="a/1", title="Red Silk Blend Saree with Blouse Piece", vendor="RARE-RABBIT", tags=["Colour_White", "SKU:1", "Festive", "12"], variants=[variant("1500", "2000", False), variant("1200", "1999"), variant("1300")], images=["//cdn/x.jpg", ""]),
        raw(source_product_id="2", title="RR303158", vendor="Blue Linen Shirt", variants=[variant("799", "1099", options=["M"]), variant("799", None, False, ["L"])], options=[{"name": "Size", "values": ["M", "L", "XL"]}]),
        raw(source_product_id="3", title="Saree Gift Card", variants=[variant("100")]), raw(source_product_id="4", title="Cotton Shirt", variants=[]), raw(source_product_id="5", title="Spoon", variants=[variant("9")]),
    )
    assert set(got) == {"a/1", "2"}
    a, b = got["a/1"], got["2"]
    assert (a._id, a.category, a.subcategory, a.brand, a.gender) == ("s1_a_1", "saree", "ethnicwear", "Rare Rabbit", "women")
    assert (a.price, a.mrp, a.discount_percent, a.in_stock) == (1200.0, 1999.0, 40, True)
    assert a.material == ["silk blend"] and a.color == ["red", "white"] and a.images == ["https://cdn/x.jpg"] and a.tags == ["festive"]
    assert (b.name, b.model_code, b.category, b.sizes, b.available_sizes, b.discount_percent) == ("Blue Linen Shirt", "RR303158", "shirt", ["M", "L"], ["M"], 27)
    assert set(normalized(spark, raw(source_product_id="5", title="Spoon", variants=[variant("9")]), non_fashion=True)) == {"5"}


def test_head_noun_decides_category(spark):
    titles = {"Denim Jacket for Women": "jacket", "Shirt Dress": "dress", "Kurta with Trousers and Dupatta": "kurta set", "Polo T-Shirt": "tshirt", "Leather Sling Bag": "bag", "Night Dress": "nightwear"}
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", N.infer_category("t", F.lit("Top"), F.lit("")).alias("c"))
    assert {r.t: r.c.category for r in df.collect()} == titles


PAGE = """<html><head><meta property="og:title" content="Old"><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "name": "Blue &amp; Shirt", "sku": "K1",
 "image": ["/a.jpg", {"url": "b.jpg"}], "brand": {"name": "Asha"}, "offers": {"@type": "AggregateOffer", "offers": [{"price": 999, "availability": "https://schema.org/InStock", "size": "M",
 "priceSpecification": {"priceType": "StrikethroughPrice", "price": 1299},}, {"price": "899", "availability": "OutOfStock", "size": "L"}]}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": "12"},}]}</script></head></html>"""
OPEN_GRAPH = '<meta property="og:title" content="Mug"><meta property="product:price:amount" content="25.5"><meta property="product:original_price:amount" content="30">'


def test_products_in_pages(spark):
    pages = spark.createDataFrame([("https://x.org/p/1", PAGE), ("https://x.org/p/2", OPEN_GRAPH), ("https://x.org/p/3", "<p>none</p>"), ("https://x.org/p/4", None)], "url string, html string")
    got = {r.source_product_id: r for r in PG.products_in_pages(pages).collect()}
    assert set(got) == {"K1", "https://x.org/p/2"}
    k = got["K1"]
    assert (k.brand, k.rating, k.review_count, k.images) == ("Asha", 4.5, 12, ["https://x.org/a.jpg", "https://x.org/p/b.jpg"])
    assert [(v.price, v.compare_at_price, v.available, v.options) for v in k.variants] == [("999", "1299", True, ["M"]), ("899", None, False, ["L"])]
    assert got["https://x.org/p/2"].variants[0].compare_at_price == "30"


def test_odd_pages(spark):
    """A page that isn't as it should be gives what it can, and never fails the rest."""
    ld = lambda text: f"<script type='application/ld+json'>{text}</script>"
    odd = {
        "deep": ld("[" * 100_000), "number": ld('{"@type": "Product", "name": "N", "aggregateRating": {"ratingValue": "x", "reviewCount": "Infinity"}}'), "variant": ld('{"@type": "ProductGroup", "name": "V", "hasVariant": 5}'),
        "broken": ld("{]") + ld('{"@type": "http://schema.org/Product", "name": ["First", "Second"], "image": {"contentUrl": "x.jpg"}, "offers": [7, {"lowPrice": 5, "priceCurrency": "EUR"}], "brand": null}'),
        "group": ld('{"@type": "ProductGroup", "productGroupID": "G", "hasVariant": [{"size": "S", "offers": {"price": 3, "sku": "a"}}, {"size": {"name": "M"}, "offers": [{"price": 4, "availability": {"@value": "SoldOut"}}]}, 3]}'),
        "nothing": "", "type": ld('{"@type": {"a": 1}, "x": [{"@type": "Product", "name": 12, "offers": {"priceSpecification": [{"price": 9}, {"price": 8}, {"priceType": "https://schema.org/ListPrice", "price": 10}]}}]}'),
        "tags": "<META content='T &amp; U' property=og:title><meta name='product:price:amount' content=\"7\"><meta property='og:availability' content='out of stock'><meta property='og:image' content='i.png'>", "untitled": "<meta property='product:price:amount' content='7'>",
    }
    rows = spark.createDataFrame([(f"https://x.org/{k}/", v) for k, v in odd.items()], "url string, html string")
    got = {r.url.split("/")[3]: r for r in PG.products_in_pages(rows).collect()}
    assert set(got) == {"number", "variant", "broken", "group", "type", "tags"}
    assert (got["number"].rating, got["number"].review_count, got["variant"].variants) == (0.0, 0, [])
    assert (got["broken"].title, got["broken"].brand, got["broken"].images, got["broken"].currency, [v.price for v in got["broken"].variants]) == ("First", "", ["https://x.org/broken/x.jpg"], "EUR", ["5"])
    assert [(v.price, v.options, v.available, v.sku) for v in got["group"].variants] == [("3", ["S"], True, "a"), ("4", ["M"], False, None)] and got["group"].options[0].values == ["M", "S"]
    assert (got["type"].title, got["type"].variants[0].price, got["type"].variants[0].compare_at_price) == ("12", "9", "10")
    assert (got["tags"].title, got["tags"].variants[0].available, got["tags"].images) == ("T & U", False, ["https://x.org/tags/i.png"])


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>".encode()
    urls = gzip.compress(f"<urlset {ns}><url><loc> http://x/p/1 </loc></url><url><loc>http://x/q</loc></url><url/></urlset>".encode())
    files = spark.createDataFrame([("a", index), ("b", urls), ("c", b"not xml"), ("d", None)], "loc string, body binary")
    got = PG.crawl_frontier(files, spark.createDataFrame([("a",)], "loc string"), "/p/")
    assert [r.loc for r in got.collect()] == ["http://x/p/1"]
    chain = [(f"s{i}", f"<sitemapindex {ns}><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>".encode()) for i in range(21)]
    leaf = [("s21", f"<sitemapindex {ns}><sitemap><loc>product-1</loc></sitemap><sitemap><loc>news</loc></sitemap></sitemapindex>".encode())]
    last = [(name, f"<urlset {ns}><url><loc>{loc}</loc></url></urlset>".encode()) for name, loc in (("product-1", "z"), ("news", "a"))]
    deep = spark.createDataFrame(chain + leaf + last, "loc string, body binary")
    first = spark.createDataFrame([("s0",)], "loc string")
    assert {r.loc for r in PG.crawl_frontier(deep, first).collect()} == {"a", "z"} and [r.loc for r in PG.crawl_frontier(deep, first, most=1).collect()] == ["z"]


def test_robots(spark):
    text = "User-agent: a\nUser-agent: lode\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /\n# end"
    rules = RB.rules(spark.createDataFrame([("x", text), ("y", "User-agent: *\nDisallow:\n")], "host string, text string"))
    urls = spark.createDataFrame([("http://x/private/a", "x"), ("http://x/private/open/b", "x"), ("http://x/d.pdf", "x"), ("http://x/d.pdf?v=1", "x"), ("http://y/z", "y"), ("http://n/z", "n")], "url string, host string")
    assert {r.url: r.allowed for r in RB.allowed(urls, rules, "Lodestar/2").collect()} == {"http://x/private/a": False, "http://x/private/open/b": True, "http://x/d.pdf": False, "http://x/d.pdf?v=1": True, "http://y/z": True, "http://n/z": True}
    assert {r.url for r in RB.allowed(urls, rules, "Other").where("not allowed").collect()} == {r.url for r in urls.where("host = 'x'").collect()}


def test_feed_catalog_and_files(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"products": [{"id": 7, "title": "Shirt", "handle": "s", "tags": "a, b,", "images": [{"position": 2, "src": "y"}, {"position": 1, "src": "x"}], "variants": [{"price": "5", "option1": "M"}]}, {"id": 7, "title": "Shirt", "handle": "s"}]}')
    rows = SC.read_feed(spark, str(tmp_path / "feed.json")).collect()
    assert len(rows) == 1 and rows[0].tags == ["a", "b"] and rows[0].images == ["x", "y"]
    assert SC.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    assert SC.read_index(spark, str(tmp_path / "none")) is None
    (tmp_path / "q.txt").write_text("# head\n\nred saree\n  blue shirt \n")
    assert [r.text for r in SC.read_query_file(spark, str(tmp_path / "q.txt")).collect()] == ["red saree", "blue shirt"]
    (tmp_path / "l.csv").write_bytes(b"\xef\xbb\xbfquery,label\nred,2\n")
    assert SC.read_labels(spark, str(tmp_path / "l.csv")).collect() == [Row(query="red", label="2")]
    assert [SC.catalog_in_use("auto", r) for r in (True, False)] == ["live", "demo"]
    one = spark.createDataFrame([('["Clothing >> Women\'s Clothing"]',)], "t string")
    assert one.select(SC.category_path(F.col("t"))).first()[0] == ["clothing", "women's_clothing"]
    SK.write_index(one, str(tmp_path / "i"), 3, F.lit("now"))
    assert SC.read_index(spark, f"{tmp_path}/i_meta").collect() == [Row(n=1, version=3, built_at="now")]


def test_history_and_alerts(spark):
    at = [dt.datetime(2024, 1, d) for d in (1, 5, 9, 20)]
    obs = spark.createDataFrame([("p", i + 1, at[i], p, None, True) for i, p in enumerate([999.0, 999.0, 799.0, 799.0])], "part string, n int, at timestamp_ntz, price double, mrp double, in_stock boolean")
    changes = C.price_changes(obs)
    assert [(r.n, r.price_changed) for r in changes.orderBy("n").collect()] == [(1, False), (3, True)]
    s = C.history_summary(changes, F.lit("2024-01-21").cast("timestamp_ntz")).first()
    assert (s.points, s.previous_price, s.price_dropped, s.lowest, s.highest, s.is_lowest, s.last_change) == (2, 999.0, True, 799.0, 999.0, True, at[2])
    alerts = spark.createDataFrame([(1, "p", "A@x.org", 800.0, True), (2, "p", "b@x.org", 700.0, True)], "alert_id int, product_id string, email string, target_price double, active boolean")
    products = spark.createDataFrame([("p", 799.0, True)], "id string, price double, in_stock boolean")
    due = C.due_alerts(alerts, products)
    assert [r.alert_id for r in due.collect()] == [1]
    assert SK.notice_texts(due).first().body == "p is now 799 (target 800)"
    assert C.due_alerts(C.after_notice(alerts, due), products).count() == 0


def test_measures(spark):
    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 0), (2, "a", 0), (3, "a", 2), (3, "q", 2)], "query_id long, doc_id string, rel int")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (3, "a", 1), (3, "x", 2)], "query_id long, doc_id string, rank int")
    got = {r.query_id: r for r in E.ranking_measures(ranked, judged, 3).collect()}
    assert got[1].ndcg == pytest.approx(1.0) and got[2].ndcg is None and got[2].ndcg_legacy == 1.0
    assert got[3].recall == 0.5 and got[3].rr == 1.0 and got[3].judged == 0.5 and got[2].recall is None


def test_diversity_and_caps(spark):
    rows = [(1, f"d{i}", "ab"[i > 3], 1.0 - i / 100, i + 1) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, source string, score double, rank int")
    order = lambda **k: [r.doc_id for r in K.diversified(df, **k).orderBy("rank").collect()]
    assert order()[:2] == ["d0", "d4"] and order(strength=0.0) == [f"d{i}" for i in range(6)]
    assert order(most_per_source=1)[:2] == ["d0", "d4"] and len(order(most_per_source=1)) == 6


def test_matching(spark):
    v = [1.0, 0.0, 0.0]
    near = [0.99, 0.141, 0.0]
    rows = [("a", "s1", "shirt", "X", "Blue Shirt", 100.0, None, v), ("b", "s2", "shirt", "X", "Other", 120.0, None, near), ("c", "s2", "shirt", "Y", "Nothing", 110.0, None, v), ("d", "s3", "shoes", "X", "Blue Shirt", 100.0, None, v), ("e", "s3", "shirt", "X", "Shirt", 900.0, None, v)]
    items = spark.createDataFrame(rows, "id string, source string, category string, brand string, name string, price double, gtin string, v array<float>")
    pairs = M.match_pairs(items)
    assert [(r.a, r.b) for r in pairs.collect()] == [("a", "b")]
    assert {r.id for r in M.match_groups(pairs, items).collect()} == {"a", "b"}
    assert M.match_groups(pairs.limit(0), items).count() == 0


def test_suggestions(spark):
    terms = spark.createDataFrame([(t,) for t in ["saree", "sari", "satin", "shirt", "shoes"]], "term string")
    asked = spark.createDataFrame([(1, "sa"), (2, "shrt"), (3, "s")], "query_id long, text string")
    assert {r.query_id: r.terms for r in S.suggestions(asked, terms).collect()} == {1: ["saree", "sari", "satin"], 2: ["shirt"]}


def test_fusion_drops_lists_without_weight(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    two = spark.createDataFrame([(1, 12, 1)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in R.rrf([one, two], [1.0]).orderBy("rank").collect()] == [10, 11]
    assert [r.doc_id for r in R.rrf([one, two]).orderBy("rank").collect()] == [10, 12, 11]


def test_cosine_ignores_bad_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [0.6, 0.8])], "doc_id long, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, v array<double>")
    assert [(r.doc_id, r.score) for r in R.cosine_search(q, v, 5).orderBy("rank").collect()] == [(1, 1.0), (6, 0.6)]


def test_model_beats_fusion_and_ships_only_then(spark):
    rows = spark.range(3000).select((F.col("id") % 150).alias("session"), F.col("id").alias("item"), (F.col("id") / 150).cast("int").alias("position")).withColumns({f: F.lit(0.0) for f in K.FEATURES})
    rows = rows.withColumns({"f2": (L.unit_hash("item", F.lit(1)) < 0.3).cast("double"), "f1": 1.0 / (60 + F.col("position"))}).withColumn("label", (F.col("f2") > 0).cast("int"))
    model = L.train_ranker(rows.where("session < 100"), trees=3, depth=2)
    assert L.importance(model)[0][0] == "f2"
    got = {r.ordering: r.ndcg for r in L.compared_orders(L.scored_by(model, rows.where("session >= 100")).withColumnRenamed("score", "score_model")).collect()}
    assert got["score_model"] > got["fusion"]
    assert L.better(got["score_model"], got["fusion"]) and not L.better(0.1, 0.2) and L.better(0.1, 0.2, force=True)


def test_change_stream_merges(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text('\n'.join(['{"_id": "a", "name": "x", "price": 5}', '{"_id": "b", "price": 1, "_action": "upsert"}', '{"name": "no id"}', "junk"]))
    (source / "2.json").write_text('\n'.join(['{"_id": "a", "price": 4}', '{"_id": "b", "_action": "delete"}', '{"_id": "c", "price": 2}']))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).select("value", F.xxhash64("value").alias("seq"))
    built = []
    ST.merge_stream(ST.parsed(lines), str(out), str(tmp_path / "check"), {"availableNow": True}, lambda t: built.append(t.count())).awaitTermination()
    got = {r._id: (r.name, r.price) for r in ST.current(spark, str(out)).collect()}
    assert got == {"a": ("x", 4.0), "c": (None, 2.0)} and len(built) == 2


def test_price_changes_by_state(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = '{{"id": "a", "at": "2024-01-0{}T00:00:00Z", "price": {}, "in_stock": true}}'.format
    (source / "1.json").write_text("\n".join([row(2, 5), row(1, 6)]))
    (source / "2.json").write_text("\n".join([row(3, 5), row(4, 3)]))
    stream = spark.readStream.schema("id string, at timestamp, price double, mrp double, in_stock boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = ST.price_change_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    got = spark.read.parquet(str(out)).orderBy("at").collect()
    assert sorted((r.price, r.price_changed) for r in got) == [(3.0, True), (5.0, True), (6.0, False)]


def test_robots_waits_and_sitemaps(spark):
    text = "crawl-delay: 9\nUser-agent: a\nUser-agent: B\nCrawl-delay: x\nCrawl-delay: 1.5\nDisallow: /\nSitemap: https://h/1.xml\n\nUser-agent: c\nAllow: /\n"
    files = spark.createDataFrame([("h", text)], "host string, text string")
    assert {(r.agent, r.delay) for r in RB.crawl_delays(files).collect()} == {("a", 1.5), ("b", 1.5)}
    assert [r.loc for r in RB.sitemap_lines(files).collect()] == ["https://h/1.xml"]


def test_feeds_that_are_complete(spark, tmp_path):
    def feed(name, page, ids):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"page-{page}.json").write_text(json.dumps({"products": [{"id": i, "title": f"t{i}", "handle": f"h{i}"} for i in ids]}))

    feed("all", 1, [1, 2, 3])
    feed("all", 2, [3, 4])
    feed("new", 1, [9])
    ask = lambda **given: tuple(SC.feeds_complete(spark, f"{tmp_path}/*/*.json", page_size=3, **given).first())
    assert ask() == (5, True) and ask(most=5) == (5, False) and ask(most=6) == (5, True)
    feed("new", 1, [9, 10, 11])
    assert ask() == (7, False)
    assert [r.source_product_id for r in SC.read_feed(spark, f"{tmp_path}/*/*.json", most=2).orderBy("source_product_id").collect()] == ["1", "2"]


def test_csv_escapes(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes('name,product_category_tree\n"Caf\\u00e9 ""X""","[""A B >> C""]"\nM\xfcller \\x41,\n"bad \\u12",\n'.encode("latin-1"))
    got = SC.read_csv_products(spark, f"{tmp_path}/p.csv").collect()
    assert [r.name for r in got] == ['Café "X"', "Müller A", "bad \\u12"] and got[0].category_path == ["a_b", "c"]


def test_config_and_samples(spark):
    settings, sites = SC.read_config('[crawler]\ncontact = "a@x"\ndelay = 2\n[[site]]\nid = "s"\n', {"CRAWLER_CONTACT": "b@x", "FEEDBACK_DB": "f.db"})
    assert settings == {"contact": "b@x", "delay": 2, "alerts_db": "f.db"} and sites == [{"id": "s"}]
    rows = spark.range(100)
    first = [r.id for r in SC.sampled(rows, 5, 1, "id").collect()]
    assert first == [r.id for r in SC.sampled(rows.repartition(7), 5, 1, "id").collect()] and first != [r.id for r in SC.sampled(rows, 5, 2, "id").collect()]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "B")], "_id int, name string, brand string")
    whole = SK.replaced(rows, spark.createDataFrame([(2, "c")], "_id int, name string"))
    assert sorted(tuple(r) for r in whole.collect()) == [(1, "a", None), (2, "c", None)]
    SK.export_catalog(rows, f"{tmp_path}/c")
    assert SC.read_catalog(spark, f"{tmp_path}/c", "_id int, name string").count() == 2
    SK.append_log(spark.createDataFrame([("q", [0.12345678])], "query_id string, features array<double>"), f"{tmp_path}/log")
    SK.append_log(spark.createDataFrame([("q", [1.0])], "query_id string, features array<double>"), f"{tmp_path}/log")
    assert sorted(r.features[0] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [0.123457, 1.0]
    SK.write_labels(spark.createDataFrame([("q", "3")], "query string, label string"), f"{tmp_path}/labels")
    assert SC.read_labels(spark, f"{tmp_path}/labels").first().label == "3"
    due = spark.createDataFrame([("e@x", "p1", 80.0, 90.0)], "email string, product_id string, notified_price double, target_price double")
    SK.append_outbox(due, f"{tmp_path}/out", F.lit("now"))
    SK.append_outbox(due, f"{tmp_path}/out", F.lit("then"))
    assert sorted((r.queued_at, r.body) for r in spark.read.json(f"{tmp_path}/out").collect()) == [("now", "p1 is now 80 (target 90)"), ("then", "p1 is now 80 (target 90)")]
    SK.write_report(spark.createDataFrame([("full", 3, 0.5), ("none", 3, None)], "variant string, queries int, ndcg double"), f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r/markdown").collect()] == ["| variant | queries | ndcg |", "|-|-|-|", "| full | 3 | 0.5000 |", "| none | 3 | - |"]
    clicks = tmp_path / "clicks.json"
    clicks.write_text('{"id": 1, "query": "q", "shown_results": "[\\"a\\", \\"b\\"]", "clicked_id": "b"}\n')
    assert SC.read_clicks(spark, str(clicks)).first().shown_results == ["a", "b"]


def test_free_form_categories_match_by_tag_and_subcategory(spark):
    rows = spark.createDataFrame([(1, "gifts", "kurtas", "Nice", []), (2, "gifts", None, "Nice", ["Kurta"]), (3, "saree", "kurta", "Kurta", []), (4, "gifts", None, "Kurtaish", [])], "id int, category string, subcategory string, name string, tags array<string>")
    kept = rows.where(T.category_matches(F.lit("kurta"), F.col("category"), K.product_text(rows)))
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 2]


def test_photo_list_is_cut_by_cosine_after_the_filters(spark):
    near = [(1, i, 0.9 - 0.03 * i, True, float(i == 7), 0.0, i != 0) for i in range(12)]
    rows = spark.createDataFrame(near, "query_id int, doc_id int, cosine double, has_text boolean, f2 double, f3 double, ok boolean")
    got = [(r.doc_id, r.rank) for r in K.photo_ranked(rows, near=0.2, least=3, passes=F.col("ok")).orderBy("rank").collect()]
    # the best that passes has 0.87, so 0.67 and more stay; item 7 (0.69) gains 0.04 and moves before 6, but 8 (0.66) is cut whatever it gains
    assert [d for d, _ in got] == [1, 2, 3, 4, 5, 7, 6] and [r for _, r in got] == list(range(1, 8))
    assert [r.doc_id for r in K.photo_ranked(rows, near=0.0, least=3, passes=F.col("ok")).orderBy("rank").collect()] == [1, 2, 3]


def test_listwise_ranking(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = []
    for s in range(60):
        for i in range(10):
            f = [r.random() for _ in range(12)]
            rows.append((s, i, i, int(f[1] > 0.6) + int(f[1] > 0.9), *f))
    groups = spark.createDataFrame(rows, "session long, item long, position long, label int, " + ", ".join(f"f{i} double" for i in range(1, 13))).repartition(4)
    # gradients against a plain double loop
    scored = groups.where("session < 3").withColumn("score", F.col("f3"))
    got = {(x.session, x.item): (x.gradient, x.weight) for x in L.pair_gradients(scored).collect()}
    for s in range(3):
        own = sorted((x for x in rows if x[0] == s), key=lambda x: (-x[6], x[1]))
        ideal = sum((2 ** v - 1) / math.log2(k + 2) for k, v in enumerate(sorted((x[3] for x in own), reverse=True)))
        for a, x in enumerate(own):
            g = h = 0.0
            for b, y in enumerate(own):
                if x[3] != y[3]:
                    change = abs((2 ** x[3] - 2 ** y[3]) * (1 / math.log2(a + 2) - 1 / math.log2(b + 2))) / ideal
                    up = x[3] > y[3]
                    rho = 1 / (1 + math.exp((x[6] - y[6]) if up else (y[6] - x[6])))
                    g, h = g + (rho if up else -rho) * change, h + rho * (1 - rho) * change
            assert got[s, x[1]] == pytest.approx((g, h))
    model = L.train_listwise(groups, rounds=3, depth=3, rate=0.3)
    assert model.importance()[0][0] == "f2"
    orders = {x.ordering: x.ndcg for x in L.compared_orders(model.transform(groups).withColumnRenamed("score", "score_new")).collect()}
    assert orders["score_new"] > orders["shown"] and orders["score_new"] > orders["fusion"]
    report = spark.createDataFrame([("new", 0.9)], "ordering string, ndcg double")
    assert not L.save_if_better(spark, model, f"{tmp_path}/m", 0.5, 0.6, report) and L.save_if_better(spark, model, f"{tmp_path}/m", 0.7, 0.6, report)
    again = L.ListwiseModel.load(spark, f"{tmp_path}/m").transform(groups.limit(5))
    assert {(x.session, x.item): x.score for x in again.collect()}.items() <= {(x.session, x.item): x.score for x in model.transform(groups).collect()}.items()
    mixed = L.training_mix("hybrid", L.rule_grades(groups.select("f2", "f3")), groups.select("f2", "f3", "label"))
    assert {x.label_source for x in mixed.select("label_source").distinct().collect()} == {"synthetic", "feedback"}
    assert L.training_mix("feedback", L.rule_grades(groups.select("f2", "f3")), groups.select("f2", "f3", "label").limit(0)).count() == 600
    assert L.worth_training(groups) and not L.worth_training(groups, 61)


def test_parses_kept_for_an_hour(spark):
    from lodestar.functions.intent import PARSED, parse_queries, parsed_by_cache

    at = lambda text: F.to_timestamp(F.lit(text))
    asked = spark.createDataFrame([(1, "Red Saree"), (2, " red saree "), (3, "blue shirt"), (4, None), (4, None)], "query_id long, text string")
    none = parse_queries(asked.limit(0)).select(F.lit("k").alias("key"), F.struct(*PARSED).alias("intent"), at("2024-01-01 10:00:00").alias("parsed_at"))
    found, cache = parsed_by_cache(asked, none, at("2024-01-01 10:00:00"))
    rows = found.orderBy("query_id").collect()
    assert [(r.query_id, r.cached, r.intent.category) for r in rows] == [(1, False, "saree"), (2, False, "saree"), (3, False, "shirt"), (4, False, None), (4, False, None)]
    assert {r.key for r in cache.collect()} == {"red saree", "blue shirt", ""}
    # a use doesn't prolong an answer's hour, and at its end it is gone
    for when, hit in (("10:59:59", True), ("11:00:00", False)):
        later, after = parsed_by_cache(asked.where("query_id = 3"), cache, at(f"2024-01-01 {when}"))
        assert [r.cached for r in later.collect()] == [hit]
        assert {(r.key, f"{r.parsed_at:%H:%M:%S}") for r in after.collect()} == ({(k, "10:00:00") for k in ("red saree", "blue shirt", "")} if hit else {("blue shirt", when)})
    twice = cache.union(cache.withColumn("parsed_at", at("2024-01-01 10:30:00"))).where("key = 'blue shirt'")
    assert [f"{r.parsed_at:%H:%M}" for r in parsed_by_cache(asked.where("query_id = 3"), twice, at("2024-01-01 10:40:00"))[0].collect()] == ["10:30"]


def test_suggestions_against_plain_ratios(spark):
    import difflib
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcde", k=r.randint(2, 9))) for _ in range(120)]
    asked = {i: w[:-1] + r.choice("abz") for i, w in enumerate(words[:40])}
    got = {x.query_id: (x.term, x.ratio) for x in S.corrected(spark.createDataFrame(list(asked.items()), "query_id long, text string"), spark.createDataFrame([(w,) for w in set(words)], "term string")).collect()}
    for i, q in asked.items():
        best = max(((difflib.SequenceMatcher(None, t, q).ratio(), t) for t in set(words)), default=None) if len(q) >= 2 else None
        assert (i in got) == (best is not None and best[0] >= 0.72) and (i not in got or (got[i][1], got[i][0]) == best)


def test_title_pairs_against_all_pairs(spark):
    import random

    r = random.Random(6)
    titles = {i: sorted(set(r.choices("abcdefghij", k=r.randint(0, 6)))) for i in range(80)}
    got = {(x.x, x.y): x.similarity for x in M.title_pairs(spark.createDataFrame(list(titles.items()), "id long, t array<string>"), 0.5).collect()}
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in titles.items() for b, y in titles.items() if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_matches_without_a_category(spark):
    rows = [(i, None if i < 3 else "c", [1.0, 0.01 * i]) for i in range(6)]
    got = {(x.x, x.y) for x in M.similar_pairs(spark.createDataFrame(rows, "id long, category string, v array<double>"), 0.9, block=2, most=1).collect()}
    assert all((a < 3) == (b < 3) for a, b in got) and {a for a, _ in got} == set(range(6))


def test_fire_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "alert_id long, at string").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("alert_id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = ST.fire_once(stream).writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(x.alert_id for x in spark.table("fired").collect()) == [1, 2, 3]


def test_bm25_scores_are_those_of_the_search(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red dress", "blue dress dress", "red red shoe", "", "hat"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red dress"), (2, "hat hat"), (3, "none")], "query_id long, text string")
    plain = {(x.query_id, x.doc_id): x.score for x in R.bm25_scores(asked, docs).where("score <> 0").collect()}
    for block in (2000, 1):
        assert {(x.query_id, x.doc_id): x.score for x in R.bm25_search(asked, docs, 10, block).collect()} == pytest.approx(plain)
    popular = R.match_search(asked, docs.withColumn("n", F.col("doc_id") * 10), "n", 1).collect()
    assert [(x.query_id, x.doc_id, x.score) for x in popular] == [(1, 2, 20.0), (2, 4, 40.0)]


def test_hashed_embeddings(spark):
    rows = spark.createDataFrame([(1, "red dress"), (2, "Dress, red"), (3, ""), (4, None), (5, "blue hat red")], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", L.hashed_embedding(F.col("t"), 32).alias("v")).collect()}
    assert got[1] == got[2] and set(got[3]) == set(got[4]) == {0.0} and all(len(v) == 32 for v in got.values())
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and 0 < sum(x * y for x, y in zip(got[1], got[5], strict=True)) < 1


def test_synthetic_catalogue_is_the_same_at_any_parallelism(spark):
    one = L.cross_source_copies(L.synthetic_catalog(spark, 300)).orderBy("_id").collect()
    many = L.cross_source_copies(L.synthetic_catalog(spark, 300).repartition(9)).orderBy("_id").collect()
    assert one == many and 300 < len(one) < 400 and {r.source for r in one} > {"a", "b", "c"}
    price = {r["_id"]: r.price for r in one}
    copies = [r for r in one if r["_id"].startswith("dup_")]
    assert copies and all(0.84 < r.price / price[r["_id"][4:]] < 1.16 and r.source.endswith("x") for r in copies)
    assert {r["_id"]: r.price for r in L.synthetic_catalog(spark, 300, seed=1).collect()} != {k: v for k, v in price.items() if not k.startswith("dup_")}


def test_simulated_clicks(spark):
    shown = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 400).alias("session"), F.col("id").alias("product"), (F.col("id") / 400).cast("int").alias("position"), (F.col("id") % 3).cast("int").alias("rel"))
    clicked = L.simulated_clicks(shown)
    rate = {(r.position == 0, r.rel): r.r for r in clicked.where("position in (0, 9)").groupBy("position", "rel").agg(F.avg(F.col("clicked").cast("int")).alias("r")).collect()}
    assert rate[True, 2] > rate[True, 0] and rate[True, 2] > rate[False, 2]
    assert clicked.orderBy("product").collect() == L.simulated_clicks(shown.repartition(7)).orderBy("product").collect()


def test_six_variants():
    seen = []

    def rank(fused, model, diverse, filters):
        seen.append((fused, model, diverse, filters))
        return (model, diverse, filters)

    got = L.variants({"keyword": "k", "dense": "d"}, lambda lists: "+".join(lists), rank)
    assert got == {"keyword": "k", "dense": "d", "fusion": "k+d", "model": (True, False, False), "model_diverse": (True, True, False), "full": (True, True, True)} and {s[0] for s in seen} == {"k+d"}


def test_categories_against_plain_votes(spark):
    import random
    import re

    from lodestar.functions import vocabulary as V

    r = random.Random(9)
    words = ["kurta", "Kurtas", "with", "trousers", "and", "dupatta", "shirt", "T-Shirt", "dress", "denim", "jacket", "set", "co-ord", "red", "blue", "sling bag", "night", "shorts", "jumpsuit", "saree", "é"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 7))), r.choice(["", "Top", "Sarees", "SHIRT", "jeans & shirts", None]), r.choice(["", "ethnic | kurta", "Bags", None])) for i in range(150)]
    kinds = [(name, group, re.compile(p, re.I)) for name, group, p in V.taxonomy()]

    def plain(title, kind, tag):
        votes = dict.fromkeys((name for name, _, _ in kinds), 0.0)
        ends = [(m.end(), len(m[0]), -i, name) for i, (name, _, p) in enumerate(kinds) for m in p.finditer(title or "")]
        ruling = [e for e in ends if e[3] in V.DOMINANT_CATEGORIES]
        head = max(ruling or ends)[3] if ends else None
        for name, _, p in kinds:
            votes[name] += (0.5 if (kind or "").strip().lower() in V.GENERIC_TYPES else 3.0) * bool(kind and p.search(kind)) + bool(tag and p.search(tag))
        for *_, name in ends:
            votes[name] += 0.5 * (name != head)
        if head:
            votes[head] += 4.0 if ruling else 2.5
        best = max(votes, key=votes.get)
        return best if votes[best] else None

    df = spark.createDataFrame(rows, "i int, t string, k string, g string")
    got = {x.i: x.c.category for x in df.select("i", N.infer_category("t", "k", "g").alias("c")).collect()}
    assert got == {i: plain(t, k, g) for i, t, k, g in rows}
