"""A whole search on a catalogue of four products."""

from pyspark.sql import functions as F

from lodestar.operators import retrieval as R
from lodestar.plans import search as P

CATALOG = [
    ("a_1", "Banarasi Silk Saree", "saree", ["red"], [], 2999.0, 0.0, 0, 40, True, ["Free Size"], ["Free Size"], "a"),
    ("b_1", "White Linen Shirt", "shirt", ["white"], ["linen"], 1299.0, 0.0, 0, 0, True, ["S", "M", "L"], ["M"], "b"),
    ("c_1", "Blue Linen Shirt", "shirt", ["blue"], ["linen"], 999.0, 0.0, 0, 20, True, ["S", "M", "L", "XL"], ["L", "XL"], "c"),
    ("a_2", "Black T-Shirt", "tshirt", ["black"], [], 499.0, 0.0, 0, 0, True, ["M"], ["M"], "a"),
]
SCHEMA = "_id string, name string, category string, color array<string>, tags array<string>, price double, rating double, review_count int, discount_percent int, in_stock boolean, sizes array<string>, available_sizes array<string>, source string"


def search(spark, texts, **options):
    catalog = spark.createDataFrame(CATALOG, SCHEMA).withColumn("cheapest_price", F.lit(None).cast("double"))
    queries = spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")
    corpus = catalog.select(F.col("_id").alias("doc_id"), F.concat_ws(" ", "name", "category").alias("text"))

    def broken():
        return corpus.select(F.col("no_such_column"))

    lists, failed = P.run_retrievers(spark, {"keyword": lambda: R.bm25_search(queries, corpus, 100), "dense": broken, "image": lambda: R.tf_search(queries, corpus, 100)})
    assert failed == ["dense"]
    return P.text_search(queries, catalog, lists, **options)


def test_search(spark):
    rows = search(spark, ["silk saree", "linen shirt size L", "linen shirt", "saree XL"]).orderBy("query_id", "position").collect()
    found = {q: [r.doc_id for r in rows if r.query_id == q] for q in (1, 2, 3, 4)}
    assert found == {1: ["a_1"], 2: ["c_1"], 3: found[3], 4: ["a_1"]} and set(found[3]) == {"b_1", "c_1"}
    assert "matched category" in rows[0].why and rows[0].position == 0


def test_explicit_filters_and_log(spark):
    explicit = spark.createDataFrame([(1, None, None, 1000.0, None, None)], "query_id long, x_category string, x_min_price double, x_max_price double, x_min_rating double, x_size string")
    shown = search(spark, ["linen shirt under 5000"], explicit=explicit)
    assert [r.doc_id for r in shown.collect()] == ["c_1"]
    log = P.impressions(shown, "text", "none", F.lit("2024-01-01")).collect()
    assert len(log) == 1 and len(log[0].features) == 12


def test_photo_search(spark):
    catalog = spark.createDataFrame([(*row, i) for i, row in enumerate(CATALOG)], SCHEMA + ", vec_id long").withColumn("cheapest_price", F.lit(None).cast("double"))
    v = {0: [1.0, 0.0, 0.1], 1: [0.0, 1.0, 0.1], 2: [0.1, 1.0, 0.0], 3: [0.0, 0.1, 1.0]}
    vectors = spark.createDataFrame([(i, x) for i, x in v.items()], "doc_id long, v array<double>")
    photos = spark.createDataFrame([(10 + i, x, None) for i, x in v.items()] + [(20, v[1], "under 1000"), (21, v[1], "saree")], "query_id long, v array<double>, text string")
    rows = P.photo_search(photos, catalog, vectors).orderBy("query_id", "position").collect()
    for i, row in enumerate(CATALOG):
        own = [r for r in rows if r.query_id == 10 + i]
        assert own[0].doc_id == row[0] and own[0]._score_kind == "visual" and own[0]._similarity == 1.0 and own[0]._explanation == ["looks 100% similar to your photo"]
        assert [r._similarity for r in own] == sorted((r._similarity for r in own), reverse=True)
    assert [r.doc_id for r in rows if r.query_id == 20] == ["c_1", "a_2"] and [r.doc_id for r in rows if r.query_id == 21] == ["a_1"]
