"""What the reviewer of round 3 found, on tables small enough to be told by eye."""

import datetime
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa

from lodestar.llm.bpe import Vocabulary
from lodestar.operators import cells, matching, normalize, retrieval, textindex
from lodestar.operators.tables import BATCH_BYTES, narrow
from lodestar.operators.textindex import text_index
from lodestar.plans import registry


def test_crawl_counters_of_a_site_without_a_product_in_both_crawls(spark, tmp_path):
    old, new = datetime.datetime(1997, 5, 1), datetime.datetime(1999, 5, 1)
    lines = [(1, 7, 1.0, 10.0, old), (1, 7, 1.0, 12.0, new), (2, 7, 1.0, 3.0, old), (3, 8, 1.0, 5.0, old), (4, 8, 1.0, 6.0, new), (5, 9, 1.0, 2.0, new), (6, 7, 2.0, 8.0, old), (6, 7, 1.0, 4.0, new)]
    rows = spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["a13_crawl_counters"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.SQL["a13_crawl_counters"]).fetchall()
    assert {tuple(r) for r in got} == set(want) == {("s7", 1, 0, 1, 1), ("s8", None, 1, None, 1), ("s9", None, 1, None, 0)}


def test_a_vector_search_holds_few_products_at_once():
    v = np.random.default_rng(1).normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(v), pa.list_(pa.float64()))], names=["doc_id", "v"])
    asked = v[:1000] / np.linalg.norm(v[:1000], axis=1, keepdims=True)
    tracemalloc.start()
    rows = next(iter(retrieval._nearest(list(range(1000)), asked, 5)([batch]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # the products of all pairs alone are 80 MB, and were held several times
    score = np.floor(asked @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T * 1e6 + 0.5) / 1e6
    for q in (0, 500, 999):
        best = np.lexsort((np.arange(10_000), -score[q]))[:5]
        assert rows[rows.query_id == q].doc_id.tolist() == best.tolist()


def test_a_text_that_many_ask_is_searched_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red bolt"), (2, "blue bolt bolt"), (3, "red ring"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, ["red bolt", "ring", None][i % 3]) for i in range(30)], "query_id long, text string")
    index, searched, plain = text_index(docs), [], retrieval.scored_blocks

    def counted(asked_, ids, *rest):
        searched.append(len(ids))
        return plain(asked_, ids, *rest)

    monkeypatch.setattr(retrieval, "scored_blocks", counted)
    got = {tuple(r) for r in retrieval.search_index(asked, index, 2, "tf", block=5).collect()}
    assert sum(searched) == 2
    assert got == {tuple(r) for r in retrieval.search_index(asked, index, 2, "tf", block=100).collect()} and len(got) == 30


def test_work_a_row_lies_in_four_parts_a_core(spark):
    assert registry.QUERIES["qp_parse_queries"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 16


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_and_categories_are_asked_once_for_each_that_differs(spark):
    assert plan(registry.QUERIES["f05_size_filter"](spark, "/root/testdata/sf0.001")).count("Aggregate") == 3
    assert "Aggregate" in plan(registry.QUERIES["n06_categories"](spark, "/root/testdata/sf0.001"))
    rows = spark.createDataFrame([(1, "Red Kurta", None, "x"), (2, "Red Kurta", None, "x"), (3, None, None, None)], "id long, title string, kind string, tags string")
    got = {r.id: r.c for r in normalize.with_categories(rows, "title", "kind", "tags", "c").collect()}
    want = {r.id: r.c for r in rows.select("id", normalize.infer_category("title", "kind", "tags").alias("c")).collect()}
    assert got == want and got[1].category is not None and got[3].category is None


def test_words_are_counted_by_blocks(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "B c!"), (3, None), (4, "")], "doc_id long, text string")
    counts = retrieval.statistics(docs)
    assert "MapInArrow" in plan(counts)
    assert {tuple(r) for r in counts.collect()} == {(None, 4, 5), ("a", 1, 0), ("b", 2, 0), ("c", 1, 0)}


def test_cheapest_prices_need_no_ranks(spark):
    rows = spark.createDataFrame([("a", 1, 3.0), ("b", 1, None), ("c", 2, 5.0), ("d", 3, None), ("e", 3, None)], "id string, source_product_id long, price double")
    assert {tuple(r) for r in matching.cheapest_of_groups(rows).collect()} == {(1, 3.0, 2), (3, float("inf"), 2)}
    assert "Window" not in plan(registry.QUERIES["d06_price_comp"](spark, "/root/testdata/sf0.001"))


def held_by(f):
    """(what f gives, the most bytes that numpy held meanwhile)."""
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_keyword_search_holds_few_postings_at_once():
    """many queries of frequent words against one block, with and without weak words."""
    words = [f"w{i}" for i in range(20)]
    docs = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array([" ".join(w for i, w in enumerate(words) if (d + i) % 3) for d in range(1000)]), pa.array(np.zeros(1000))], names=["doc_id", "text", "worth"])
    block, part = next(iter(textindex._blocks([docs]))), retrieval._part("bm25", 13.0)
    found = {}
    for n in (20, 1500):
        asked = textindex.Asked(words, [(np.arange(n), 1.0 + (np.arange(n) % 20 == i)) for i in range(20)], n)
        best = textindex.Best(n, 5)

        def twice(asked=asked, best=best):
            for _ in range(2):  # the second time from the least scores of the first
                textindex._add_block(asked, pa.array(words), block, best, part, False)
                best.shorten()
            return best.held[0]

        (query, doc, score), peak = held_by(twice)
        assert peak < 80e6  # 20 million postings were added up at once
        found[n] = [(int(q), int(d), float(s)) for q, d, s in zip(query, doc, score, strict=True) if q < 20]
    assert found[20] == found[1500] and len(found[20]) == 100


def test_jobs_in_narrow_batches_leave_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with narrow(spark):
        assert spark.conf.get(key) == str(BATCH_BYTES)
        rows = spark.range(100_000).selectExpr("id", "repeat('x', 1000) t").coalesce(1).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"]) for x in b), "n long").collect()
    assert spark.conf.get(key) == before and max(r.n for r in rows) < 2 * BATCH_BYTES


def test_pairs_of_blocks_are_looked_through_a_few_rows_at_a_time():
    """two blocks whose vectors are all alike."""
    v = np.random.default_rng(3).normal(size=(1024, 8)).astype("<f4")
    v = np.abs(v) / np.linalg.norm(v, axis=1, keepdims=True)
    ids = [pa.array([list(range(a, a + 1024))], pa.list_(pa.int64())) for a in (0, 2000)]
    blob = pa.array([v.tobytes()], pa.binary())
    row = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([8]), ids[0], blob, ids[1], blob], names=["i", "j", "size", "x", "mx", "y", "my"])
    rows, peak = held_by(lambda: pa.Table.from_batches(list(matching._compared("<f4", 0.3, 3)([row]))).to_pylist())
    assert peak < 25e6  # a product alone is 8 MB and was held several times
    value = np.floor(v.astype(float) @ v.astype(float).T * 1e6 + 0.5) / 1e6
    want = set()
    for a, b, x in ((0, 2000, value), (2000, 0, value.T)):
        for k in range(1024):
            want |= {(a + k, b + int(c), x[k, c]) for c in np.lexsort((np.arange(1024), -x[k]))[:3] if x[k, c] >= 0.3}
    assert {(r["x"], r["y"], r["similarity"]) for r in rows} == want


def test_a_search_of_cells_holds_few_products_at_once():
    """2 000 queries against a block of 1 024."""
    v = np.random.default_rng(4).normal(size=(2000, 8))

    class Row:
        def __init__(self, i):
            self.row = {"query_id": i, "v": list(v[i])}

        def __getitem__(self, name):
            return self.row[name]

    asked = cells.Asked([Row(i) for i in range(2000)], np.zeros((0, 1)))
    block = pa.RecordBatch.from_arrays(
        [pa.array([8], pa.int32()), pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([0.0]), pa.array([list(range(1024))], pa.list_(pa.int64())), pa.array([v[:1024].tobytes()], pa.binary())],
        names=["size", "cell", "low", "high", "ids", "m"],
    )
    rows, peak = held_by(lambda: pa.Table.from_batches(list(cells._searched(asked, 5, "<f8", None)([block]))))
    assert peak < 60e6  # the 2 million products alone are 16 MB, and were held several times with their places
    u = cells.unit(v)
    score = np.floor(u @ u[:1024].T * 1e6 + 0.5) / 1e6
    got = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    for q in (0, 700, 1999):
        assert [d for i, d in got if i == q] == np.lexsort((np.arange(1024), -score[q]))[:5].tolist()


def test_pieces_that_end_together_leave_a_matrix_at_once():
    """op9_bpe: the ids of all rows of a matrix come as one array, not as one a row."""
    own = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = [b"qzxjv", b"x", b" widgetry", b"zzzzzzzzzzz", "\u00e9\u00df\u4e2d".encode()]
    matrix = np.full((len(pieces), 16), -1, np.int32)
    for r, piece in enumerate(pieces):
        matrix[r, : len(piece)] = own.single[np.frombuffer(piece, np.uint8)]
    row, n, ids = own.merge(matrix)
    assert sorted(row.tolist()) == list(range(len(pieces))) and n.sum() == len(ids)
    ends = np.cumsum(n)
    for r, a, b in zip(row, ends - n, ends, strict=True):
        assert own.decode(ids[a:b]) == pieces[r]
        assert ids[a:b].tolist() == own.long(pieces[r]).tolist()
