"""Vectors in cells: exact searches and joins that compare only what can be near."""

import numpy as np
import pytest

from lodestar.operators import cells, matching
from lodestar.operators.tables import stored

SCHEMA = "doc_id long, v array<float>"


def gathered(n=6000, groups=12, seed=1, spread=0.05):
    """Vectors around a few directions, with copies and some that can't be compared."""
    r = np.random.default_rng(seed)
    centers = r.standard_normal((groups, 16))
    v = centers[r.integers(0, groups, n)] + spread * r.standard_normal((n, 16))
    v[10:60] = v[9]
    return v.astype(np.float32)


@pytest.fixture(scope="module")
def given(spark):
    v = gathered()
    odd = [(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [float("nan")] * 16), (-5, [1.0, 2.0]), (-6, [None] * 16)]
    return v, stored(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + odd, SCHEMA).repartition(4))


def nearest(v, q, k):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    w = q.astype(float) / np.linalg.norm(q.astype(float))
    score = np.floor(u @ w * 1e6 + 0.5) / 1e6
    order = np.lexsort((np.arange(len(v)), -score))[:k]
    return [(int(i), score[i]) for i in order]


def found(top, query):
    return [(r.doc_id, r.score) for r in sorted((r for r in top if r.query_id == query), key=lambda r: r.rank)]


def test_search_is_exact_and_leaves_out_most(spark, given):
    v, table = given
    index = cells.vector_index(table, cells=24)
    asked = table.where("doc_id % 500 = 0 or doc_id < 0").withColumnRenamed("doc_id", "query_id")
    top, read = cells.cell_search(asked, index, 8)
    top = top.collect()
    for q in range(0, 6000, 500):
        got, want = found(top, q), nearest(v, v[q], 8)
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
        assert {i for i, s in got if s > want[-1][1] + 3e-6} == {i for i, s in want if s > want[-1][1] + 3e-6}
    assert {r.query_id for r in top} == {*range(0, 6000, 500), -5}
    share = [(r.compared / r.vectors) for r in read.where("query_id >= 0").collect()]
    assert max(share) <= 1 and sum(share) / len(share) < 0.3
    own = index.blocks.collect()
    assert sum(r.n for r in own) == 6001 and max(r.n for r in own) <= cells.BLOCK and all(len(r.ids) == r.n and len(r.m) == r.n * r.size * 4 for r in own)


def test_few_vectors_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(7, [1.0, 0.0])], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, v array<float>")
    assert cells.cell_search(asked, cells.vector_index(none), 3)[0].count() == 0
    assert [(r.query_id, r.doc_id) for r in cells.cell_search(asked, cells.vector_index(one), 3)[0].collect()] == [(1, 7)]


def test_upsert_rewrites_its_cells_only(spark, given, tmp_path):
    v, table = given
    path = f"{tmp_path}/cells"
    cells.vector_index(table, cells=24).save(path)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "cells" / "blocks").rglob("*.parquet")}
    new = v[5000].copy()
    changes = [(3, [float(x) for x in new]), (9001, [float(x) for x in new]), (5000, None)]
    touched = cells.upsert_cells(spark, path, spark.createDataFrame(changes, SCHEMA))
    kept = [f for f, t in files.items() if (p := tmp_path / f).exists() and p.stat().st_mtime_ns == t]
    assert 1 <= len(touched) <= 3 and all(int(f.split("cell=")[1].split("/")[0]) not in touched for f in kept) and len(kept) >= len(files) // 2
    index = cells.Cells.load(spark, path)
    ids = [i for r in index.blocks.select("ids").collect() for i in r.ids]
    assert len(ids) == len(set(ids)) == 6001 and 9001 in ids and 5000 not in ids
    top = cells.cell_search(spark.createDataFrame([(1, [float(x) for x in new])], "query_id long, v array<float>"), index, 2)[0].collect()
    assert sorted(r.doc_id for r in top) == [3, 9001]


def test_join_sends_only_blocks_that_can_match(spark):
    v = gathered(4000, 20, seed=3, spread=0.02)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "a" if i % 3 else "b", [float(x) for x in u]) for i, u in enumerate(unit)], "id long, category string, v array<double>").repartition(4)
    got = {(r.x, r.y): r.similarity for r in matching.similar_pairs(rows, 0.995, block=100).collect()}
    kind = np.array([0 if i % 50 == 0 else 1 if i % 3 else 2 for i in range(4000)])
    score = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6
    sure, maybe = set(), set()
    for i in range(4000):
        near = np.flatnonzero((score[i] >= 0.995 - 2e-6) & (kind == kind[i]))
        for j in near.tolist():
            if i != j:
                maybe.add((i, j))
                if score[i, j] > 0.995 + 2e-6:
                    sure.add((i, j))
    assert sure <= set(got) <= maybe and len(sure) > 1000


def test_block_pairs_follow_matches(spark):
    v = gathered(4000, 20, seed=3, spread=0.02)
    rows = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], SCHEMA)
    index = cells.vector_index(rows, cells=40)
    blocks = index.blocks.count()
    pairs = cells.block_pairs(index.blocks, index.pivots, 0.995).collect()
    assert blocks <= len(pairs) < 0.25 * blocks * (blocks + 1) / 2 and all(r.i <= r.j for r in pairs)
    where = {i: r.block for r in index.blocks.collect() for i in r.ids}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    kept = {(r.i, r.j) for r in pairs}
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.995, 1))
    assert all(tuple(sorted((where[x], where[y]))) in kept for x, y in zip(a.tolist()[::97], b.tolist()[::97], strict=True))
