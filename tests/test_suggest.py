"""Corrections by keys of rare letters against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import suggest


def vocabulary(n=10_000, seed=5):
    r = random.Random(seed)
    parts = ["sa", "ree", "kur", "ta", "shi", "rt", "den", "im", "jack", "et", "z", "é", "qu", "ilt", "o", "aaa", "x"]
    return sorted({"".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(3 * n)})[:n]


def plain(q, terms, least):
    best = None
    for t in terms:
        m = difflib.SequenceMatcher(None, t, q)
        if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (x := m.ratio()) >= least and (best is None or (x, t) > best):
            best = (x, t)
    return best


@pytest.mark.parametrize("most", [20_000, 7])
def test_the_same_corrections_as_all_pairs(spark, most):
    """Ten thousand terms; with long lists and with short ones."""
    terms = vocabulary()
    r = random.Random(6)
    asked = [r.choice(terms) for _ in range(30)]
    asked = [q[:k] + r.choice("aezx") + q[k + r.randint(0, 1) :] for q in asked for k in [r.randrange(len(q))]] + ["zz", "aaaaaaaa", "a", "", "nothing like it", "ta", "saree saree"]
    texts = spark.createDataFrame([(q,) for q in sorted({a.strip().lower() for a in asked if len(a.strip()) > 1})], "q string")
    pairs = suggest.gram_candidates(texts, spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    met = {(x.q, x.term) for x in pairs.collect()}
    want = {q: plain(q, terms, 0.72) for q in {x.q for x in texts.collect()}}
    assert all((q, w[1]) in met for q, w in want.items() if w) and len(met) < 0.25 * len(want) * len(terms)
    if most > 7:
        queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, text string")
        got = {x.query_id: (x.ratio, x.term) for x in suggest.corrected(queries, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
        assert got == {i: want[q.strip().lower()] for i, q in enumerate(asked) if len(q.strip()) > 1 and want[q.strip().lower()]}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.72, 0.95])
def test_no_pair_that_reaches_the_ratio_is_missed(least):
    r = random.Random(9)
    words = ["".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(150)]
    rank = {c: i for i, c in enumerate("dcba")}
    sizes = sorted({len(w) for w in words})
    asked, terms = ({w: set(suggest.gram_keys(w, sizes, rank, least, side)) for w in words} for side in (True, False))
    for q in words:
        for t in words:
            if difflib.SequenceMatcher(None, t, q).ratio() >= least:
                assert asked[q] & terms[t], (q, t)


def test_no_terms_and_no_queries(spark):
    terms, none = spark.createDataFrame([("kurta",)], "term string"), spark.createDataFrame([], "query_id long, text string")
    assert suggest.corrected(none, terms).count() == 0
    one = spark.createDataFrame([(1, "kurti"), (2, None)], none.schema)
    assert suggest.corrected(one, terms.limit(0)).count() == 0 and [tuple(r) for r in suggest.corrected(one, terms).select("query_id", "term", F.round("ratio", 2)).collect()] == [(1, "kurta", 0.8)]
