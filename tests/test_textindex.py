"""The keyword index: words as the native split makes them, and searches that leave out only what can't be among the best."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import tokens
from lodestar.operators import retrieval, textindex

ODD = ["T-Shirt, size\tM  and L", "", None, "   ", "K 300K İstanbul éa b", "one", " two  two ", "日本 x", "A" * 300, "\n", "0 1 02"]


def test_words_are_those_of_the_native_split(spark):
    want = [r.w or [] for r in spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()]
    words, first = textindex.split(pa.array(ODD, pa.string()))
    own = words.to_pylist()
    assert [own[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
    part, first = textindex.split(pa.array(ODD, pa.string()).slice(4, 4))
    assert part.to_pylist() == sum(want[4:8], [])


def documents(n=1500, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(r.choices(vocabulary, weights, k=r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("by", ["bm25", "tf", "worth"])
def test_pruned_search_is_exact(monkeypatch, by):
    monkeypatch.setattr(textindex, "BLOCK", 64)
    monkeypatch.setattr(textindex, "STEP", 50)
    docs = documents()
    r = random.Random(4)
    asked = [list(dict.fromkeys(f"w{min(399, int(r.paretovariate(0.5)))}" for _ in range(12))) for _ in range(30)]
    worth = [float(r.randrange(50)) for _ in docs]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs), pa.array(worth)], names=["doc_id", "text", "worth"])
    index = list(textindex._blocks([rows]))
    assert len(index) == -(-len(docs) // 64) and sum(b.column("n_docs")[0].as_py() for b in index) == len(docs)
    split = [d.split() for d in docs]
    mean = sum(map(len, split)) / len(docs)
    df = {w: sum(w in set(d) for d in split) for own in asked for w in own}
    idf = {w: np.log(len(docs) - n + 0.5) - np.log(n + 0.5) if by == "bm25" else 1.0 for w, n in df.items() if n}
    words = sorted(idf)
    weights = [(np.array([q for q, own in enumerate(asked) if w in own]), np.array([idf[w] for own in asked if w in own])) for w in words]
    part = retrieval._part(by, mean)
    best = textindex.Best(len(asked), 5)
    known, query = pa.array(words), textindex.Asked(words, weights, len(asked))
    pairs = [textindex._add_block(query, known, b, best, part, by == "worth") for b in index]
    best.shorten()
    q, d, s = best.held[0]
    got = {i: [(float(x), int(y)) for x, y in zip(s[q == i], d[q == i], strict=True)] for i in range(len(asked))}
    for i, own in enumerate(asked):
        scored = []
        for k, w in enumerate(split):
            total = sum(idf[x] * float(part(np.array([w.count(x)]), np.array([len(w)]))[0]) for x in own if x in idf and x in w)
            if any(x in w for x in own if x in idf):
                scored.append((worth[k] if by == "worth" else float(np.floor(total * 1e6 + 0.5) / 1e6), k))
        want = sorted((x for x in scored if x[0] != 0 or by == "worth"), key=lambda x: (-x[0], x[1]))[:5]
        assert [k for _, k in got[i]] == [k for _, k in want] and [x for x, _ in got[i]] == pytest.approx([x for x, _ in want], abs=2e-6)
    assert by == "worth" or sum(b for _, b in pairs) < 0.8 * sum(a for a, _ in pairs)


def test_a_saved_index_gives_the_same(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(documents(200))), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w3 w9 w200"), (2, "w0 w0"), (3, ""), (4, "nowhere")], "query_id long, text string")
    index = textindex.text_index(docs)
    textindex.save_index(index, f"{tmp_path}/index")
    got = retrieval.search_index(asked, textindex.load_index(spark, f"{tmp_path}/index"), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.bm25_search(asked, docs, 10, block=1).collect())) and {r.query_id for r in got} == {1, 2}
    plain = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(asked, docs).collect()}
    assert all(plain[r.query_id, r.doc_id] == pytest.approx(r.score, abs=2e-6) for r in got)
    assert retrieval.bm25_search(asked, docs.limit(0), 10).count() == 0
    assert {(r.term, r.df) for r in textindex.statistics_of(index).collect()} == {(r.term, r.df) for r in retrieval.statistics(docs).where("term is not null").collect()}
