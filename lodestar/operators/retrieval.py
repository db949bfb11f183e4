"""Batches of queries against whole corpora: BM25, vector search, fusion of ranked lists.

A ranked list is a DataFrame (query_id, doc_id, score, rank) with rank from 1; ties go to the lesser doc_id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestar.functions.text import half_up, tokens
from lodestar.operators.tables import cut, narrow, stored
from lodestar.operators.textindex import Asked, Best, counts_of, scored_blocks, split, statistics_of, text_index, word_counts

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Products of queries and vectors that a task holds at once.
STEP = 1 << 19


def ranked(scored: DataFrame, k: int, score: Column | None = None, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k best of each query_id; a window group limit keeps the shuffle to k rows of each query and task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if score is None else score.desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of corpus(doc_id, text)."""
    return corpus.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def words_of(corpus: DataFrame) -> DataFrame:
    """(doc_id, dl, term): a row for each word.

    A text is split once: its words are bound to a name inside the generator, and explode_outer keeps the optimizer from
    adding a filter that would split it again.
    """
    bound = F.transform(F.array(tokens(F.col("text"))), lambda ws: F.transform(ws, lambda w: F.struct(w.alias("term"), F.size(ws).cast("long").alias("dl"))))
    return corpus.select("doc_id", F.explode_outer(bound[0]).alias("w")).where("w is not null").select("doc_id", "w.dl", "w.term")


def lengths(corpus: DataFrame) -> DataFrame:
    """(doc_id, dl): words of each document."""
    return corpus.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def statistics(corpus: DataFrame) -> DataFrame:
    """(term, df, words): documents of each term; the row of term null has the number of documents and of their words. One pass.

    Texts are split and counted by blocks of documents, so that a row is a word of a block and not of a document.
    """
    rows = corpus.select("doc_id", F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(word_counts, "docs int, words long, terms array<string>, dfs array<int>")
    total = F.struct(F.lit(None).cast("string").alias("terms"), F.col("docs").alias("dfs"), "words")
    each = F.transform(F.arrays_zip("terms", "dfs"), lambda t: F.struct(t["terms"].alias("terms"), t["dfs"].alias("dfs"), F.lit(0).cast("long").alias("words")))
    return counted.select(F.explode(F.concat(F.array(total), each)).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"), F.sum("t.words").alias("words"))


def idf_of(counts: DataFrame) -> DataFrame:
    """(term, df, idf) of statistics(): Okapi's inverse document frequency; a negative one is EPSILON times the mean over the vocabulary."""
    n = counts.where("term is null").select(F.col("df").alias("n"))
    raw = counts.where("term is not null").crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def idf_table(corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of a corpus; see idf_of. Its counts, a row a word, are stored, as they are read three times."""
    return idf_of(stored(statistics(corpus), "counts"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries(query_id, text): a repeated word counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that share a word. Only words of the queries leave the scan of the corpus."""
    asked = query_terms(queries)
    words = asked.select("term").distinct()
    averages = lengths(corpus).agg(F.avg("dl").alias("avgdl"))
    found = words_of(corpus)
    tf = found.join(words, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    weights = tf.join(idf_table(corpus).join(words, "term", "left_semi"), "term").crossJoin(F.broadcast(averages))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = weights.select("term", "doc_id", (F.col("idf") * (F.col("tf") * (K1 + 1) / norm)).alias("w"))
    return asked.join(part, "term").groupBy("query_id", "doc_id").agg(half_up(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))


def _part(by: str, mean: float):
    """What a word adds to a document's score, by its count and the document's length, but for its weight."""
    if by == "bm25":
        return lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    return lambda tf, dl: tf / np.maximum(dl, 1)


def search_index(queries: DataFrame, index: DataFrame, k: int = 100, by: str = "bm25", block: int = 2000) -> DataFrame:
    """The k best documents of each of queries(query_id, text) in an index of textindex.text_index.

    by: bm25, tf (matched words over the document's) or worth (the number given with each document, of those that share a
    word). The queries, dealt by a hash to blocks of about `block`, are a stated set that goes over the index block by block.
    Of more than a block, each distinct text is searched once, and its list given to every query that has it.
    """
    texts = queries.select("query_id", F.col("text").cast("string").alias("text"))
    if len(texts.limit(block + 1).collect()) <= block:
        return _search_blocks(texts, index, k, by, block)
    kinds = stored(texts.where("text is not null").groupBy("text").agg(F.min("query_id").alias("kind")), "texts")
    found = _search_blocks(kinds.select(F.col("kind").alias("query_id"), "text"), index, k, by, block)
    lists = found.withColumnRenamed("query_id", "kind").join(kinds, "kind").drop("kind")
    return texts.join(lists, "text").select("query_id", "doc_id", "score", "rank")


def _search_blocks(asked: DataFrame, index: DataFrame, k: int, by: str, block: int) -> DataFrame:
    spark = index.sparkSession
    id_type = index.schema["doc_ids"].dataType.elementType
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {id_type.simpleString()}, score double"
    kinds = pa.schema([("query_id", to_arrow_type(asked.schema["query_id"].dataType)), ("doc_id", to_arrow_type(id_type))])
    found = []
    few = asked.limit(block + 1).collect()
    blocks = 1 if len(few) <= block else math.ceil(asked.count() / block)
    for b in range(blocks):
        rows = few if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        terms, first = split(pa.array([r["text"] for r in rows], pa.string()))
        terms, held = terms.to_pylist(), {}
        for q in range(len(rows)):
            for w in terms[first[q] : first[q + 1]]:
                own = held.setdefault(w, {})
                own[q] = own.get(q, 0.0) + 1.0
        words, worth, mean = sorted(held), dict.fromkeys(held, 1.0), 0.0
        if by == "bm25":
            worth, mean = _idf_of_words(index, words)
            words = [w for w in words if w in worth]
        if words:
            weights = [(np.array(list(held[w]), np.int64), np.array(list(held[w].values())) * worth[w]) for w in words]
            search = scored_blocks(Asked(words, weights, len(rows)), [r["query_id"] for r in rows], k, kinds, _part(by, mean), by == "worth")
            # k rows a query are stored, so the index is gone over in narrow batches; of several blocks one is on its way at a time
            with narrow(spark):
                found.append(stored(ranked(index.mapInArrow(search, kind), k), "lists"))
    if len(found) == 1:
        return found[0]
    found = [one.drop("rank") for one in found]
    return ranked(reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind), k)


def _idf_of_words(index: DataFrame, words: list[str]) -> tuple[dict[str, float], float]:
    """Okapi's idf, as in idf_of, of those of a block's words that the corpus has, and the mean length of its documents.

    The blocks' own counts of these words are summed up by task. The whole vocabulary is gone over only if a word is in
    more than half of the documents: then its idf is taken from the vocabulary's mean.
    """
    with narrow(index.sparkSession):
        rows = counts_of(index, words).collect()  # a row a word of the block
    docs = sum(r["df"] for r in rows if r["term"] is None)
    raw = {r["term"]: math.log(docs - r["df"] + 0.5) - math.log(r["df"] + 0.5) for r in rows if r["term"] is not None}
    floor = 0.0
    if any(x < 0 for x in raw.values()):
        floor = EPSILON * statistics_of(index).agg(F.avg(F.log(F.lit(docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean")).first()["mean"]
    return {w: x if x >= 0 else floor for w, x in raw.items()}, sum(r["words"] for r in rows) / max(docs, 1)


def bm25_search(queries: DataFrame, corpus: DataFrame, k: int = 100, block: int = 2000) -> DataFrame:
    """The k best documents of each query by BM25: the corpus is split and indexed once, see textindex; searches go over the index."""
    return search_index(queries, text_index(corpus), k, "bm25", block)


def tf_search(queries: DataFrame, corpus: DataFrame, k: int = 100, block: int = 2000) -> DataFrame:
    """The k best documents of each query by tf_scores, found as bm25_search does."""
    return search_index(queries, text_index(corpus), k, "tf", block)


def match_search(queries: DataFrame, corpus: DataFrame, by: str, k: int = 100, block: int = 2000) -> DataFrame:
    """The k documents of greatest `by` (null: 0) among those that share a word with each query, found as bm25_search does."""
    return search_index(queries, text_index(corpus, by), k, "worth", block)


def pad_with_zeros(top: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Lists of k for every query: where too few documents score, those of least id follow with score 0.

    Only the k least ids can be needed besides those found, so the documents joined to each query are 2 k at most.
    """
    spare = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
    zeros = queries.select("query_id").distinct().crossJoin(F.broadcast(spare)).join(top, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(top.select("query_id", "doc_id", "score").unionByName(zeros), k)


def tf_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): matched words over the document's words, a plain second retriever."""
    asked = query_terms(queries)
    found = words_of(corpus)
    tf = found.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    both = asked.join(tf, "term").groupBy("query_id", "doc_id", "dl").agg(F.sum(F.col("qtf") * F.col("tf")).alias("hits"))
    return both.select("query_id", "doc_id", half_up(F.col("hits") / F.col("dl"), 6).alias("score"))


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, top: int = 100) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (k + rank) over the lists that have a document; lists beyond the weights are dropped."""
    weights = [1.0] * len(lists) if weights is None else weights
    each = [one.select("query_id", "doc_id", F.lit(i).alias("list"), (F.lit(w) / (k + F.col("rank"))).alias("part")) for i, (one, w) in enumerate(zip(lists, weights, strict=False))]
    parts = reduce(DataFrame.unionByName, each).groupBy("query_id", "doc_id").agg(*[F.sum(F.when(F.col("list") == i, F.col("part")).otherwise(0.0)).alias(f"p{i}") for i in range(len(each))])
    total = reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in range(len(each))])
    return ranked(parts.select("query_id", "doc_id", half_up(total, 9).alias("score")), top)


def cosine_search(queries: DataFrame, vectors: DataFrame, k: int = 100, block: int = 2000) -> DataFrame:
    """The k nearest of vectors(doc_id, v) for each of queries(query_id, v), exactly, by cosine.

    Queries go over the vectors in stated blocks of at most `block`: a block is a matrix in each task, which keeps its own
    k best of every query; only those are shuffled. A vector that is null, zero or of another size scores nothing.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    kind = "query_id long, doc_id long, score double"
    found = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).where("v is not null").select("query_id", F.col("v").cast("array<double>").alias("v")).collect()
        rows = [r for r in rows if r["v"] and None not in r["v"] and np.any(r["v"])]
        sizes: dict[int, list] = {}
        for r in rows:
            sizes.setdefault(len(r["v"]), []).append(r)
        for size, own in sizes.items():
            matrix = np.array([r["v"] for r in own], float)
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            top = vectors.select("doc_id", F.col("v").cast("array<double>").alias("v")).where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull())).mapInArrow(_nearest([r["query_id"] for r in own], matrix, k), kind)
            found.append(top if blocks == 1 else cut(ranked(top, k).drop("rank")))
    return ranked(reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], kind), k)


def _nearest(ids: list, matrix: np.ndarray, k: int):
    kinds = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64())])

    def apply(batches):
        best, step = Best(len(ids), k), max(1, STEP // len(ids))
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            norm = np.linalg.norm(v, axis=1)
            docs, v = b.column(0).to_numpy()[norm > 0], v[norm > 0] / norm[norm > 0, None]
            # a few vectors at a time, so that the products are no more than STEP whatever the block and the batch
            for i in range(0, len(docs), step):
                score = matrix @ v[i : i + step].T
                # what is left out stays under the least when rounded too
                query, at = np.nonzero(score >= best.least[:, None] - 1e-6)
                best.add(query, docs[i + at], np.floor(score[query, at] * 1e6 + 0.5) / 1e6)
        yield from best.rows(ids, kinds)

    return apply


def without_deleted(top: DataFrame, deleted: DataFrame) -> DataFrame:
    """Soft deletion after the cut to k, so a list may come out shorter; ranks are closed up."""
    left = top.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def upsert_vectors(vectors: DataFrame, changes: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, deleted) after changes(doc_id, v) replace vectors by id; an id that comes back is no longer deleted."""
    kept = vectors.join(changes.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(changes.select("doc_id", "v")), deleted.join(changes.select("doc_id"), "doc_id", "left_anti")
