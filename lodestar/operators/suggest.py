"""Query suggestions from the words of a catalogue."""

from __future__ import annotations

import difflib
import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.tables import stored

#: Letters of a key.
SHARED = 2


def catalogue_terms(products: DataFrame) -> DataFrame:
    """(term): distinct categories, tags, colours and words of names, lower case; products(name, category, colors, tags)."""
    every = F.concat(F.array(F.lower(F.coalesce("category", F.lit("")))), F.transform("tags", F.lower), F.transform("colors", F.lower), F.split(F.lower("name"), r"\s+"))
    return products.select(F.explode(F.filter(every, lambda w: w.isNotNull() & (w != ""))).alias("term")).distinct()


def by_prefix(queries: DataFrame, terms: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, term, place): the first `limit` terms in order that begin with the query; queries under two letters have none.

    Terms meet queries on the first two letters, so the join is an equality.
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where(F.length("q") >= 2).withColumn("head", F.substring("q", 1, 2))
    hits = q.join(terms.withColumn("head", F.substring("term", 1, 2)), "head").where(F.startswith("term", "q"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("term"))).where(F.col("place") <= limit).select("query_id", "term", "place")


def common_least(n: int, m: int, least: float) -> int:
    """Letters that texts of n and m letters have in common at least, each as often as in both, if their ratio is `least`: the ratio is twice the matched letters over all."""
    return max(1, math.ceil(least * (n + m) / 2 - 1e-9))


def gram_keys(text: str, others: list[int], rank: dict[str, int], least: float, asked: bool) -> list[str]:
    """The keys on which a text can meet texts of the lengths `others`: two of its rarest letters, numbered by occurrence, and both lengths.

    Two sets of numbered letters with t in common share SHARED of the first |x| - t + SHARED letters of each, in order from the rarest.
    """
    counts: dict[str, int] = {}
    marked = []
    for c in text:
        counts[c] = counts.get(c, 0) + 1
        marked.append((rank.get(c, -1), c, counts[c]))
    marked.sort()
    n, out = len(text), []
    for m in others:
        t = common_least(n, m, least)
        if t > min(n, m):
            continue
        shared = min(SHARED, t)
        lengths = f"{n}/{m}/" if asked else f"{m}/{n}/"
        out += [lengths + "".join(f"{c}{k}" for _, c, k in own) for own in itertools.combinations(marked[: n - t + shared], shared)]
    return out


def _keyed(rank: dict[str, int], others: list[int], least: float, asked: bool):
    def apply(batches):
        for b in batches:
            texts, keys = [], []
            for text in b.column(0).to_pylist():
                own = gram_keys(text, others, rank, least, asked)
                texts += [text] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(keys, pa.string())], names=["text", "key"])

    return apply


def _rated(least: float):
    """(q, term) -> (q, term, ratio) of those that reach `least`; what their letters rule out isn't matched."""

    def apply(batches):
        for b in batches:
            out = []
            for q, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                match = difflib.SequenceMatcher(None, term, q)
                if match.quick_ratio() >= least and (ratio := match.ratio()) >= least:
                    out.append((q, term, ratio))
            q, term, ratio = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(term, pa.string()), pa.array(ratio, pa.float64())], names=["q", "term", "ratio"])

    return apply


def gram_candidates(texts: DataFrame, terms: DataFrame, least: float = 0.72, most: int = 20_000) -> DataFrame:
    """(q, term): the pairs of texts(q) and terms(term) that share two of their rarest letters as a ratio of `least` needs it.

    A key's list of terms is dealt to parts of about `most` terms, which the texts with the key are sent to, so a frequent key is no single
    task's. The alphabet and the texts' lengths are collected: as many numbers as there are characters, and lengths.
    """
    sizes = [r["n"] for r in texts.select(F.length("q").alias("n")).distinct().collect()]
    letters = terms.select(F.explode(F.split("term", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()
    rank = {r["c"]: i for i, r in enumerate(sorted(letters, key=lambda r: (r["n"], r["c"])))}
    low, high = least / (2 - least), (2 - least) / least
    lengths = sorted({m for n in sizes for m in range(max(1, math.ceil(n * low - 1e-9)), math.floor(n * high + 1e-9) + 1)})
    x = texts.select("q").mapInArrow(_keyed(rank, lengths, least, True), "text string, key string").withColumnRenamed("text", "q")
    y = terms.where(F.length("term").between(min(lengths, default=1), max(lengths, default=0))).select("term").distinct()
    keyed = y.mapInArrow(_keyed(rank, sorted(sizes), least, False), "text string, key string").withColumnRenamed("text", "term")
    own = keyed.join(x.select("key").distinct(), "key", "left_semi")
    lists = own.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("lists"))
    dealt = own.join(lists.where("lists > 1"), "key", "left").withColumn("list", F.pmod(F.xxhash64("term"), F.coalesce("lists", F.lit(1))).cast("int")).drop("lists")
    sent = x.join(lists, "key").select("q", "key", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    return sent.join(dealt, ["key", "list"]).select("q", "term").distinct()


def corrected(queries: DataFrame, terms: DataFrame, least: float = 0.72) -> DataFrame:
    """(query_id, term, ratio): the best term by Ratcliff-Obershelp ratio, if it is `least` or more; ties go to the greater term.

    Texts meet terms on keys of rare letters (gram_candidates); only what meets is rated. Distinct texts are compared once.
    """
    texts = stored(queries.select("query_id", F.lower(F.trim("text")).alias("q")).where(F.length("q") >= 2), "texts")
    pairs = gram_candidates(texts.select("q").distinct(), terms.select("term"), least)
    rated = pairs.mapInArrow(_rated(least), "q string, term string, ratio double")
    best = rated.groupBy("q").agg(F.max(F.struct("ratio", "term")).alias("x"))
    return texts.join(best, "q").select("query_id", "x.term", "x.ratio")


def suggestions(queries: DataFrame, terms: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, terms): the corrected term first, then prefix matches in order, without repeats, `limit` at most."""
    both = corrected(queries, terms).select("query_id", "term", F.lit(0).alias("place")).unionByName(by_prefix(queries, terms, limit))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    return both.groupBy("query_id").agg(F.slice(F.array_distinct(ordered), 1, limit).alias("terms"))
