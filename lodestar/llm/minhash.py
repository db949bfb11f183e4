"""Near-duplicate documents: universal hash minima, banding, verification, connected components.

Equal shingle sets are one class, stood for by its least doc_id. Every class has HASHES minima of multiply-shift hash
functions over its shingles; minima are banded, and classes that agree on a band share a bucket. A bucket has two
leaders, its least and its greatest class. Each class is confirmed, on the full sets of both texts, against the one
leader that it shares most buckets with, so pairs are as many as classes at most. Buckets whose members aren't one
component by then are compared across components in bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import block_pairs, runs
from lodestar.llm.components import components
from lodestar.llm.frames import Scratch, parts, pieces, strings, texts_of
from lodestar.llm.words import shingle_sets

HASHES = 144
_RNG = np.random.Generator(np.random.PCG64(7))
#: Multiply-shift with 64-bit words: the upper half of a*x + b is universal over 32-bit x.
MULTIPLY = _RNG.integers(0, 1 << 64, (HASHES, 1), dtype=np.uint64)
ADD = _RNG.integers(0, 1 << 64, (HASHES, 1), dtype=np.uint64)
#: A true similarity of `percent` falls under the estimate's least share once in millions of pairs (five deviations).
SLACK = 5.0
#: A pair of the similarity asked for shares no band at most so often.
MISS = 2e-5
BLOCK = 256


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands of HASHES minima by which a pair of the least similarity is missed less often than MISS."""
    for rows in range(6, 1, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) < MISS:
            return HASHES // rows, rows
    return HASHES, 1


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over distinct shingle hashes."""
    x = shingles >> np.uint64(32)
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(x), 1024):
        y = MULTIPLY * x[None, i : i + 1024]
        y += ADD
        np.minimum(out, y.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    own = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ own[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sign(bands: int, rows_: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def apply(batches):
        for rows, raw, at in pieces(batches):
            sets = shingle_sets(raw, at)
            n = np.array([len(own) for own in sets], np.int64)
            k1 = [int(np.sum(own, dtype=np.uint64).view(np.int64)) for own in sets]
            k2 = [int(np.sum(own * (own >> np.uint64(17) | np.uint64(1)), dtype=np.uint64).view(np.int64)) for own in sets]
            found = [banded(minima(own), bands, rows_) for own in sets if len(own)]
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], schema=schema)

    return apply


def _least(percent: int) -> float:
    """The share of equal minima from which a pair is confirmed on its texts."""
    p = percent / 100
    return p - SLACK * float(np.sqrt(p * (1 - p) / HASHES))


def _across(percent: int):
    """Links (component, component) between members of two blocks of a bucket; each pair is compared in its first common bucket."""
    least, shape = _least(percent), layout(percent)

    def apply(batches):
        for t in runs(batches, 3):
            band, i, j = (t.column(k)[0].as_py() for k in range(3))
            ids, own, c = (t.column(k).to_numpy() for k in (4, 3, 5))
            sets = shingle_sets(*strings(t.column(6)))
            signed = np.array([minima(s) for s in sets])
            bands = np.array([banded(m, *shape) for m in signed])
            sizes = np.array([len(s) for s in sets])
            first = bands == band
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            found = []
            for r in x:
                far = y[(c[y] != c[r]) & ((i != j) | (y > r))]
                common = bands[far] == bands[r]
                far = far[first[r][common.argmax(axis=1)]]
                near = far[(signed[far] == signed[r]).mean(axis=1) >= least]
                if len(near):
                    flat = np.concatenate([sets[s] for s in near])
                    at = np.minimum(np.searchsorted(sets[r], flat), sizes[r] - 1)
                    both = np.add.reduceat((sets[r][at] == flat).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
                    found += [(min(c[r], c[s]), max(c[r], c[s])) for s in near[100 * both >= percent * (sizes[r] + sizes[near] - both)]]
            if found:
                a, b = zip(*set(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return apply


def _confirm(percent: int):
    def apply(batches):
        for rows, raw, at in pieces(batches, "text_a", 1_000_000):
            raw_b, at_b = strings(rows.column(3))
            keep = [100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - both) and both > 0 for x, y in zip(shingle_sets(raw, at), shingle_sets(raw_b, at_b), strict=True)]
            yield rows.select([0, 1]).filter(pa.array(keep))

    return apply


def _best_leaders(shared: DataFrame) -> DataFrame:
    """(a, b): each class with the leader that it shares most buckets with, of shared(band, doc_id, lead, last)."""
    offers = shared.select("doc_id", F.explode(F.array("lead", "last")).alias("other")).where("other <> doc_id")
    counted = offers.repartition(max(2, parts(shared)), "doc_id").groupBy("doc_id", "other").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), F.col("other"))).alias("best")).select(F.col("doc_id").alias("a"), F.col("best.other").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs(doc_id, text), similarity at least percent/100.

    Nulls: a null text is an empty one; texts without words have no shingles and link with nothing, so they stand alone.
    A null doc_id links with nothing, has a null component_id and is kept. Repeated rows come out as often as they come
    in; rows that share a doc_id share its component. An empty table gives an empty result; further columns are ignored.
    """
    docs = texts_of(docs)
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(docs.mapInArrow(_sign(*layout(percent)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets have equal bands
    classes = scratch.keep(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), "classes")
    entries = classes.select("doc_id", F.explode("bands").alias("band"))
    # stored, so that Spark knows their size, and can split a hot bucket where it joins them
    leaders = scratch.keep(entries.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last"), "leaders")
    shared = scratch.keep(entries.join(leaders, "band"), "shared")
    members = scratch.keep(shared.select("doc_id").distinct(), "members")
    # the texts of documents that share a bucket with another, once for rows that repeat
    texts = scratch.keep(docs.join(members, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    a, b = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = _best_leaders(shared).join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    links = scratch.keep(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    groups = scratch.keep(components(links), "groups")
    now = shared.select("band", "doc_id").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = scratch.keep(now.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("band"), "mixed")
    rest = scratch.keep(now.join(mixed, "band"), "rest")
    scratch.drop("leaders", "members", "shared", "links", "mixed")
    blocks = block_pairs(rest.join(texts, "doc_id"), "band", "doc_id", BLOCK).select("band", "i", "j", "own", "doc_id", "c", "text")
    across = scratch.keep(blocks.mapInArrow(_across(percent), "a long, b long").distinct(), "across")
    scratch.drop("rest", "texts")
    if not across.isEmpty():
        # links between components already found unite these
        joined = components(across)
        united = groups.join(joined.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
        alone = joined.join(groups, "id", "left_anti")
        groups = scratch.keep(united.unionByName(alone), "united")
        scratch.drop("groups")
    keyed = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("k1")).alias("k1"), "k2")
    named = classes.select("k1", "k2", F.col("doc_id").alias("rep")).join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    return keyed.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "rep", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
