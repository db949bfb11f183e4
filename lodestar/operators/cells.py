"""Vectors in cells around pivots: exact searches and joins that leave out what the triangle inequality rules out.

Angles between directions are a metric. A vector lies in the cell of its nearest pivot, and blocks of a cell hold the
vectors of a ring, sorted by their angle to the pivot. A query at angle t to the pivot is no nearer to a vector of a ring
[low, high] than max(t - high, low - t), and two rings around pivots at angle p no nearer than p - high - high'. Pivots
are fitted on a bounded sample; how well they fit decides only how much can be left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.tables import narrow, stored
from lodestar.operators.textindex import Best

#: Vectors that pivots are fitted on, pivots at most, and vectors of a block.
SAMPLE, PIVOTS, BLOCK = 16_384, 512, 1024
#: Margins for the rounding of scores to six places and of angles.
SLACK, ANGLE = 2e-6, 1e-6
#: Products that a task holds at once.
STEP = 1 << 18


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_pivots(vectors: DataFrame, wanted: int, key: str) -> np.ndarray:
    """At most `wanted` unit vectors around which vectors(key, v) gather, from the SAMPLE rows of least hash: a few rounds of k-means by angle.

    The order is at random, so that the first of them are pivots of their own for smaller groups.
    """
    good = vectors.where("v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    rows = [r["v"] for r in good.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col("v").cast("array<double>").alias("v")).collect()]
    sizes = [len(r) for r in rows]
    size = max(set(sizes), key=sizes.count) if sizes else 0
    x = np.array([r for r in rows if len(r) == size and np.any(r) and np.isfinite(r).all()], float).reshape(-1, max(size, 1))
    if not len(x):
        return np.zeros((0, 1))
    x = unit(x)
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(x))
    centers = np.unique(x, axis=0)[:1] if wanted < 2 else x[order[: min(wanted, len(x))]]
    for _ in range(4 if len(centers) > 1 else 0):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 1e-9
        centers[full] = sums[full] / norm[full, None]
    return centers


def _placed(pivots: np.ndarray, kind: str):
    """group, pivots, id, v -> group, size, cell, angle, id, raw: each usable vector with its cell among its group's first `pivots`; cell -1 for other sizes."""

    def apply(batches):
        for b in batches:
            group, most, ids, vectors = b.columns
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                raw = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                v = raw.astype(float)
                good = np.isfinite(v).all(axis=1) & v.any(axis=1)
                rows, raw, v = rows[good], raw[good], v[good]
                if not len(rows):
                    continue
                cell, angle = np.full(len(rows), -1), np.zeros(len(rows))
                if len(pivots) and size == pivots.shape[1]:
                    few = max(1, STEP // len(pivots))
                    allowed = np.maximum(most.to_numpy()[rows], 1)
                    for i in range(0, len(rows), few):
                        near = unit(v[i : i + few]) @ pivots.T
                        near[np.arange(len(pivots))[None] >= allowed[i : i + few, None]] = -2
                        cell[i : i + few] = near.argmax(axis=1)
                        angle[i : i + few] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                at = pa.array(rows)
                blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([group.take(at), pa.array(np.full(len(rows), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle), ids.take(at), blobs], names=["group", "size", "cell", "angle", "id", "raw"])

    return apply


def _packed(batches):
    """Sorted rows of _placed -> one row a block."""
    from pyspark import TaskContext

    block, held, key = TaskContext.get().partitionId() << 32, [], None

    def told():
        t = pa.Table.from_batches(held).combine_chunks()
        angle = t.column("angle").to_numpy()
        ids = t.column("id").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        m = b"".join(t.column("raw").to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([block], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([float(angle.min())]), pa.array([float(angle.max())]), pa.array([len(ids)], pa.int32()), lists, pa.array([m], pa.binary())],
            names=["group", "block", "size", "cell", "low", "high", "n", "ids", "m"],
        )

    n = 0
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("group", "size", "cell")), strict=True))
        start = 0
        while start < b.num_rows:
            if held and (keys[start] != key or n >= BLOCK):
                yield told()
                held, n, block = [], 0, block + 1
            key, stop = keys[start], start
            while stop < b.num_rows and keys[stop] == key and n + stop - start < BLOCK:
                stop += 1
            held.append(b.slice(start, stop - start))
            n, start = n + stop - start, stop
    if held:
        yield told()


@dataclass
class Cells:
    """blocks(group, block, size, cell, low, high, n, ids, m), the pivots' matrix, and the numpy kind of the vectors' numbers in m."""

    blocks: DataFrame
    pivots: np.ndarray
    kind: str

    def save(self, path: str) -> None:
        """blocks in a folder for each cell, so that a change rewrites the cells that it is in; the pivots beside them."""
        spark = self.blocks.sparkSession
        self.blocks.repartition("cell", F.pmod("block", F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        rows = [(i, [float(x) for x in p], self.kind) for i, p in enumerate(self.pivots)]
        spark.createDataFrame(rows, "pivot int, v array<double>, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cells:
        rows = sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r["pivot"])  # PIVOTS at most
        return Cells(spark.read.parquet(f"{path}/blocks"), np.array([r["v"] for r in rows]) if rows else np.zeros((0, 1)), rows[0]["kind"] if rows else "<f8")


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def packed(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """Blocks of rows(group, pivots, id, v): sorted by group, cell and angle over all tasks, so a cell of any size is many blocks of many tasks."""
    id_type = rows.schema["id"].dataType.simpleString()
    v_type = "array<float>" if kind == "<f4" else "array<double>"
    placed = rows.select("group", "pivots", "id", F.col("v").cast(v_type).alias("v")).mapInArrow(_placed(pivots, kind), f"group string, size int, cell int, angle double, id {id_type}, raw binary")
    order = ["group", "size", "cell", "angle", "id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_packed, f"group string, block long, size int, cell int, low double, high double, n int, ids array<{id_type}>, m binary")


def vector_index(vectors: DataFrame, cells: int | None = None) -> Cells:
    """The cells of vectors(doc_id, v), stored. Vectors that are null, zero or hold a null or a non-finite number are left out."""
    wanted = min(PIVOTS, max(1, math.ceil(vectors.count() / BLOCK))) if cells is None else cells
    pivots = fit_pivots(vectors, wanted, "doc_id")
    rows = vectors.select(F.lit("").alias("group"), F.lit(len(pivots)).alias("pivots"), F.col("doc_id").alias("id"), "v")
    with narrow(vectors.sparkSession):
        return Cells(stored(packed(rows, pivots, _kind(vectors)), "cells"), pivots, _kind(vectors))


def nearest_angle(theta: np.ndarray, low: float, high: float) -> np.ndarray:
    """The least angle that vectors of a ring can have to queries at the angles theta to its pivot, with a margin."""
    return np.maximum(np.maximum(theta - high, low - theta) - ANGLE, 0)


class Asked:
    """A block of queries of one size with their angles to the pivots and the score that each has to reach."""

    def __init__(self, rows: list, pivots: np.ndarray):
        self.ids = [r["query_id"] for r in rows]
        self.matrix = unit(np.array([r["v"] for r in rows], float))
        same = len(pivots) and pivots.shape[1] == self.matrix.shape[1]
        self.angles = np.arccos(np.clip(self.matrix @ pivots.T, -1, 1)) if same else None
        self.least = np.full(len(rows), -np.inf)

    def live(self, size: int, cell: int, low: float, high: float, least: np.ndarray) -> np.ndarray:
        """Which queries a block may hold one of the best for."""
        if size != self.matrix.shape[1]:
            return np.zeros(len(self.ids), bool)
        bound = nearest_angle(self.angles[:, cell], low, high) if cell >= 0 and self.angles is not None else np.zeros(len(self.ids))
        return np.cos(bound) + SLACK >= least

    def home(self, probes: int) -> list[int]:
        """The cells nearest to the queries."""
        return sorted({int(c) for c in np.argsort(self.angles, axis=1)[:, :probes].ravel()}) if self.angles is not None and self.angles.shape[1] else []


def _searched(asked: Asked, k: int, kind: str, probes: int | None):
    kinds = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64())])

    def apply(batches):
        best = Best(len(asked.ids), k)
        best.least = asked.least.copy()
        home = np.argsort(np.argsort(asked.angles, axis=1), axis=1) < probes if probes else None
        for b in batches:
            for r in range(b.num_rows):
                size, cell, low, high = (b.column(c)[r].as_py() for c in ("size", "cell", "low", "high"))
                live = asked.live(size, cell, low, high, best.least)
                if home is not None:
                    live &= home[:, cell]
                own = np.flatnonzero(live)
                if not len(own):
                    continue
                docs = b.column("ids")[r].values.to_numpy()
                v = unit(np.frombuffer(b.column("m")[r].as_py(), kind).reshape(len(docs), size).astype(float))
                few, matrix = max(1, STEP // len(own)), asked.matrix[own]
                # a few vectors at a time, so that the products are no more than STEP whatever the queries
                for i in range(0, len(docs), few):
                    score = np.floor(matrix @ v[i : i + few].T * 1e6 + 0.5) / 1e6
                    query, at = np.nonzero(score >= best.least[own][:, None])
                    best.add(own[query], docs[i + at], score[query, at])
        yield from best.rows(asked.ids, kinds)

    return apply


def _blocks_of(queries: DataFrame, pivots: np.ndarray, block: int):
    """Asked for each stated block of queries and each size of vectors in it."""
    blocks = max(1, math.ceil(queries.count() / block))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).where("v is not null").select("query_id", F.col("v").cast("array<double>").alias("v")).collect()
        sizes: dict[int, list] = {}
        for r in rows:
            if r["v"] and None not in r["v"] and np.any(r["v"]) and np.isfinite(r["v"]).all():
                sizes.setdefault(len(r["v"]), []).append(r)
        for _, own in sorted(sizes.items()):
            yield Asked(own, pivots)


def cell_search(queries: DataFrame, index: Cells, k: int = 100, block: int = 2000, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(top, read): the k nearest doc_ids of each of queries(query_id, v), exactly, and how much was compared for it.

    top is (query_id, doc_id, score, rank) as of retrieval.cosine_search. First each query's nearest `probes` cells are
    searched for a score that its k-th best has at least; then all blocks are gone over with these, and those too far from every query are
    not multiplied. read(query_id, vectors, compared): all vectors, and those in blocks that the final scores don't rule out, from the blocks' numbers alone.
    """
    from lodestar.operators.retrieval import ranked

    spark = index.blocks.sparkSession
    kind, blocks = "query_id long, doc_id long, score double", index.blocks.select("size", "cell", "low", "high", "ids", "m")
    tops, reads = [spark.createDataFrame([], kind)], [spark.createDataFrame([], "query_id long, vectors long, compared long")]
    for asked in _blocks_of(queries, index.pivots, block):
        if home := asked.home(probes):
            near = ranked(blocks.where(F.col("cell").isin(home)).mapInArrow(_searched(asked, k, index.kind, probes), kind), k)
            with narrow(spark):
                least = {r["query_id"]: r["least"] for r in near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a number a query
            asked.least = np.array([least.get(i, -np.inf) for i in asked.ids])
        with narrow(spark):
            top = stored(ranked(blocks.mapInArrow(_searched(asked, k, index.kind, None), kind), k).drop("rank"), "nearest")
        tops.append(top)
        reads.append(_compared(index.blocks, asked, top, k))
    return ranked(reduce(DataFrame.unionByName, tops), k), reduce(DataFrame.unionByName, reads)


def _compared(blocks: DataFrame, asked: Asked, top: DataFrame, k: int) -> DataFrame:
    last = {r["query_id"]: r["least"] for r in top.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    least = np.array([last.get(i, -np.inf) for i in asked.ids])

    def apply(batches):
        every, own = 0, np.zeros(len(asked.ids), np.int64)
        for b in batches:
            for size, cell, low, high, n in zip(*(b.column(c).to_pylist() for c in ("size", "cell", "low", "high", "n")), strict=True):
                every += n
                own += np.where(asked.live(size, cell, low, high, least), n, 0)
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids), pa.array(np.full(len(own), every)), pa.array(own)], names=["query_id", "vectors", "compared"])

    each = blocks.select("size", "cell", "low", "high", "n").mapInArrow(apply, "query_id long, vectors long, compared long")
    return each.groupBy("query_id").agg(F.sum("vectors").alias("vectors"), F.sum("compared").alias("compared"))


def upsert_cells(spark: SparkSession, path: str, changes: DataFrame) -> list[int]:
    """Puts changes(doc_id, v) into a saved index: a changed id leaves its old place. Only the cells that lose or gain a vector are rewritten; their numbers are given back.

    A null v deletes the id. Which cells hold changed ids is read from the blocks' ids alone.
    """
    index = Cells.load(spark, path)
    changed = stored(changes.groupBy("doc_id").agg(F.max_by("v", F.xxhash64("v")).alias("v")), "changes")
    rows = changed.where("v is not null").select(F.lit("").alias("group"), F.lit(max(len(index.pivots), 1)).alias("pivots"), F.col("doc_id").alias("id"), "v")
    with narrow(spark):
        added = stored(packed(rows, index.pivots, index.kind), "added")
    ids = index.blocks.select("cell", F.explode("ids").alias("doc_id")).join(changed.select("doc_id"), "doc_id", "left_semi")
    touched = sorted({r["cell"] for r in ids.select("cell").union(added.select("cell")).distinct().collect()})  # cell numbers, PIVOTS at most
    old = index.blocks.where(F.col("cell").isin(touched))
    item = np.dtype(index.kind).itemsize
    width = F.col("size") * item
    single = old.select("size", "cell", F.posexplode("ids").alias("k", "id"), "m").select("size", "cell", "id", F.substring("m", F.col("k") * width + 1, width).alias("raw"))
    kept = single.join(changed.select(F.col("doc_id").alias("id")), "id", "left_anti")
    number = "float" if index.kind == "<f4" else "double"
    values = kept.mapInArrow(_unpacked(index.kind), f"id long, v array<{number}>").select(F.lit("").alias("group"), F.lit(max(len(index.pivots), 1)).alias("pivots"), "id", "v")
    with narrow(spark):
        new = stored(packed(values.unionByName(rows.select("group", "pivots", "id", F.col("v").cast(f"array<{number}>").alias("v"))), index.pivots, index.kind), "rewritten")
    gone = [c for c in touched if c not in {r["cell"] for r in new.select("cell").distinct().collect()}]
    out = new.unionByName(old.where(F.col("cell").isin(gone)).limit(0))
    out.repartition("cell", F.pmod("block", F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/blocks")
    for c in gone:  # a cell without vectors any more
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks/cell={c}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def _unpacked(kind: str):
    def apply(batches):
        for b in batches:
            rows = [np.frombuffer(r, kind) for r in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float32() if kind == "<f4" else pa.float64()))], names=["id", "v"])

    return apply


def block_pairs(blocks: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """(group, i, j), i <= j: blocks of one group that may hold a pair of cosine `least` or more, from the blocks' numbers alone.

    Pivots are one short array in the plan (PIVOTS at most, their angles to each other as rows).
    """
    spark = blocks.sparkSession
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((0, 0))
    table = F.broadcast(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(apart)] or [(-2, [0.0])], "cell int, apart array<double>"))
    numbers = blocks.select("group", "size", "block", "cell", "low", "high")
    x = numbers.join(table, "cell", "left").select("group", "size", *[F.col(c).alias(f"x_{c}") for c in ("block", "cell", "low", "high", "apart")])
    y = numbers.select("group", "size", *[F.col(c).alias(f"y_{c}") for c in ("block", "cell", "low", "high")])
    gap = F.when(F.col("x_cell") == F.col("y_cell"), F.greatest(F.col("x_low") - F.col("y_high"), F.col("y_low") - F.col("x_high"))).otherwise(F.get("x_apart", F.col("y_cell")) - F.col("x_high") - F.col("y_high"))
    limit = float(np.arccos(np.clip(least - SLACK, -1, 1))) + ANGLE
    near = (F.least("x_cell", "y_cell") < 0) | (gap <= limit)
    return x.join(y, ["group", "size"]).where((F.col("x_block") <= F.col("y_block")) & near).select("group", F.col("x_block").alias("i"), F.col("y_block").alias("j"))
