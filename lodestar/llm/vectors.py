"""Near-duplicate embeddings: passes that sort by random hashes and compare bounded neighbour windows.

Equal vectors of one label are one class. A pass orders the classes by label and by the concatenated signs of random
projections, and compares each with its next WINDOW neighbours; verified pairs of all passes are united. A window whose
ends share many signs with its middle may be too short: a pair at the threshold is in it for certain only if the pair
shares one sign more. From that each class gets a bound of the chance that all passes miss such a pair. Where the bound
is over MISS the class is crowded: crowded classes go through further rounds of passes, and those that are few in their
label, or crowded after ROUNDS, are compared with all the others of their label in bounded blocks. Inside a component
found so, every pair is then compared in such blocks too, so that a class in a dense group has all its links.
"""

from __future__ import annotations

import functools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import block_pairs, runs
from lodestar.llm.components import components
from lodestar.llm.frames import parts, stored, strings

PASSES, BITS, WINDOW, BLOCK = 16, 48, 32, 512
#: The chance of missing a pair at the threshold from which a class is crowded, rounds of passes at most, classes of a
#: label up to which crowded ones are compared at once (cheaper than a round), and the side of their blocks.
MISS, ROUNDS, FEW, CROWD_BLOCK = 1e-6, 4, 20_000, 2048
LEAST = 0.98


@lru_cache(maxsize=8)
def planes(dimensions: int, round_: int = 0) -> np.ndarray:
    """(PASSES * BITS, dimensions): normals of the random projections of a round."""
    seed = [23, dimensions] if not round_ else [23, dimensions, round_]
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((PASSES * BITS, dimensions))


def unit(raw: np.ndarray, kind: str, rows: int) -> np.ndarray:
    v = np.frombuffer(raw, kind).reshape(rows, -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(kind: str):
    """Rows with a label whose vector has a direction, as bytes; the rest can link with nothing."""
    names, item = ["vec_id", "label", "size", "v"], np.dtype(kind).itemsize

    def apply(batches):
        for b in batches:
            ids, labels, vectors = b.columns
            size = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            x = vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(size)
            count = lambda hit: (lambda c: c[ends] - c[ends - size])(np.concatenate(([0], np.cumsum(hit))))  # noqa: E731, B023
            valid = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            good = valid & (count(np.isfinite(x)) == size) & (count(x != 0) > 0)
            if good.any():
                own = np.concatenate(([0], np.cumsum(size[good] * item))).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(own), pa.py_buffer(x[np.repeat(good, size)].tobytes())])
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([ids.filter(keep), labels.filter(keep), pa.array(size[good].astype(np.int32)), blobs], names=names)

    return apply


def _keys(kind: str, round_: int):
    """Every class once for each pass, with its key of that pass."""

    def apply(batches):
        for b in batches:
            sizes = b.column(2).to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                v = unit(strings(part.column(3))[0], kind, part.num_rows)
                signs = (v @ planes(int(size), round_).T > 0).reshape(part.num_rows, PASSES, BITS)
                keys = (signs * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)
                for k in range(PASSES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k, np.int32)), part.column(1), part.column(2), pa.array(keys[:, k]), part.column(0), part.column(3)], names=["pass", "label", "size", "key", "vec_id", "v"])

    return apply


def _ends(batches):
    """The runs of a sorted partition, each with whether it is the partition's first and last one."""
    held, first = None, True
    for t in runs(batches, 3):
        if held is not None:
            yield held, first, False
            first = False
        held = t
    if held is not None:
        yield held, first, True


def _missed(key: np.ndarray, first: bool, last: bool, least: float) -> np.ndarray:
    """For sorted keys of a run, bounds of the logarithm of the chance that the pass misses a pair at the threshold.

    The pair is compared if it shares more signs than the middle of a window does with the nearest class beyond its end.
    What is beyond the border of a partition isn't known, so there the pass counts as missing everything.
    """
    n = len(key)
    unknown = BITS
    shared = np.full((2, n), -1)
    if n > WINDOW + 1:
        # the first sign that differs, by the exponent of the exclusive or (48 bits are exact in doubles)
        same = BITS - np.frexp((key[WINDOW + 1 :] ^ key[: -WINDOW - 1]).astype(np.float64))[1]
        shared[0, : -WINDOW - 1], shared[1, WINDOW + 1 :] = same, same
    if last:
        shared[0, max(0, n - WINDOW - 1) :] = unknown
    if first:
        shared[1, : WINDOW + 1] = unknown
    most = shared.max(axis=0)
    one = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    chance = np.where(most >= BITS, 0.0, one ** (most + 1.0))
    return np.log(np.maximum(1 - chance, 1e-12))


def _united(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places reaches over the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _neighbours(kind: str, least: float):
    """Of a sorted partition: links of each class with the least place of those that its windows lead to, and, without b, what the pass adds to the logarithm of its chance of missing a pair."""

    def apply(batches):
        for t, first, last in _ends(batches):
            ids, n = t.column(4).to_numpy(), t.num_rows
            v = unit(strings(t.column(5).combine_chunks())[0], kind, n)
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, min(WINDOW, n - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", v[:-d], v[d:]) >= least)
                x.append(near)
                y.append(near + d)
            label = _united(np.concatenate(x), np.concatenate(y), n)
            moved = np.flatnonzero(label != np.arange(n))
            missed = _missed(t.column(3).to_numpy(), first, last, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids[moved], ids))), pa.array(np.concatenate((ids[label[moved]], ids)), mask=np.arange(len(moved) + n) >= len(moved)), pa.array(np.concatenate((np.zeros(len(moved)), missed)))],
                names=["a", "b", "missed"],
            )

    return apply


def _crowd_links(kind: str, least: float):
    """For two blocks of a label's crowded classes: each class with the least place of those that its links lead to."""

    def apply(batches):
        for t in runs(batches, 3):
            own, ids = t.column(3).to_numpy(), t.column(4).to_numpy()
            v = unit(strings(t.column(5).combine_chunks())[0], kind, len(ids))
            x, y = np.flatnonzero(own == t.column(1)[0].as_py()), np.flatnonzero(own == t.column(2)[0].as_py())
            a, b = np.nonzero(v[x] @ v[y].T >= least)
            label = _united(x[a], y[b], len(ids))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

    return apply


def _found_links(classes: DataFrame, kind: str, least: float) -> DataFrame:
    """a, b: links between classes(rep, label, size, v) that join all that belongs together."""
    order = ["pass", "label", "size", "key", "vec_id"]
    left, links, before = classes.select(F.col("rep").alias("vec_id"), "label", "size", "v"), [], None
    for round_ in range(ROUNDS):
        keyed = left.mapInArrow(_keys(kind, round_), "pass int, label long, size int, key long, vec_id long, v binary")
        ranged = keyed.repartitionByRange(max(2, parts(keyed)), *order).sortWithinPartitions(*order)
        # 16 small rows a class beside the links, so that the windows are compared once
        found = stored(ranged.mapInArrow(_neighbours(kind, least), "a long, b long, missed double"))
        links.append(found.where("b is not null").select("a", "b").distinct())
        missed = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("missed").alias("missed"))
        if before is not None:
            missed = missed.join(before.withColumnRenamed("missed", "more"), "vec_id").select("vec_id", (F.col("missed") + F.col("more")).alias("missed"))
        before = stored(missed.where(F.col("missed") > float(np.log(MISS))))
        crowded = left.join(before.select("vec_id"), "vec_id")
        sizes = crowded.groupBy("label", "size").agg(F.count("*").alias("n")).where("n > 1")
        last = round_ == ROUNDS - 1
        at_once = sizes if last else sizes.where(F.col("n") <= FEW)
        members = crowded.join(at_once.select("label", "size"), ["label", "size"]).select(F.concat_ws("/", "label", "size").alias("crowd"), "vec_id", "v")
        pairs = block_pairs(members, "crowd", "vec_id", CROWD_BLOCK).select("crowd", "i", "j", "own", "vec_id", "v")
        links.append(pairs.mapInArrow(_crowd_links(kind, least), "a long, b long").distinct())
        if last or not sizes.where(F.col("n") > FEW).limit(1).count():
            break
        left = stored(crowded.join(sizes.where(F.col("n") > FEW).select("label", "size"), ["label", "size"]).select("vec_id", "label", "size", "v"))
    return functools.reduce(DataFrame.unionByName, links)


def _links(kind: str, least: float):
    """For two blocks of a component: how many vectors each class of one is linked to in the other."""

    def apply(batches):
        for t in runs(batches, 3):
            own, ids, copies = (t.column(k).to_numpy() for k in (3, 4, 5))
            v = unit(strings(t.column(6).combine_chunks())[0], kind, len(ids))
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = v[x] @ v[y].T >= least
            if i == j:
                np.fill_diagonal(near, False)
                pairs = [(x, near @ copies[y])]
            else:
                pairs = [(x, near @ copies[y]), (y, copies[x] @ near)]
            for at, n in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n.astype(np.int64))], names=["vec_id", "n"])

    return apply


def near_vectors(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of embeddings(vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine in doubles is at least `least`. A vector that is
    null, empty, zero or holds a null or a non-finite component links with nothing, nor do vectors of unlike sizes. A
    null vec_id links with nothing, has a null component and is kept. Repeated rows are vectors of their own that link
    with each other. An empty table gives an empty result; more columns are ignored.
    """
    kind = "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    usable = stored(rows.select("vec_id", "label", "embedding").mapInArrow(_usable(kind), "vec_id long, label long, size int, v binary"))
    classes = stored(usable.groupBy("label", "size", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    groups = stored(components(_found_links(classes, kind, least)))
    members = classes.join(groups.select(F.col("id").alias("rep"), "component"), "rep").select("component", F.col("rep").alias("vec_id"), "copies", "v")
    found = block_pairs(members, "component", "vec_id", BLOCK).select("component", "i", "j", "own", "vec_id", "copies", "v").mapInArrow(_links(kind, least), "vec_id long, n long")
    linked = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_class = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(linked.withColumnRenamed("vec_id", "rep"), "rep", "left")
    named = of_class.select("label", "size", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    in_class = usable.join(named, ["label", "size", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.select("vec_id").join(usable.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return in_class.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
