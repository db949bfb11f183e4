"""Benchmark items inside documents: size-partitioned MinHash containment search, confirmed on exact shingle sets.

A short item has hardly a shingle in common with a long document, seen as sets, so the documents are searched by pieces of
graded sizes: windows of 8, 16, 32 ... neighbouring shingles up to twice the largest item, each overlapping the next by half.
Whatever part of an item stands in a document fills much of some window of its own size. Items are partitioned by size, and a
window is held against the items of at least a quarter of its own size. A window and an item that agree on the minimum under any of
HASHES hash functions make a candidate; its containment in the whole document decides.
Items of at most SMALL shingles fill too little of such a window, so these are looked up by each of their own shingles,
which misses none of them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import pieces, small_batches, texts_of
from lodestar.llm.words import shingle_sets, shingles, words

HASHES, STEP, SMALL = 32, 8, 16
_RNG = np.random.Generator(np.random.PCG64(11))
#: Multiply-shift with 64-bit words: the upper half of a*x + b is universal over 32-bit x.
MULTIPLY = _RNG.integers(0, 1 << 64, (HASHES, 1), dtype=np.uint64)
ADD = _RNG.integers(0, 1 << 64, (HASHES, 1), dtype=np.uint64)
#: Items and bytes of text of one pass over the documents: what a pass sends to every task is bounded by these.
PASS_ITEMS, PASS_BYTES = 20_000, 16_000_000
LEAST_SHARE = 0.8


class Filter:
    """Sorted 64-bit keys with their owners, and a bit for each of 32 cells a key that says where a look-up is worth its while."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.bits = max(12, (len(keys) * 32).bit_length())
        seen = np.zeros(1 << self.bits, bool)
        seen[self._cell(keys)] = True
        self.seen = np.packbits(seen, bitorder="little")

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def owners(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, owners) of those of `keys` that are in the table."""
        cell = self._cell(keys)
        at = np.flatnonzero(self.seen[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
        a, b = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], side="right")
        n = b - a
        where = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[where]


class Items:
    """The shingle sets of one pass's items and their minima, ready for look-up."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = "".join(texts).encode()
        at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
        found = [(i, s) for i, s in zip(ids, shingle_sets(np.frombuffer(raw, np.uint8), at), strict=True) if len(s)]
        self.ids, self.sets = [i for i, _ in found], [s for _, s in found]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        small, large = np.flatnonzero(sizes <= SMALL), np.flatnonzero(sizes > SMALL)
        self.small = Filter(np.concatenate([self.sets[i] for i in small]), np.repeat(small, sizes[small])) if len(small) else None
        signed = np.array([self._minima(self.sets[i]) for i in large], np.uint64).reshape(-1, HASHES)
        #: For each width of windows the items of at least a quarter of that size; the last width holds twice the largest item.
        self.widths: dict[int, Filter] = {}
        width = STEP
        while len(large) and width // 2 < 2 * sizes[large].max():
            own = 2 * sizes[large] >= width // 2
            self.widths[width] = Filter((signed[own] | _FUNCTION.T).ravel(), np.repeat(large[own], HASHES))
            width *= 2

    @staticmethod
    def _minima(s: np.ndarray) -> np.ndarray:
        return (MULTIPLY * (s >> np.uint64(32)) + ADD).min(axis=1) >> np.uint64(32)


#: The number of its function above every minimum.
_FUNCTION = np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(32)


def candidates(items: Items, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) numbers that agree on a minimum in some window, or on a shingle of a small item."""
    n = np.diff(first)
    blocks = -(-n // STEP)
    total = int(blocks.sum())
    found: set[tuple[int, int]] = set()
    if not total or not items.ids:
        return found
    if items.small is not None:
        at, own = items.small.owners(hashes)
        found.update(zip((np.searchsorted(first, at, side="right") - 1).tolist(), own.tolist(), strict=True))
    if not items.widths:
        return found
    text = np.repeat(np.arange(len(n)), blocks)
    starts = np.repeat(first[:-1] - STEP * (np.cumsum(blocks) - blocks), blocks) + STEP * np.arange(total)
    last = np.repeat(np.cumsum(blocks) - 1, blocks)
    x = hashes >> np.uint64(32)
    low = np.empty((HASHES, total), np.uint64)
    for i in range(0, total, 2048):
        a, b = starts[i], starts[i + 2048] if i + 2048 < total else len(x)
        low[:, i : i + 2048] = np.minimum.reduceat(MULTIPLY * x[None, a:b] + ADD, starts[i : i + 2048] - a, axis=1)
    low = low >> np.uint64(32) | _FUNCTION
    each = np.arange(total)
    for width, own_filter in items.widths.items():
        columns = width // STEP
        if columns > 1:
            low = np.minimum(low, low[:, np.minimum(each + columns // 2, last)])
        stride = max(1, columns // 2)
        column = each[(each - (last - blocks[text] + 1)) % stride == 0] if stride > 1 else each
        own_low = low[:, column] if stride > 1 else low
        at, own = own_filter.owners(own_low.ravel())
        found.update(zip(text[column[at % len(column)]].tolist(), own.tolist(), strict=True))
    return found


def confirmed(items: Items, raw: np.ndarray, at: np.ndarray, least: float) -> tuple[list[int], list[int], list[int]]:
    """(texts, items, shared shingles): the candidates whose containment in the whole text is `least` or more."""
    hashes, first = shingles(*words(raw, at))
    docs, own, shared = [], [], []
    sets: dict[int, np.ndarray] = {}
    for t, i in sorted(candidates(items, hashes, first)):
        if t not in sets:
            sets = {t: np.unique(hashes[first[t] : first[t + 1]])}
        both = len(np.intersect1d(sets[t], items.sets[i], assume_unique=True))
        if both >= least * len(items.sets[i]) - 1e-9:
            docs.append(t)
            own.append(i)
            shared.append(both)
    return docs, own, shared


def _clean(items: Items, least: float):
    def apply(batches):
        for rows, raw, at in pieces(batches, limit=1_000_000):
            keep = np.ones(rows.num_rows, bool)
            keep[confirmed(items, raw, at, least)[0]] = False
            yield rows.filter(pa.array(keep))

    return apply


def _search(items: Items, least: float):
    def apply(batches):
        for rows, raw, at in pieces(batches, limit=1_000_000):
            docs, own, shared = confirmed(items, raw, at, least)
            if docs:
                sizes = [len(items.sets[i]) for i in own]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(docs)), pa.array([items.ids[i] for i in own], pa.int64()), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()), pa.array([s / z for s, z in zip(shared, sizes, strict=True)], pa.float64())],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

    return apply


def _passes(benchmark: DataFrame):
    """The benchmark's items, dealt to passes by a hash; the driver holds those of one pass at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: an item of benchmark(item_id, text) whose distinct five-word
    shingles are in a document of docs(doc_id, text) by `least` or more.

    The benchmark is a stated set of queries: it goes over the documents in passes of at most about PASS_ITEMS items and
    PASS_BYTES of text. Items without words or with a null item_id match nothing, as do texts that are null or without
    words. A null doc_id stays null; repeated documents come out as often as they come in, repeated items too. An empty
    table on either side gives an empty result; more columns are ignored.
    """
    docs = texts_of(docs)
    return functools.reduce(DataFrame.unionByName, (docs.mapInArrow(_search(own, least), "doc_id long, item_id long, n_shared long, n_item long, containment double") for own in _passes(benchmark)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item of the benchmark; see contained_items."""
    small_batches(docs.sparkSession)
    return functools.reduce(lambda kept, own: kept.mapInArrow(_clean(own, least), docs.schema), _passes(benchmark), docs)
