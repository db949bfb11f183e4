"""Byte-level BPE over whole texts: pieces of the split pattern as rows of padded id matrices, merged all at once.

Pieces not met before are bucketed by length. In every round each row of a bucket merges its leftmost pair of least
rank; the matrix is compacted by one column and rows without a pair to merge leave. Pair ranks are looked up in an
open-addressing hash table of id pairs. A piece of more than LONG bytes is a matrix of its own, whose rows are blocks of
the piece: the least rank of every row is kept, and a round makes all merges of the least rank in the rows that have it,
so its time follows the merges and not the square of the length.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.frames import pieces, texts_of

NONE = np.int32(0x7FFFFFFF)
LONG, KEPT, CELLS, BLOCK = 4096, 150_000, 1 << 17, 256
BITS = 21


class Vocabulary:
    """The ranks of a file, the hash table of mergeable id pairs, and the bytes of every id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                if (x := self.ranks.get(token[:k])) is not None and (y := self.ranks.get(token[k:])) is not None:
                    left.append(x)
                    right.append(y)
                    rank.append(r)
        self.keys, self.values = np.full(1 << BITS, -1, np.int64), np.full(1 << BITS, NONE, np.int32)
        keys, values = np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(rank, np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << BITS) - 1)
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, r in self.ranks.items():
            by_id[r] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they don't merge (an id under 0 never does)."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(keys.shape, NONE, np.int32)
        flat, to = keys.ravel(), out.reshape(-1)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(flat[open_])
        while len(open_):
            at = self.keys[slots]
            hit = at == flat[open_]
            to[open_[hit]] = self.values[slots[hit]]
            go = ~hit & (at >= 0)
            open_, slots = open_[go], (slots[go] + 1) & ((1 << BITS) - 1)
        return out

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids: a row for each piece, padded with -1. (rows in the order they ended, how many ids each has after all merges, these ids)."""
        n = len(ids)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        row = np.arange(n)
        ranks = self.lookup(ids[:, :-1], ids[:, 1:])
        while n:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(n, np.int64)
            best = ranks[np.arange(n), at] if ranks.shape[1] else np.full(n, NONE)
            live = best != NONE
            if not live.all():
                own = ids[~live]
                there = own >= 0
                ended.append((row[~live], there.sum(axis=1), own[there]))
                ids, ranks, at, best, row = ids[live], ranks[live], at[live], best[live], row[live]
            n = len(ids)
            if not n:
                break
            each, width = np.arange(n), ids.shape[1]
            ids[each, at] = best
            shift = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), 1)
            pair = shift[:, : width - 2]
            ranks = np.take_along_axis(ranks, pair + (pair >= at[:, None]), 1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.lookup(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.lookup(ids[after, at[after]], ids[after, at[after] + 1])
        return tuple(np.concatenate(c) for c in zip(*ended, strict=True))

    def long(self, piece: bytes) -> np.ndarray:
        """The ids of one very long piece after all merges."""
        n = len(piece)
        size = -(-n // BLOCK) * BLOCK
        # a place more at the end stands for what isn't there
        ids = np.full(size + 1, -1, np.int32)
        ids[:n] = self.single[np.frombuffer(piece, np.uint8)]
        after, before = np.minimum(np.arange(1, size + 2), n), np.arange(-1, size)
        before[0] = size
        ids[n:], after[n:] = -1, size
        after[n - 1 : n] = size
        ranks = np.full(size + 1, NONE, np.int32)
        ranks[: n - 1] = self.lookup(ids[: n - 1], ids[1:n])
        rows = ranks[:size].reshape(-1, BLOCK)
        least = rows.min(axis=1)
        while (rank := least.min()) != NONE:
            touched = np.flatnonzero(least == rank)
            row, column = np.nonzero(rows[touched] == rank)
            at = touched[row] * BLOCK + column
            # of pairs that overlap, the leftmost goes first: every other one of a chain
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            right = after[at]
            # a merge that makes a pair of lesser rank ends the round, as that pair goes next
            merged, left = np.full(len(at), rank, np.int32), ids[before[at]]
            left[1:][before[at[1:]] == right[:-1]] = rank
            new = np.minimum(self.lookup(merged, ids[after[right]]), self.lookup(left, merged))
            end = np.flatnonzero(new < rank)
            if len(end):
                at, right = at[: end[0] + 1], right[: end[0] + 1]
            ids[at], ids[right] = rank, -1
            following = after[right]
            after[at] = following
            before[following] = at
            before[size] = size
            ranks[right] = NONE
            changed = np.concatenate((at, before[at]))
            changed = changed[changed < size]
            ranks[changed] = self.lookup(ids[changed], ids[after[changed]])
            blocks = np.unique(np.concatenate((changed, right)) // BLOCK)
            least[blocks] = rows[blocks].min(axis=1)
        return ids[:n][ids[:n] >= 0]

    def learn(self, new: list[str]) -> None:
        """Puts the ids of new pieces into `known`."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for text in new:
            raw = text.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.known[text] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[text] = self.long(raw).astype("<u4").tobytes()
            else:
                n = len(raw)
                by_length.setdefault(n if n <= 32 else 1 << (n - 1).bit_length(), []).append((text, raw))
        for width, rows in by_length.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                lengths = np.array([len(raw) for _, raw in part])
                matrix = np.full((len(part), width), -1, np.int32)
                matrix[np.arange(width)[None, :] < lengths[:, None]] = self.single[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                row, n, ids = self.merge(matrix)
                blob, ends = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
                for r, a, b in zip(row.tolist(), [0, *ends], ends, strict=False):
                    self.known[part[r][0]] = blob[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        self.learn(list(set().union(*split) - self.known.keys()))
        known = self.known
        return [b"".join([known[p] for p in own]) for own in split]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        begin = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.bytes[np.repeat(begin, lengths) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit): a row for each row of docs(doc_id, text).

    path: a rank file that every executor has. A null text is an empty one and has no ids; a null doc_id stays null;
    repeated rows come out as often as they come in; an empty table gives an empty result; more columns are ignored.
    """

    def apply(batches):
        own = vocabulary(path, pattern)
        for rows, _, _ in pieces(batches):
            ids = own.encode([t or "" for t in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(apply, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary): the bytes that the ids of encode() stand for. Null ids are decoded as none."""

    def apply(batches):
        own = vocabulary(path, pattern)
        for rows, raw, at in pieces(batches, "ids"):
            out = [own.decode(np.frombuffer(raw[a:b].tobytes(), "<u4")) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(apply, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() in one task, so that one Python worker holds one vocabulary.

    A row for each row of docs(doc_id, text), repeated ones too. A null or empty text has no ids and decodes to no bytes;
    a null doc_id stays null; texts and pieces may have any length; an empty table gives an empty result; more columns,
    whatever their names, are ignored.
    """

    def apply(batches):
        own = vocabulary(path, pattern)
        for rows, _, _ in pieces(batches):
            ids = own.encode([t or "" for t in rows.column(1).to_pylist()])
            out = [own.decode(np.frombuffer(i, "<u4")) for i in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts_of(docs).mapInArrow(apply, "doc_id long, ids binary, decoded binary")
