"""Spelling variants: words that differ by one edit are found in trie shards and follow to their commonest form.

The vocabulary is sorted by range and cut into shards of bounded size, each a compact trie in arrays: nodes in order of
depth, the label of the edge to each, and where its edges begin. A pass broadcasts shards of at most PASS_BYTES; every
word goes over each of them depth-first with the automaton that accepts what is one insertion, deletion or replacement
away, many words at once: a stack holds sets of (word, node, state), of which the deepest are expanded first. What a
pass finds of a word is one row, its number of near words and the best of them; passes are summed up by word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch, parts, texts_of

LENGTH, COUNT, TIMES = 5, 3, 2
#: Words and letters of a shard, bytes of the shards that a pass broadcasts, distinct words that a task counts before it sends them on.
SHARD_WORDS, SHARD_LETTERS, PASS_BYTES, HELD = 250_000, 8_000_000, 48_000_000, 500_000
#: Words searched for together, and states of the automaton expanded together.
BLOCK, STATES = 4096, 1 << 17
#: Letters A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z as a-z; all else separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
CHANGED = 97
#: The automaton's state is a set: at depth d of the trie the word is read up to d without an edit (PLAIN), or with one edit up
#: to d (REPLACED), d + 1 (DELETED: a letter of the word is left out) or d - 1 (INSERTED: the trie has one more).
PLAIN, REPLACED, DELETED, INSERTED = 1, 2, 4, 8


def _words(change: bool):
    """word, n: the counts of a task's words of LENGTH letters or more."""

    def told(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def apply(batches):
        counts: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                # what Latin-1 lacks becomes a question mark, which separates
                own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                start = zlib.crc32(f"{doc}:".encode())
                for w, n in own.items():
                    if len(w) < LENGTH:
                        continue
                    if change and doc is not None:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if not h % CHANGED:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < LENGTH:
                                continue
                    counts[w] += n
            if len(counts) > HELD:
                yield told(counts)
                counts = Counter()
        if counts:
            yield told(counts)

    return apply


class Trie:
    """Sorted distinct words. Node v > 0 is at the end of edge v - 1; the edges of node v are first[v]:first[v + 1], by label."""

    def __init__(self, labels: np.ndarray, first: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        #: ends: the node of each word, counts: each word's n.
        self.labels, self.first, self.ends, self.counts = labels, first, ends, counts
        self.word = np.full(len(labels) + 1, -1, np.int32)
        self.word[ends] = np.arange(len(ends))
        self.keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | labels

    @staticmethod
    def of(words: list[bytes], counts: np.ndarray) -> Trie:
        n = np.array([len(w) for w in words], np.int64)
        at = np.cumsum(n) - n
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        # letters that each word has in common with the one before
        common, live, depth = np.zeros(len(n), np.int64), np.arange(1, len(n)), 0
        while len(live):
            live = live[(depth < n[live]) & (depth < n[live - 1])]
            live = live[flat[at[live] + depth] == flat[at[live - 1] + depth]]
            depth += 1
            common[live] = depth
        # each letter beyond is a node; by depth and then word
        own = n - common
        word = np.repeat(np.arange(len(n)), own)
        depths = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + common[word]
        order = np.argsort(depths, kind="stable")
        word, depths = word[order], depths[order]
        key = depths * len(n) + word
        # the parent is the last node one level up that belongs to this word or one before
        parent = np.where(depths > 0, np.searchsorted(key, key - len(n), side="right"), 0)
        first = np.searchsorted(parent, np.arange(len(word) + 2)).astype(np.uint32)
        ends = np.searchsorted(key, (n - 1) * len(n) + np.arange(len(n)), side="right")
        return Trie(flat[at[word] + depths], first, ends.astype(np.uint32), counts.astype(np.int64))

    def pack(self) -> bytes:
        arrays = [self.first, self.ends, self.counts, self.labels]
        return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])

    @staticmethod
    def unpack(blob: bytes) -> Trie:
        sizes, place, arrays = np.frombuffer(blob, np.int64, 4), 32, []
        for size, kind in zip(sizes.tolist(), (np.uint32, np.uint32, np.int64, np.uint8), strict=True):
            arrays.append(np.frombuffer(blob, kind, size, place))
            place += arrays[-1].nbytes
        first, ends, counts, labels = arrays
        return Trie(labels, first.astype(np.int64), ends, counts)

    def edges(self, node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, children): of those nodes that have an edge of this label."""
        key = node << 8 | label
        edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[edge] == key)
        return there, edge[there] + 1

    def spell(self, which: np.ndarray) -> list[bytes]:
        """The words of these numbers."""
        node, out, live = self.ends[which].astype(np.int64), [[] for _ in which], np.arange(len(which))
        while len(live):
            edge = node[live] - 1
            for i, c in zip(live.tolist(), self.labels[edge].tolist(), strict=True):
                out[i].append(c)
            node[live] = np.searchsorted(self.first, edge, side="right") - 1
            live = live[node[live] > 0]
        return [bytes(letters[::-1]) for letters in out]

    def near(self, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words asked for, words of the trie) that are one edit apart. flat has the words' letters from at on, two zeros or more between them and at both ends."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        every = np.arange(len(at))
        stack = [(0, every, np.zeros(len(at), np.int64), np.full(len(at), PLAIN | DELETED, np.uint8))]
        while stack:
            depth, w, node, state = stack.pop()
            if len(w) > STATES:
                stack.append((depth, w[STATES:], node[STATES:], state[STATES:]))
                w, node, state = w[:STATES], node[:STATES], state[:STATES]
            w, node, state = self._step(depth, w, node, state, flat, at, n)
            if not len(w):
                continue
            depth += 1
            left = n[w] - depth
            ends = self.word[node]
            accepts = (ends >= 0) & ((state & REPLACED > 0) & (left == 0) | (state & DELETED > 0) & (left == 1) | (state & INSERTED > 0) & (left == -1))
            found.append((w[accepts], ends[accepts]))
            stack.append((depth, w, node, state))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _step(self, depth, w, node, state, flat, at, n):
        """All (word, child, state) one level down."""
        place = at[w] + depth
        plain = np.flatnonzero(state & PLAIN)
        # without an edit so far every child goes on
        a, count = self.first[node[plain]], self.first[node[plain] + 1] - self.first[node[plain]]
        row = np.repeat(plain, count)
        edge = np.arange(len(row)) + np.repeat(a - (np.cumsum(count) - count), count)
        label, here = self.labels[edge], place[row]
        hit = label == flat[here]
        ends = n[w[row]] - depth
        new = np.where(hit, PLAIN | state[row] & REPLACED, np.where(ends > 0, REPLACED, 0)).astype(np.uint8) | np.uint8(INSERTED)
        new |= np.where((state[row] & DELETED > 0) & (label == flat[here + 1]) & (ends > 1) | hit & (ends > 1), DELETED, 0).astype(np.uint8)
        out = [(w[row], edge + 1, new)]
        # with one edit, only the child that the word's own letter leads to
        edited = np.flatnonzero(state & PLAIN == 0)
        own, here = state[edited], place[edited]
        letters = {REPLACED: flat[here], DELETED: flat[here + 1], INSERTED: flat[here - 1]}
        done = np.zeros(len(edited), np.uint8)
        for flag, letter in letters.items():
            go = np.flatnonzero((own & flag > 0) & (done & flag == 0) & (letter > 0))
            same = np.zeros(len(go), np.uint8)
            for other, its in letters.items():
                same |= np.where((own[go] & other > 0) & (its[go] == letter[go]), other, 0).astype(np.uint8)
            done[go] |= same
            there, child = self.edges(node[edited[go]], letter[go].astype(np.int64))
            out.append((w[edited[go[there]]], child, same[there]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(batches, size: int):
    """Tables of about `size` rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _shards(batches):
    """number, size, trie: the tries of a sorted partition, in order."""
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    words: list[bytes] = []
    counts: list[int] = []
    letters = 0

    def told():
        trie = Trie.of(words, np.array(counts, np.int64)).pack()
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | done], pa.int64()), pa.array([len(trie)], pa.int64()), pa.array([trie], pa.binary())], names=["number", "size", "trie"])

    for b in batches:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or letters + len(w) > SHARD_LETTERS):
                yield told()
                done, letters, words, counts = done + 1, 0, [], []
            words.append(w.encode("latin-1"))
            counts.append(n)
            letters += len(w)
    if words:
        yield told()


def _searched(sent):
    """word, n_near, best_n, best: what a pass's shards (a broadcast, in the order of their words) have near each word."""

    def apply(batches):
        tries = [Trie.unpack(t) for t in sent.value]
        for table in _blocks(batches, BLOCK):
            words = [w.encode("latin-1") for w in table.column(0).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            flat = np.frombuffer(b"\0\0" + b"\0\0\0".join(words) + b"\0\0\0", np.uint8)
            at = np.cumsum(n + 3) - n - 1
            near, best_n, best = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [b""] * len(n)
            for t in tries:
                w, other = t.near(flat, at, n)
                near += np.bincount(w, minlength=len(n))
                order = np.lexsort((other, -t.counts[other], w))
                w, other = w[order], other[order]
                lead = np.concatenate(([True], w[1:] != w[:-1]))[: len(w)]
                w, other = w[lead], other[lead]
                more = t.counts[other] > best_n[w]  # of equal ones that of the shard before is smaller
                best_n[w[more]] = t.counts[other[more]]
                for i, form in zip(w[more].tolist(), t.spell(other[more]), strict=True):
                    best[i] = form
            has = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array([words[i].decode("latin-1") for i in has], pa.string()), pa.array(near[has]), pa.array(best_n[has]), pa.array([best[i].decode("latin-1") for i in has], pa.string())], names=["word", "n_near", "best_n", "best"])

    return apply


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, best_n, best: for the words of vocabulary(word, n) that have near ones, how many, and the one of largest n (ties: smallest)."""
    spark = vocabulary.sparkSession
    n = vocabulary.count()
    ranged = vocabulary.select("word", "n").repartitionByRange(max(1, -(-n // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = scratch.keep(ranged.mapInArrow(_shards, "number long, size long, trie binary"), "shards")
    passes: list[list[int]] = []
    held = PASS_BYTES + 1
    for r in shards.select("number", "size").orderBy("number").collect():  # two numbers a shard
        if held + r["size"] > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(r["number"])
        held += r["size"]
    asked = vocabulary.select("word").repartition(max(2, parts(vocabulary)), "word")
    found = spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    for k, own in enumerate(passes):
        sent = spark.sparkContext.broadcast([bytes(r["trie"]) for r in shards.where(F.col("number").between(own[0], own[-1])).orderBy("number").collect()])
        one = scratch.keep(asked.mapInArrow(_searched(sent), found.schema), f"near-{k}")
        sent.destroy()
        found = one if len(passes) == 1 else found.unionByName(one)
    if len(passes) < 2:
        return found
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the forms of forms(word, form) lead to in the end. Each round doubles the steps taken; n doubles with every step, so there are few."""
    now, k = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0"), 0
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        k += 1
        now = scratch.keep(ahead, f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, change: bool = False) -> DataFrame:
    """word, n, form, root, n_near, form_n: a row for each word of docs(doc_id, text), see the module.

    Words are runs of letters A-Z, a-z, U+00C0 to U+00FF, A-Z as a-z, that have at least LENGTH letters and occur at least COUNT times in all
    texts. form is the near word of largest n (ties: smallest in code-point order) if that is at least TIMES the word's own, else null; root is
    what the forms lead to. With `change`, a run loses a letter in every document where CHANGED divides the crc32 of `<doc_id>:<run>`. A null text has no words, in
    rows of a null doc_id runs stay as they are, repeated rows count as often as they are there, an empty table gives an empty result; more columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = texts_of(docs).mapInArrow(_words(change), "word string, n long")
    vocabulary = scratch.keep(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT), "vocabulary")
    near = near_words(vocabulary, scratch)
    strong = F.col("best_n") >= TIMES * F.col("n")
    known = vocabulary.join(near, "word", "left").select("word", "n", F.when(strong, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n"))
    known = scratch.keep(known, "known")
    return known.join(roots(known.where("form is not null"), scratch), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
