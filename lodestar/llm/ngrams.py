"""A word bigram or trigram model as an Elias-Fano trie in memory-mapped levels, counted and written by Spark tasks.

Level 1 is the vocabulary: sorted 64-bit word hashes and exact counts, in files by hash range; a word's id is its place.
Level 2 has the successors of every context, in files by context range: monotone Elias-Fano pointers to the contexts' runs,
and in a run the sorted successors, each with the quantised logarithm of its share of the context. A successor is searched
for within the run that its context's pointers give. A frequent context has files of its own, split by successor, so that no file
and no task holds much more than SHARE tokens. Smoothing is Witten-Bell's: with c the context's count and t its distinct
successors, p(w | context) = c / (c + t) * share(w) + t / (c + t) * p(w), and p(w) is add-one.
Level 3, with order 3, has the successors of every pair: its contexts are the pair's place in its file of level 2, so each
file of level 2 has one of level 3, and a frequent pair has files of its own, split by successor. A pair's count is read
from its share. p(w | pair) is smoothed likewise with p(w | last word); the first word of a text has END alone before it.

Files are written to the shared folder and mapped by the tasks that score; they are never gathered on the driver.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import runs
from lodestar.llm.frames import integers, pack, pieces, shared_dir, stored, strings, texts_of, unpack
from lodestar.llm.words import words

#: The token that ends a text and comes before the first word of the next; tokens() keeps it apart from all words.
END = np.int64(-0x7FFFFFFFFFFFFFFF)
SHARE = 1_500_000
MIN_FILES, MIN_RANGE_BITS, RANGE_WORDS = 16, 6, 500_000
#: Shares are kept as 8-bit steps of this many units of log10.
STEP = 9.0 / 255
TEXT_BYTES = 1_500_000
HELD = 1_000_000


# --- Elias-Fano ---------------------------------------------------------------------------------------------------


def _ones_table() -> np.ndarray:
    """[byte, k]: the place of the k-th set bit of a byte, low bits first."""
    out = np.full((256, 8), 8, np.uint8)
    for b in range(256):
        ones = [i for i in range(8) if b >> i & 1]
        out[b, : len(ones)] = ones
    return out


ONES = _ones_table()
ONE_COUNT = (ONES < 8).sum(axis=1).astype(np.int64)
#: The place of every eighth element is kept, so that a look-up mostly reads two or three bytes; after STEPS bytes it goes by
#: the elements before each 64 bits instead, as a frequent context leaves a long gap.
SAMPLE, STEPS = 8, 4


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """Elias-Fano of sorted values under `universe`: [header, upper bits, place of every SAMPLE-th element there, elements before each 64 bits, low parts by byte]."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> low_bits).astype(np.int64)
    place = high + np.arange(n)
    bits = np.zeros((n + (universe >> low_bits) + 128) // 64 * 64, np.uint8)
    bits[place] = 1
    upper = np.packbits(bits, bitorder="little")
    rest = values & ((1 << low_bits) - 1)
    low = [(rest >> (8 * k)).astype(np.uint8) for k in range(-(-low_bits // 8))]
    before = np.concatenate(([0], np.cumsum(ONE_COUNT[upper].reshape(-1, 8).sum(axis=1))[:-1])).astype(np.uint32)
    return [np.array([n, low_bits, len(upper)], np.int64), upper, place[::SAMPLE].astype(np.uint32), before, *low]


class Sequence:
    """A monotone sequence read from mapped memory."""

    def __init__(self, raw: memoryview, at: int):
        self.n, self.low_bits, size = (int(x) for x in np.frombuffer(raw, np.int64, 3, at))
        at += 24
        self.upper = np.frombuffer(raw, np.uint8, size, at)
        at += size + -size % 8
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, np.uint32, samples, at)
        at += 4 * samples + -4 * samples % 8
        self.before = np.frombuffer(raw, np.uint32, size // 8, at)
        at += 4 * len(self.before) + -4 * len(self.before) % 8
        self.low = []
        for _ in range(-(-self.low_bits // 8)):
            self.low.append(np.frombuffer(raw, np.uint8, self.n, at))
            at += self.n + -self.n % 8
        self.end = at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at places i."""
        start = self.samples[i // SAMPLE].astype(np.int64)
        byte, left = start >> 3, i % SAMPLE
        here = self.upper[byte] & (0xFF << (start & 7)).astype(np.uint8)
        go = np.flatnonzero(left >= ONE_COUNT[here])
        steps = 0
        while len(go):
            steps += 1
            if steps == STEPS:
                word = np.searchsorted(self.before, i[go].astype(np.uint32), side="right") - 1
                byte[go], left[go] = word * 8, i[go] - self.before[word]
                here[go] = self.upper[byte[go]]
                go = go[left[go] >= ONE_COUNT[here[go]]]
                continue
            left[go] -= ONE_COUNT[here[go]]
            byte[go] += 1
            here[go] = self.upper[byte[go]]
            go = go[left[go] >= ONE_COUNT[here[go]]]
        out = (byte * 8 + ONES[here, left] - i) << self.low_bits
        for k, plane in enumerate(self.low):
            out |= plane[i].astype(np.int64) << (8 * k)
        return out


# --- files --------------------------------------------------------------------------------------------------------


def write_level(folder: str, arrays: list[np.ndarray]) -> str:
    """The arrays, each from a multiple of 8 bytes, as a new file of the folder; its path."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with where.open_output_stream(f"{path}/{name}") as out:
        for a in arrays:
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + bytes(-len(raw) % 8))
    return f"{folder}/{name}"


def map_level(uri: str) -> memoryview:
    """A file of write_level in mapped memory; one in a remote store is copied to an unnamed local file first."""
    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with tempfile.TemporaryFile() as f, where.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Vocabulary:
    """Level 1: ids and counts of word hashes."""

    def __init__(self, files: list[str]):
        self.files, self.offsets, first = [], [], []
        total = 0
        for uri in files:
            raw = map_level(uri)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            self.files.append((np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)))
            self.offsets.append(total)
            first.append(self.files[-1][0][0])
            total += n
        self.first, self.size = np.array(first, np.int64), total

    def look(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted distinct hashes; id -1 and count 0 for unknown words."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        edges = np.concatenate((np.searchsorted(sorted_hashes, self.first), [len(sorted_hashes)]))
        for (known, count), offset, a, b in zip(self.files, self.offsets, edges[:-1], edges[1:], strict=True):
            if a < b:
                own = sorted_hashes[a:b]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[at] == own
                ids[a:b], counts[a:b] = np.where(hit, at + offset, -1), np.where(hit, count[at], 0)
        return ids, counts


class Placing:
    """Which file of level 2 a pair of ids is in: files by context range, and by successor for the frequent contexts."""

    def __init__(self, size: int, files: int, frequent: dict[int, int]):
        self.size, self.files = size, files
        self.hot = np.array(sorted(frequent), np.int64)
        self.pieces = np.array([frequent[c] for c in self.hot.tolist()], np.int64)
        self.start = files + np.concatenate(([0], np.cumsum(self.pieces)[:-1])).astype(np.int64) if len(self.hot) else np.zeros(0, np.int64)

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = context * self.files // self.size
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[k] == context
            out = np.where(hot, self.start[k] + word * self.pieces[k] // self.size, out)
        return out

    def first_context(self, file: int) -> int:
        return -(-file * self.size // self.files) if file < self.files else int(self.hot[np.searchsorted(self.start, file, side="right") - 1])


class PairPlacing:
    """Which file of level 3 a pair's successor is in: the one that goes with the pair's file of level 2, or one of a frequent pair's own."""

    def __init__(self, size: int, files: int, frequent: dict[int, tuple[int, int]]):
        self.size, self.files = size, files
        self.hot = np.array(sorted(frequent), np.int64)
        self.counts = np.array([frequent[p][0] for p in self.hot.tolist()], np.int64)
        self.pieces = np.array([frequent[p][1] for p in self.hot.tolist()], np.int64)
        self.start = files + np.concatenate(([0], np.cumsum(self.pieces)[:-1])).astype(np.int64) if len(self.hot) else np.zeros(0, np.int64)

    def of(self, pair: np.ndarray, word: np.ndarray, file: np.ndarray) -> np.ndarray:
        """file: that of the pair in level 2."""
        if not len(self.hot):
            return file
        k = np.minimum(np.searchsorted(self.hot, pair), len(self.hot) - 1)
        return np.where(self.hot[k] == pair, self.start[k] + word * self.pieces[k] // self.size, file)

    def number(self, file: int) -> int:
        """Which frequent pair a file of its own belongs to."""
        return int(np.searchsorted(self.start, file, side="right") - 1)


class Successors:
    """One file of level 2 or 3: Elias-Fano pointers to the run of each context, and in each run sorted successors with their shares."""

    SHARES = 10.0 ** (-STEP * np.arange(256))

    @staticmethod
    def arrays(first: int, contexts: np.ndarray, words_: np.ndarray, shares: np.ndarray, size: int) -> list[np.ndarray]:
        """What a file holds, of entries sorted by context (counted from `first`) and word."""
        n = int(contexts[-1]) + 1
        pointers = np.searchsorted(contexts, np.arange(n + 1))
        return [np.array([first, n, len(words_), size], np.int64), *encode(pointers, len(words_) + 1), words_.astype(np.uint32 if size < 1 << 32 else np.int64), shares]

    def __init__(self, uri: str):
        raw = map_level(uri)
        self.first, self.contexts, n, size = (int(x) for x in np.frombuffer(raw, np.int64, 4))
        self.pointers = Sequence(raw, 32)
        kind = np.dtype(np.uint32 if size < 1 << 32 else np.int64)
        self.words = np.frombuffer(raw, kind, n, self.pointers.end)
        self.shares = np.frombuffer(raw, np.uint8, n, self.pointers.end + n * kind.itemsize + -n * kind.itemsize % 8)

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of the context, 0 if never seen; distinct successors of the context in this file; place in this file), contexts sorted."""
        own = context - self.first
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        distinct, back = own[new], np.cumsum(new) - 1
        inside = distinct < self.contexts
        at = np.where(inside, distinct, 0)
        begin, end = self.pointers.get(at), self.pointers.get(at + inside)
        low, top = begin[back], end[back]
        high = top.copy()
        go = np.flatnonzero(low < high)
        while len(go):
            mid = (low[go] + high[go]) >> 1
            less = self.words[mid] < word[go]
            low[go] = np.where(less, mid + 1, low[go])
            high[go] = np.where(less, high[go], mid)
            go = go[low[go] < high[go]]
        hit = np.flatnonzero(low < top)
        hit = hit[self.words[low[hit]] == word[hit]]
        share = np.zeros(len(own))
        share[hit] = self.SHARES[self.shares[low[hit]]]
        return share, (end - begin)[back], low


# --- counting and writing -----------------------------------------------------------------------------------------


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words of each text and END after them."""
    hashes, first = words(raw, at)
    own = hashes.view(np.int64)
    own = np.where(own == END, END + 1, own)
    return np.insert(own, first[1:], END), first + np.arange(len(first))


def _counted(batches):
    """Partial counts of the distinct tokens of a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, raw, at in pieces(batches, limit=TEXT_BYTES):
        held.append(np.unique(tokens(raw, at)[0], return_counts=True))
        if sum(len(h) for h, _ in held) > HELD:
            held = [_added(held)]
    if held:
        hashes, counts = _added(held)
        for i in range(0, len(hashes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["h", "c"])


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Model:
    """Where the levels are and what a scoring task needs besides: its size follows the number of files."""

    def __init__(self, total: int, size: int, vocabulary: list[str], placing: Placing, files: dict[int, str], frequent: dict[int, int]):
        self.total, self.size, self.vocabulary, self.placing, self.files = total, size, vocabulary, placing, files
        self.distinct = np.array([frequent.get(c, 0) for c in placing.hot.tolist()], np.int64)
        #: Level 3, if there is one.
        self.pair_placing: PairPlacing | None = None
        self.pair_files: dict[int, str] = {}
        self.pair_distinct = np.zeros(0, np.int64)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + (self.size + 1)))


def _by_file(file: np.ndarray, pair: np.ndarray, word: np.ndarray, number: np.ndarray):
    """Batches of (file, packed steps of sorted pairs, words, numbers), a row for each file."""
    order = np.argsort(file, kind="stable")
    file = file[order]
    first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
    ends = np.concatenate((first[1:], [len(file)]))
    for i in range(0, len(first), 64):
        cuts = list(zip(first[i : i + 64], ends[i : i + 64], strict=True))
        packed = [[pack(np.diff(pair[order[a:b]], prepend=0)) for a, b in cuts], *([pack(c[order[a:b]]) for a, b in cuts] for c in (word, number))]
        yield pa.RecordBatch.from_arrays([pa.array(file[first[i : i + 64]]), *(pa.array(blobs, pa.binary()) for blobs in packed)], names=["file", "pairs", "words", "counts"])


def _triples_added(pair: np.ndarray, word: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (pair, word), sorted, with their summed numbers."""
    order = np.lexsort((word, pair))
    pair, word, number = pair[order], word[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (word[1:] != word[:-1]))))
    return pair[first], word[first], np.add.reduceat(number, first)


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts every word, every pair of neighbours and, with order 3, every three in docs(doc_id, text) and writes a level of each."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    counts = stored(docs.select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    total, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not size:
        return Model(0, 0, [], Placing(1, 1, {}), {}, {})
    bits = max(MIN_RANGE_BITS, (size // RANGE_WORDS).bit_length())
    ranged = counts.withColumn("range", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int"))
    sorted_ = ranged.select("range", "h", "c").repartition(1 << bits, "range").sortWithinPartitions("range", "h")

    def vocabulary(batches):
        for t in runs(batches, 1):
            h, c = t.column(1).to_numpy(), t.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks()[:1], pa.array([write_level(folder, [np.array([len(h)]), h, c])]), pa.array([len(h)])], names=["range", "file", "n"])

    rows = stored(sorted_.mapInArrow(vocabulary, "range int, file string, n long")).orderBy("range").collect()
    level1 = [r["file"] for r in rows]
    files = max(MIN_FILES, total // SHARE)
    # at most files * 2 words can be this frequent
    often = counts.where(F.col("c") > total // (2 * files)).collect()
    hashes = np.sort(np.array([r["h"] for r in often], np.int64))
    ids, often_counts = Vocabulary(level1).look(hashes)
    placing = Placing(size, files, {int(i): int(-(-2 * c * files // total)) for i, c in zip(ids, often_counts, strict=True)})

    def pairs(batches):
        words_ = Vocabulary(level1)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            keys, number = _added(held)
            if not len(keys):
                return
            file = placing.of(keys // size, keys % size)
            order = np.argsort(file, kind="stable")
            keys, number, file = keys[order], number[order], file[order]
            first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
            ends = np.concatenate((first[1:], [len(file)]))
            blobs = [(pack(np.diff(keys[a:b], prepend=0)), pack(number[a:b])) for a, b in zip(first, ends, strict=True)]
            for i in range(0, len(blobs), 64):
                yield pa.RecordBatch.from_arrays([pa.array(file[first[i : i + 64]]), pa.array([k for k, _ in blobs[i : i + 64]], pa.binary()), pa.array([c for _, c in blobs[i : i + 64]], pa.binary())], names=["file", "keys", "counts"])

        for _, raw, at in pieces(batches, limit=TEXT_BYTES):
            hashes, first = tokens(raw, at)
            distinct, back = np.unique(hashes, return_inverse=True)
            own = words_.look(distinct)[0][back]
            held.append(np.unique(np.roll(own, 1) * size + own, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_added(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from sent()
                    held = []
        if held:
            yield from sent()

    # at most files * 2 pairs can be this frequent
    often_pair = total // (2 * files)

    def successors(batches):
        for t in runs(batches, 1):
            file = t.column(0)[0].as_py()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in t.to_batches():
                (kraw, kat), (craw, cat) = strings(batch.column(1)), strings(batch.column(2))
                held += [(np.cumsum(unpack(kraw[a:b])), unpack(craw[c:d])) for a, b, c, d in zip(kat[:-1], kat[1:], cat[:-1], cat[1:], strict=True)]
            keys, number = _added(held)
            first = placing.first_context(file)
            contexts, words_ = keys // size - first, keys % size
            _, back, run = np.unique(contexts, return_inverse=True, return_counts=True)
            # the count of a context is known here only if it has one file; shares are of all its tokens either way
            totals = np.bincount(back, weights=number) if file < placing.files else np.full(1, float(often_counts[np.searchsorted(ids, first)]))
            shares = np.minimum(np.round(-np.log10(number / totals[back]) / STEP), 255).astype(np.uint8)
            path = write_level(folder, Successors.arrays(first, contexts, words_, shares, size))
            much = number > often_pair
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([path]), pa.array([len(keys)]), pa.array([keys[much]], pa.list_(pa.int64())), pa.array([number[much]], pa.list_(pa.int64()))], names=["file", "path", "n", "pairs", "counts"]
            )

    found = docs.select("text").mapInArrow(pairs, "file long, keys binary, counts binary").repartitionById(files + int(placing.pieces.sum()), F.col("file").cast("int")).sortWithinPartitions("file")
    rows = stored(found.mapInArrow(successors, "file long, path string, n long, pairs array<long>, counts array<long>")).collect()
    distinct: dict[int, int] = {}
    for r in rows:
        if r["file"] >= files:
            c = placing.first_context(r["file"])
            distinct[c] = distinct.get(c, 0) + r["n"]
    model = Model(total, size, level1, placing, {r["file"]: r["path"] for r in rows}, distinct)
    if order < 3:
        return model
    level2 = model.files
    frequent = {p: (c, -(-2 * c * files // total)) for r in rows for p, c in zip(r["pairs"], r["counts"], strict=True)}
    pair_placing = PairPlacing(size, files + int(placing.pieces.sum()), frequent)

    def triples(batches):
        words_ = Vocabulary(level1)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            pair, word = (np.concatenate(c) for c in zip(*held, strict=True))
            if len(pair):
                pair, word, number = _triples_added(pair, word, np.ones(len(pair), np.int64))
                yield from _by_file(pair_placing.of(pair, word, placing.of(pair // size, pair % size)), pair, word, number)

        for _, raw, at in pieces(batches, limit=TEXT_BYTES):
            hashes, first = tokens(raw, at)
            distinct, back = np.unique(hashes, return_inverse=True)
            own = words_.look(distinct)[0][back]
            inner = np.ones(len(own), bool)
            inner[first[:-1]] = False
            held.append(((np.roll(own, 2) * size + np.roll(own, 1))[inner], own[inner]))
            if sum(len(p) for p, _ in held) > HELD:
                yield from sent()
                held = []
        if held:
            yield from sent()

    def pair_successors(batches):
        for t in runs(batches, 1):
            file = t.column(0)[0].as_py()
            columns = []
            for k in (1, 2, 3):
                raw, at = strings(t.column(k))
                blobs = [unpack(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns.append(np.concatenate([np.cumsum(b) for b in blobs] if k == 1 else blobs))
            pair, word, number = _triples_added(*columns)
            if file < pair_placing.files:
                below = Successors(level2[file])
                contexts = below.look(pair // size, pair % size)[2]
                totals = np.bincount(contexts, weights=number)
            else:
                contexts, totals = np.zeros(len(pair), np.int64), np.full(1, float(pair_placing.counts[pair_placing.number(file)]))
            shares = np.minimum(np.round(-np.log10(number / totals[contexts]) / STEP), 255).astype(np.uint8)
            path = write_level(folder, Successors.arrays(0, contexts, word, shares, size))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([path]), pa.array([len(pair)])], names=["file", "path", "n"])

    sent = docs.select("text").mapInArrow(triples, "file long, pairs binary, words binary, counts binary").repartitionById(pair_placing.files + int(pair_placing.pieces.sum()), F.col("file").cast("int")).sortWithinPartitions("file")
    rows = stored(sent.mapInArrow(pair_successors, "file long, path string, n long")).collect()
    model.pair_placing, model.pair_files, model.pair_distinct = pair_placing, {r["file"]: r["path"] for r in rows}, np.zeros(len(pair_placing.hot), np.int64)
    for r in rows:
        if r["file"] >= pair_placing.files:
            model.pair_distinct[pair_placing.number(r["file"])] += r["n"]
    return model


# --- scoring ------------------------------------------------------------------------------------------------------

SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Vocabulary(model.vocabulary)
        self.files = {k: Successors(path) for k, path in model.files.items()}
        self.pair_files = {k: Successors(path) for k, path in model.pair_files.items()}

    def pairs(self, context: np.ndarray, word: np.ndarray, context_count: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, counts, files, places) of distinct sorted pairs; alone: p(word) by itself. An unknown context leaves that."""
        out, counts, files, places = alone.copy(), *(np.zeros(len(alone), np.int64) for _ in range(3))
        known = np.flatnonzero(context >= 0)
        file = self.model.placing.of(context[known], np.maximum(word[known], 0))
        for k, at in _grouped(known, file):
            share, run, place = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), np.int64)
            if k in self.files:
                share, run, place = self.files[k].look(context[at], word[at])
            if k >= self.model.placing.files:
                run = self.model.distinct[np.searchsorted(self.model.placing.hot, context[at])]
            c = context_count[at]
            out[at] = (c * share + run * alone[at]) / np.maximum(c + run, 1)
            counts[at] = np.where(share > 0, np.maximum(np.round(c * share), 1), 0)
            files[at], places[at] = k, place
        return out, counts, files, places

    def triples(self, pair: np.ndarray, count: np.ndarray, file: np.ndarray, place: np.ndarray, word: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of distinct pairs' successors; shorter: p(word | last word). An unknown pair leaves that."""
        out, placing = shorter.copy(), self.model.pair_placing
        known = np.flatnonzero(count > 0)
        own = placing.of(pair[known], np.maximum(word[known], 0), file[known])
        for k, at in _grouped(known, own):
            share, run, c = np.zeros(len(at)), np.zeros(len(at)), count[at]
            hot = k >= placing.files
            if k in self.pair_files:
                share, run, _ = self.pair_files[k].look(np.zeros(len(at), np.int64) if hot else place[at], word[at])
            if hot:
                run, c = self.model.pair_distinct[placing.number(k)], placing.counts[placing.number(k)]
            out[at] = (c * share + run * shorter[at]) / np.maximum(c + run, 1)
        return out

    def score(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """[tokens, known tokens, base score, score] of each text."""
        hashes, first = tokens(raw, at)
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.words.look(distinct)
        base = self.model.base(counts)
        starts = first[:-1]
        before = np.roll(back, 1)
        key, pair = np.unique(before * len(distinct) + back, return_inverse=True)
        x, y = key // len(distinct), key % len(distinct)
        p, count, file, place = self.pairs(ids[x], ids[y], counts[x], 10.0 ** base[y])
        logs = np.log10(p)[pair]
        if self.model.pair_placing is not None:
            inner = np.ones(len(back), bool)
            inner[starts] = False
            # the pair before a word is the one that ended with the word before it
            three, which = np.unique((np.roll(pair, 1) * len(key) + pair)[inner], return_inverse=True)
            u, w = three // max(len(key), 1), three % max(len(key), 1)
            logs[inner] = np.log10(self.triples(ids[x[u]] * self.model.size + ids[y[u]], count[u], file[u], place[u], ids[y[w]], p[w]))[which]
        return [np.diff(first), np.add.reduceat((counts > 0)[back].astype(np.int64), starts), np.add.reduceat(base[back], starts), np.add.reduceat(logs, starts)]


def _grouped(rows: np.ndarray, file: np.ndarray):
    """(file, its rows) for each file."""
    if not len(file):
        return
    order = np.argsort(file, kind="stable")
    rows, file = rows[order], file[order]
    first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
    for a, b in zip(first, np.concatenate((first[1:], [len(file)])), strict=True):
        yield int(file[a]), rows[a:b]


def held_out(ids: np.ndarray, fold: int = 7, rest: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % fold == rest for i in ids.tolist()], bool)


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs(doc_id, text).

    The model learns from the rows whose crc32(doc_id as text) mod 7 is not 2, a null doc_id among them (never held out).
    score is the log10 probability of the text and its end by the model of the order (2 or 3) asked for. A null text is an empty one: its end alone. Repeated
    rows count and come out as often as they come in. If nothing can be learned from, N and V are 0. An empty table gives
    an empty result; more columns are ignored.
    """
    docs = texts_of(docs)
    model = train(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))), order)
    schema = pa.schema(SCORED)

    def apply(batches):
        scorer = Scorer(model)
        for rows, raw, at in pieces(batches, limit=TEXT_BYTES):
            n, known, base, score = scorer.score(raw, at)
            ids = rows.column(0)
            out = held_out(integers(ids)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(score)], schema=schema)

    return docs.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
