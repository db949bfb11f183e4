"""An index of a corpus for keyword search: each text is split once, its words lie in blocks of documents with bounds of their scores.

A row is a block: its documents, their lengths, and for each of its words the documents that have it (postings), the most
often that one of them has it, and the least length of one of them. A search reads blocks, not texts. Of each query a task
keeps the k best documents met so far; from the bounds follows which queries a block can add nothing to, and which of a
query's words can't bring a document among its best by themselves. Postings of the latter are only looked into for
documents that its other words have led to. What is left out so could not be among the k best, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.tables import narrow, stored

#: Documents and bytes of text of a block.
BLOCK, BLOCK_BYTES = 1024, 4_000_000
#: What the rounding of scores can add to one, with a margin.
SLACK = 2e-6
#: Postings added up, and look-ups of queries' weaker words in their candidates made, at once.
STEP = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters a-z, digits and space stay, in lower case; all other characters are deleted, so that words around them join.
_KEPT = np.zeros(256, bool)
_KEPT[[32, *range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: The two letters beyond ASCII whose small letter is one of ASCII: the Kelvin sign and I with a dot.
_FOLDED = ((b"\xe2\x84\xaa", b"k"), (b"\xc4\xb0", b"i"))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    rows = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = rows.buffers()
    at = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    blob = raw.tobytes()
    if any(old in blob for old, _ in _FOLDED):
        own = [t.as_py() for t in rows]
        for old, new in _FOLDED:
            own = [t.replace(old, new) for t in own]
        raw, at = np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in own])))
    return raw, at - at[0]


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, first): the words of all texts; first[i]:first[i + 1] are those of text i."""
    raw, at = _texts(column)
    kept = _KEPT[raw]
    # an Arrow array has under 2^31 bytes
    at = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))[at]
    letters = _LOWER[raw[kept]]
    inside = letters != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[1:-1][at[1:-1] < len(letters)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    place = np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
    offsets = np.concatenate((place[starts], [place[-1]])).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside].tobytes())])
    return words, np.searchsorted(starts, at)


INDEX = "n_docs int, n_words long, doc_ids array<{id}>, lengths array<int>, terms array<string>, dfs array<int>, most array<int>, least array<int>, places binary, counts binary, worth array<double>"


def _one(array) -> pa.ListArray:
    array = array if isinstance(array, pa.Array) else pa.array(array)
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def _blocks(batches):
    """Rows of the index of a task's documents(doc_id, text, worth)."""
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    for whole in batches:
        sizes = pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        upto, i = np.cumsum(sizes), 0
        while i < whole.num_rows:
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK_BYTES, side="right"))
            j = min(max(j, i + 1), i + BLOCK, whole.num_rows)
            b, i = whole.slice(i, j - i), j
            words, first = split(b.column(1))
            coded, n = words.dictionary_encode(), b.num_rows
            length = np.diff(first)
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
            term, place = key // n, key % n
            df = np.bincount(term, minlength=len(coded.dictionary))
            at = np.cumsum(df) - df
            most = np.maximum.reduceat(tf, at) if len(at) else np.zeros(0, np.int64)
            least = np.minimum.reduceat(length[place], at) if len(at) else np.zeros(0, np.int64)
            columns = [pa.array([n], pa.int32()), pa.array([int(length.sum())], pa.int64()), _one(b.column(0)), _one(length.astype(np.int32)), _one(coded.dictionary), _one(df.astype(np.int32)), _one(most.astype(np.int32)), _one(least.astype(np.int32))]
            columns += [pa.array([place.astype(np.uint16).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary()), _one(b.column(2))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def word_counts(batches):
    """docs, words, terms, dfs of blocks of a task's documents(doc_id, text): how many documents of the block have each of its words."""
    for whole in batches:
        plain = pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(np.zeros(whole.num_rows))], names=["doc_id", "text", "worth"])
        for row in _blocks([plain]):
            yield pa.RecordBatch.from_arrays([row.column(c) for c in ("n_docs", "n_words", "terms", "dfs")], names=["docs", "words", "terms", "dfs"])


def text_index(corpus: DataFrame, worth: str | None = None) -> DataFrame:
    """The index of corpus(doc_id, text), stored; worth names a number of each document that searches can rank by (null: 0).

    A null text has no words. Each task makes blocks of its own documents, so nothing is shuffled.
    """
    value = F.coalesce(F.col(worth).cast("double"), F.lit(0.0)) if worth else F.lit(0.0)
    rows = corpus.select("doc_id", F.col("text").cast("string").alias("text"), value.alias("worth"))
    with narrow(corpus.sparkSession):
        return stored(rows.mapInArrow(_blocks, INDEX.format(id=corpus.schema["doc_id"].dataType.simpleString())), "index")


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def statistics_of(index: DataFrame) -> DataFrame:
    """(term, df): documents of each word, from the blocks' own counts."""
    return index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).withColumnRenamed("terms", "term")


def counts_of(index: DataFrame, words: list[str]) -> DataFrame:
    """(term, df, words) of these words that the corpus has; the row of term null has the number of documents and of all their words."""

    def apply(batches):
        known, df, docs, all_ = pa.array(words, pa.string()), np.zeros(len(words), np.int64), 0, 0
        for b in batches:
            docs += pc.sum(b.column("n_docs")).as_py() or 0
            all_ += pc.sum(b.column("n_words")).as_py() or 0
            at = pc.index_in(b.column("terms").flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
            there = at >= 0
            df += np.bincount(at[there], b.column("dfs").flatten().to_numpy(zero_copy_only=False)[there], len(words)).astype(np.int64)
        own = np.flatnonzero(df)
        terms = pa.concat_arrays([pa.array([None], pa.string()), known.take(pa.array(own))])
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.concatenate(([docs], df[own]))), pa.array(np.concatenate(([all_], np.zeros(len(own), np.int64))))], names=["term", "df", "words"])

    parts = index.select("n_docs", "n_words", "terms", "dfs").mapInArrow(apply, "term string, df long, words long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


class Best:
    """The k best of each query met so far in a task; ties go to the lesser document."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.n = k, np.full(queries, -np.inf), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[query]
        self.held.append((query[good], doc[good], score[good]))
        self.n += int(good.sum())
        if self.n > 2 * self.k * len(self.least) + 1000:
            self.shorten()

    def shorten(self) -> None:
        query, doc, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((doc, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        order, query = order[kept], query[kept]
        full = np.flatnonzero(np.bincount(query, minlength=len(self.least)) == self.k)
        self.least[full] = score[order][np.searchsorted(query, full, side="right") - 1]
        self.held, self.n = [(query, doc[order], score[order])], len(query)

    def rows(self, ids: list, kinds: pa.Schema):
        if self.held:
            self.shorten()
            query, doc, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query], kinds.field(0).type), pa.array(doc.tolist(), kinds.field(1).type), pa.array(score)], names=["query_id", "doc_id", "score"])


def documents(column: pa.Array) -> np.ndarray:
    """Document ids as an array that sorts as they do."""
    return column.to_numpy(zero_copy_only=False).astype(str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], ... begin[0] + n[0] - 1, begin[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


class Asked:
    """One block of queries: its words, and for each word the queries that have it, with its weight in them."""

    def __init__(self, words: list[str], weights: list[tuple[np.ndarray, np.ndarray]], queries: int):
        self.words, self.queries = words, queries
        self.count = np.array([len(q) for q, _ in weights], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.query = np.concatenate([q for q, _ in weights]) if weights else np.zeros(0, np.int64)
        self.weight = np.concatenate([w for _, w in weights]) if weights else np.zeros(0)


def _add_block(asked: Asked, known: pa.Array, row: pa.RecordBatch, best: Best, part, by_worth: bool) -> tuple[int, int]:
    """Adds what one block has for the queries; gives the pairs of a query and one of its words that the block has, and how many of these were scored in full."""
    field = lambda name: row.column(name)[0].values
    number = lambda name: field(name).to_numpy(zero_copy_only=False)
    word = pc.index_in(field("terms"), known).fill_null(-1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(word >= 0)
    if not len(hit):
        return 0, 0
    docs, length, df = documents(field("doc_ids")), number("lengths"), number("dfs").astype(np.int64)
    n, worth = len(docs), number("worth")
    each = asked.count[word[hit]]
    term, at = np.repeat(np.arange(len(hit)), each), _ranges(asked.begin[word[hit]], each)
    query, weight = asked.query[at], asked.weight[at]
    # what a word can add to a query's score at most in this block
    most = np.maximum(weight * part(number("most")[hit], number("least")[hit])[term], 0)
    ceiling = np.full(asked.queries, worth.max()) if by_worth else np.bincount(query, most, asked.queries)
    live = ceiling[query] + SLACK >= best.least[query]
    total_pairs = len(query)
    query, term, weight, most = query[live], term[live], weight[live], most[live]
    if not len(query):
        return total_pairs, 0
    order = np.lexsort((most, query))
    query, term, weight, most = query[order], term[order], weight[order], most[order]
    own, local = np.unique(query, return_inverse=True)
    # of each query the weakest words that together stay under what is needed: they lead to no document
    upto = np.cumsum(most)
    first = np.searchsorted(query, own)
    upto -= (upto[first] - most[first])[local]
    weak = (upto + SLACK < best.least[query]) if not by_worth else np.zeros(len(query), bool)
    # the postings of the words that were asked for, by word and document
    size = df[hit]
    posting = _ranges((np.cumsum(df) - df)[hit], size)
    place = np.frombuffer(row.column("places")[0].as_py(), np.uint16)[posting].astype(np.int64)
    value = part(np.frombuffer(row.column("counts")[0].as_py(), np.int32)[posting], length[place])
    begin = np.cumsum(size) - size
    lead, which = np.flatnonzero(~weak), np.flatnonzero(weak)
    keys = np.repeat(np.arange(len(hit)), size) * n + place if len(which) else None
    rest, n_weak = np.bincount(local[which], most[which], len(own)), np.bincount(local[which], minlength=len(own))
    first_weak = np.cumsum(n_weak) - n_weak
    # a few queries at a time, so that what is held follows STEP and not the queries
    upto = np.cumsum(np.bincount(local[lead], size[term[lead]], len(own)) + n)
    low = 0
    while low < len(own):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STEP, side="right")))
        some = lead[np.searchsorted(local[lead], low) : np.searchsorted(local[lead], high)]
        go = size[term[some]]
        entry = _ranges(begin[term[some]], go)
        key = np.repeat(local[some] - low, go) * n + place[entry]
        total = np.bincount(key, value[entry] * np.repeat(weight[some], go), (high - low) * n)
        met = np.zeros(len(total), bool)
        met[key] = True
        found = np.flatnonzero(met)
        score = total[found]
        found += low * n
        if n_weak[low:high].any():
            enough = score + rest[found // n] + SLACK >= best.least[own[found // n]]
            found, score = found[enough], score[enough]
            looked = np.cumsum(n_weak[found // n])
            i = 0
            while i < len(found):
                j = max(i + 1, int(np.searchsorted(looked, (looked[i - 1] if i else 0) + STEP, side="right")))
                q, d = found[i:j] // n, found[i:j] % n
                pair = which[_ranges(first_weak[q], n_weak[q])]
                wanted = term[pair] * n + np.repeat(d, n_weak[q])
                entry = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                there = keys[entry] == wanted
                score[i:j] += np.bincount(np.repeat(np.arange(j - i), n_weak[q])[there], value[entry[there]] * weight[pair[there]], j - i)
                i = j
        rounded = np.floor(score * 1e6 + 0.5) / 1e6
        if by_worth:
            rounded = np.where(rounded != 0, worth[found % n], 0)
        else:
            found, rounded = found[rounded != 0], rounded[rounded != 0]
        best.add(own[found // n], docs[found % n], rounded)
        low = high
    return total_pairs, len(lead)


def scored_blocks(asked: Asked, ids: list, k: int, kinds: pa.Schema, part, by_worth: bool):
    """A task's rows of the index against one block of queries: k of each query. part(tf, length): what a word adds, times its weight."""

    def apply(batches):
        known, best = pa.array(asked.words), Best(asked.queries, k)
        for batch in batches:
            for r in range(batch.num_rows):
                _add_block(asked, known, batch.slice(r, 1), best, part, by_worth)
        yield from best.rows(ids, kinds)

    return apply
