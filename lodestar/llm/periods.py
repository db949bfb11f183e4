"""Periodic runs of words: repeated k-grams say where runs can be, Main and Lorentz's search by halves finds them there.

A run of period q has at least max(6, 4q) words, so it agrees with itself moved by q over at least OVERLAP words, and
each of its words is in a k-gram, k = OVERLAP, that stands in the document twice. Words outside such k-grams can't be in
a run: what is left are segments. Segments lie one after another with a word of its own after each, and halves are those
of the binary grid over them: a run is looked for at the one place in its inside that the highest power of two divides,
within the 2**t words to both sides. As a run has four periods, two of them stand to the left or to the right of that
place, so a test of two equal neighbours for each period finds all; only these are extended.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.frames import integers, pieces, texts_of
from lodestar.llm.words import LETTERS, mix, powers, shingles, words

#: Words of the shortest run, periods of a run, and the words by which every run agrees with itself one period on: min over q of max(6, 4q) - q.
SHORTEST, PERIODS = 6, 4
OVERLAP = min(max(SHORTEST, PERIODS * q) - q for q in range(1, SHORTEST))
#: Tests made at once.
STEP = 1 << 19
CHANGED = 10


def changed(doc: int, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on the document of n words goes on with period p; None where it stays as it is."""
    h = zlib.crc32(str(doc).encode())
    if h % CHANGED or not n:
        return None
    g = h // CHANGED
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def covered(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words are in an OVERLAP-gram that stands at least twice in its own part (first[i]:first[i+1])."""
    inside = np.zeros(len(hashes) + OVERLAP, bool)
    n = np.diff(first)
    grams, _ = shingles(hashes, first, OVERLAP)
    count = np.where(n >= OVERLAP, n - OVERLAP + 1, (n > 0).astype(np.int64))
    part = np.repeat(np.arange(len(n)), count)
    begin = np.arange(len(grams)) - np.repeat(np.cumsum(count) - count, count) + first[part]
    # the part's number goes into the key: equal keys of unlike grams only keep a word that could have gone
    key = mix(grams + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    at = begin[twice]
    for k in range(OVERLAP):
        inside[at + k] = True
    return inside[: len(hashes)]


def segments(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of words that repeated k-grams of their document cover, and then those of their stretch."""
    starts, ends = first[:-1], first[1:]
    for _ in range(2):
        n = ends - starts
        offset = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(offset[-1]) + np.repeat(starts - offset[:-1], n)
        inside = covered(hashes[place], offset)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = offset[1:-1][(offset[1:-1] > 0) & (offset[1:-1] < len(inside))]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        starts, ends = place[opens], place[closes] + 1
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
    return starts, ends


class Line:
    """Words in a line, and sums that tell whether two stretches of them are equal."""

    def __init__(self, w: np.ndarray):
        self.w, self.n = w, len(w)
        self.up = powers(self.n + 1)[0]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(w * self.up[: self.n], out=self.sums[1:])

    def same(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from a and from a + q are equal, by their sums."""
        upto = lambda at: self.sums[np.minimum(at, self.n)]
        return (upto(a + size) - upto(a)) * self.up[q] == upto(a + q + size) - upto(a + q)

    def forward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a are equal to those q further on, up to `most`."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.same(a, q, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a are equal to those q further on, up to `most`."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.same(a - mid, q, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def _tests(line: Line, t: int, longest: int):
    """(place, period, start) of two equal neighbours at the odd multiples of 2**t, by place and then period."""
    places = np.arange(1 << t, line.n, 2 << t)
    q = np.arange(1, min(1 << t - 1, longest // PERIODS) + 1)
    rows = max(1, STEP // len(q))
    for k in range(0, len(places), rows):
        m = places[k : k + rows, None]
        at, of = np.nonzero(line.same(m - 2 * q, q[None], q[None]))
        m_right, q_right = np.nonzero(line.same(m, q[None], q[None]) & (m + 2 * q <= line.n))
        place, period = np.concatenate((m[at, 0], m[m_right, 0])), np.concatenate((q[of], q[q_right]))
        start = np.concatenate((m[at, 0] - 2 * q[of], m[m_right, 0]))
        order = np.lexsort((start, period, place))
        yield place[order], period[order], start[order]


def _exact(line: Line, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words of each [s, e) really have period q."""
    n = e - q - s
    offset = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(s - offset, n)
    return np.add.reduceat(np.concatenate((line.w[at] != line.w[at + np.repeat(q, n)], [False])), offset) == 0


def runs_of(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs in a line of words, none of more than `longest` words."""
    line, found = Line(w), [np.zeros((3, 0), np.int64)]
    t = 2
    while 1 << t < line.n and longest >= SHORTEST:
        for place, period, start in _tests(line, t, longest):
            while len(place):
                lead = np.concatenate(([True], place[1:] != place[:-1]))
                m, q, a = place[lead], period[lead], start[lead]
                left, right = m - (1 << t), np.minimum(m + (1 << t), line.n)
                s = a - line.backward(a, q, a - left)
                e = a + 2 * q + line.forward(a + q, q, right - a - 2 * q)
                for i in np.flatnonzero(~_exact(line, s, e, q)):  # sums of unlike words were equal
                    gaps = np.flatnonzero(w[left[i] : right[i] - q[i]] != w[left[i] + q[i] : right[i]]) + left[i]
                    s[i] = gaps[gaps < a[i]].max(initial=left[i] - 1) + 1
                    e[i] = gaps[gaps >= a[i]].min(initial=right[i] - q[i]) + q[i]
                goes_on = (s == left) & (s > 0) & (w[s - 1] == w[s - 1 + q])
                goes_on |= (e == right) & (e < line.n) & (w[np.minimum(e, line.n - 1)] == w[e - q])
                whole = (e - s >= np.maximum(SHORTEST, PERIODS * q)) & (s < m) & (m < e) & ~goes_on
                found.append(np.array((s[whole], e[whole], q[whole])))
                # what is left of each place: not the multiples of this period inside its stretch
                own = np.cumsum(lead) - 1
                stays = ~lead & ~((period % q[own] == 0) & (s[own] <= start) & (start + 2 * period <= e[own]))
                place, period, start = place[stays], period[stays], start[stays]
        t += 1
    s, e, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def runs_in(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of the runs of all documents, by start and then period; first[i]:first[i+1] are the words of document i."""
    starts, ends = segments(hashes, first)
    n = ends - starts
    if not len(n):
        none = np.zeros(0, np.int64)
        return none, none, none
    offset = np.cumsum(n + 1) - n - 1
    line = mix(np.arange(n.sum() + len(n), dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03))  # words of their own between segments
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    line[place + np.repeat(offset, n)] = hashes[place + np.repeat(starts, n)]
    s, e, q = runs_of(line, int(n.max()))
    moved = (starts - offset)[np.searchsorted(offset, s, side="right") - 1]
    return s + moved, e + moved, q


NONE = (0, None, None, None, None, hashlib.sha256().hexdigest())
FOUND = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.large_string())]


def _told(runs: list[tuple[int, int, int]]) -> tuple:
    """The columns on a document's runs (start, length, period)."""
    if not runs:
        return NONE
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest()


def _collapsed(rows: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, change: bool):
    """For each text its columns after doc_id, the collapsed text as bytes."""
    hashes, first = words(raw, at, LETTERS)
    n = np.diff(first)
    source: dict[int, np.ndarray] = {}
    valid = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
    for i, doc in enumerate(integers(rows.column(0)).tolist()):
        if change and valid[i] and (how := changed(doc, int(n[i]))):
            a, p = how
            source[i] = np.arange(n[i])
            source[i][a:] = a + np.arange(n[i] - a) % p
            hashes[first[i] : first[i + 1]] = hashes[first[i] + source[i]]
    s, e, q = runs_in(hashes, first)
    doc = np.searchsorted(first, s, side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    blob = raw.tobytes()
    for i in range(len(n)):
        own = slice(bounds[i], bounds[i + 1])
        tokens = blob[at[i] : at[i + 1]].split()
        a, b, c = s[own] - first[i], e[own] - first[i], q[own]
        if len(a) or i in source:
            gone = np.zeros(n[i] + 1, np.int64)
            np.add.at(gone, a + c, 1)
            np.add.at(gone, b, -1)
            kept = source.get(i, np.arange(n[i]))[np.cumsum(gone)[:-1] == 0]
            tokens = [tokens[k] for k in kept.tolist()]
        yield *_told(list(zip(a.tolist(), (b - a).tolist(), c.tolist(), strict=True))), b" ".join(tokens)


def periodic_runs(docs: DataFrame, change: bool = False) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_runs, the run of greatest length/period (start, length, period,
    exponent_milli; ties: smallest start, then period), runs_sha256 of all runs, collapsed_sha256 and collapsed: the text's
    words, joined by one space, without those that a run has after its first period.

    Words are runs of bytes other than space and 0x09-0x0D; they are told apart by 64-bit hashes. With `change`, every document whose crc32(doc_id as
    text) is divisible by CHANGED is first made to go on periodically from some word on, see changed(). A null text is an empty one: no
    words, no runs, nulls for the run. A null doc_id stays null, and its text as it is. Repeated rows come out as often as they come in; an empty
    table gives an empty result; more columns are ignored. A text of any length is searched whole, in memory by its length.
    """
    schema = pa.schema([("doc_id", pa.int64()), *FOUND])

    def apply(batches):
        for rows, raw, at in pieces(batches, limit=500_000):
            own = [(*told, hashlib.sha256(left).hexdigest(), left) for *told, left in _collapsed(rows, raw, at, change)]
            arrays = [pa.array(x, pa.large_binary()).cast(t) if t == pa.large_string() else pa.array(x, t) for x, (_, t) in zip(zip(*own, strict=True), FOUND, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], schema=schema)

    spec = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return texts_of(docs).mapInArrow(apply, spec)
