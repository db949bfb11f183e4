"""Text quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader, scored as sparse dot products.

A text is a stream of tokens: runs of letters and digits in lower case, runs of marks, a marker UPPER before a word all in
capitals, and a marker SAME in place of a token that repeats the one before. Features are the tokens and the pairs of
neighbouring tokens. A feature's value is the logarithm of its count, to unit length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import integers, pieces, small_batches, strings, texts_of
from lodestar.llm.words import FOLDED, SPACE, mix, powers, prefix_sums

SIZE = 1 << 18
#: At most so many labelled rows are learned from, those with the least hash of doc_id: a task can hold them all.
MAX_ROWS = 16_000
#: Epochs and rate are those of the least loss (of seven settings, the fewer epochs of equals) in four-fold cross-validation within the rows learned from.
EPOCHS, ALPHA, BETA, L1, L2 = 6, 5.0, 1.0, 0.002, 0.0005
THRESHOLD = 0.3
KIND = np.ones(256, np.uint8)
KIND[48:58], KIND[65:91], KIND[97:123], KIND[128:] = 2, 2, 2, 2
KIND[SPACE] = 0
CAPITAL, SMALL = np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[65:91], SMALL[97:123] = True, True
UPPER, SAME = np.uint64(0xE7037ED1A0B428DB), np.uint64(0xA0761D6478BD642F)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of every text, sorted by text and feature."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(raw):
        return none
    kind = KIND[raw]
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    s, e = edges[:-1], edges[1:]
    real = kind[s] > 0
    s, e = s[real], e[real]
    if not len(s):
        return none
    text = np.searchsorted(at, s, side="right") - 1
    sums, (_, down) = prefix_sums(raw, FOLDED), powers(len(raw) + 1)
    h = mix((sums[e] - sums[s]) * down[s])
    capitals, small = (np.concatenate(([0], np.cumsum(hit[raw], dtype=np.int32))) for hit in (CAPITAL, SMALL))
    loud = (capitals[e] - capitals[s] > 1) & (small[e] == small[s])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    h[same] = SAME
    marked = np.flatnonzero(loud & ~same)
    h, text = np.insert(h, marked, UPPER), np.insert(text, marked, text[marked])
    after = text[1:] == text[:-1]
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    owner = np.concatenate((text, text[1:][after]))
    feature = np.concatenate((h, pair[after])) % np.uint64(SIZE)
    key, count = np.unique(owner * SIZE + feature.astype(np.int64), return_counts=True)
    owner, value = key // SIZE, np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(at) - 1))
    return owner, key % SIZE, value / norm[owner]


def _featured(batches):
    for rows, raw, at in pieces(batches):
        owner, feature, value = features(raw, at)
        edges = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        f, v = feature.astype("<i4"), value.astype("<f4")
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.array([f[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array([v[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
            names=["doc_id", "quality", "f", "v"],
        )


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1) -> np.ndarray:
    """Weights of SIZE features and, last, the bias, after EPOCHS passes of per-coordinate FTRL-proximal updates."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / alpha + L2))

    for _ in range(epochs):
        for f, v, y in rows:
            i, x = np.append(f, SIZE), np.append(v, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(SIZE + 1))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from docs(doc_id, text) and labels(doc_id, quality 0 or 1), without every fifth doc_id by checksum."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_ROWS)
    # at most MAX_ROWS pairs of integers are broadcast
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(_featured, "doc_id long, quality int, f binary, v binary")

    def fit(batches):
        held = []
        for b in batches:
            (fr, fa), (vr, va) = strings(b.column(2)), strings(b.column(3))
            for k, (i, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                f, v = np.frombuffer(fr[fa[k] : fa[k + 1]].tobytes(), "<i4"), np.frombuffer(vr[va[k] : va[k + 1]].tobytes(), "<f4")
                held.append((zlib.crc32(str(i).encode()), i, y, f, v.astype(float)))
        held.sort(key=lambda r: r[:3])
        w = follow_the_leader([(f, v, y) for _, _, y, f, v in held])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["w"])

    found = rows.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(found[0]["w"], "<f4") if found else np.zeros(SIZE + 1, np.float32)


def scores(model: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of quality 1 of each text."""
    owner, feature, value = features(raw, at)
    dot = np.bincount(owner, weights=model[feature].astype(float) * value, minlength=len(at) - 1) + model[SIZE]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores THRESHOLD or more; see quality_scores for odd rows."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)

    def apply(batches):
        for rows, raw, at in pieces(batches):
            yield rows.filter(pa.array(scores(model, raw, at) >= THRESHOLD))

    return docs.mapInArrow(apply, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs(doc_id, text); score is the probability of quality 1.

    Only texts are scored, never ids, languages, sources or labels. A null text is an empty one, whose score is that of
    the bias. A null doc_id stays null and isn't held out. Labels that are null or not 0 or 1 teach nothing; without any
    label every score is 0.5. Repeated rows come out as often as they come in; an empty table gives an empty result; more
    columns are ignored.
    """
    model = train(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(batches):
        for rows, raw, at in pieces(batches):
            score = scores(model, raw, at)
            ids = rows.column(0)
            out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in integers(ids).tolist()], bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    return texts_of(docs).mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
