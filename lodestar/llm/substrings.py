"""Removal of byte strings of LENGTH that an earlier document has too: buckets refined by the bucket numbers of later offsets.

1. A window of LENGTH bytes is stood for by the least hash of its GRAM-byte strings, its anchor; neighbouring windows share
   one, so there are about a fourteenth as many anchors as bytes. Anchors that two documents have are candidates.
2. The windows around a candidate anchor make one segment. A task settles equal segments of the documents it holds and
   sends one of each to the anchor's bucket. Segments of an anchor that over `often` documents have are single windows,
   each with the bucket of its own hash, so that what meets in a bucket are equal windows, of which tasks send one each.
3. In a bucket, equal segments are settled; the rest is sorted like suffixes, as far as LENGTH: positions get the number of
   their 8-byte string's bucket, and are refined by sorting on pairs of bucket numbers, their own and that 8, then 16,
   then 18 bytes on, each time reusing the finer numbers. A window whose bucket has a smaller doc_id is a match.
4. A document's matches are united, and its remaining bytes follow.

Segments count as equal when their bytes are. Messages between tasks are columns of packed numbers, a row for each task and
bucket, so rows follow the tasks and not the matches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import runs
from lodestar.llm.frames import integers, pack, parts, pieces, strings, texts_of, unpack
from lodestar.llm.words import LETTERS, mix, powers, prefix_sums

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Anchors keep 40 bits of their hash: one that two strings share by chance only makes a candidate too many.
ANCHOR_BITS = 40
#: Set in a document's list for anchors that go by single windows.
OFTEN = np.int64(1 << ANCHOR_BITS)
PIECE, HELD, HELD_BYTES = 1_000_000, 1_000_000, 16_000_000
#: Bytes of text for each bucket of segments, and for each group of documents whose matches are united in one task.
BUCKET_BYTES, GROUP_BYTES = 32_000_000, 256_000_000


def _each(column) -> list[np.ndarray]:
    raw, at = strings(column)
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, text, anchor) of every run of neighbouring windows with one anchor, and the prefix sums."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, np.zeros(1, np.uint64)
    sums, (_, down) = prefix_sums(raw, LETTERS), powers(len(raw) + 1)
    low = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]) >> np.uint64(64 - ANCHOR_BITS)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[: len(low)]
    real = np.arange(len(low)) <= at[text + 1] - LENGTH
    start = real.copy()
    start[1:] &= (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    end = real.copy()
    end[:-1] &= ~real[1:] | start[1:]
    first = np.flatnonzero(start)
    # least hashes are small, so they are spread again over all their bits, one to one
    anchor = low[first] * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << ANCHOR_BITS) - 1)
    return first, np.flatnonzero(end), text[first].astype(np.int64), anchor.astype(np.int64), sums


def _anchors(buckets: int):
    """Each task's anchors by bucket: those of one document with it; of more, with their number, and the documents apart."""

    def sent(held):
        doc, anchor = np.concatenate([d for d, _ in held]), np.concatenate([a for _, a in held])
        order = np.lexsort((doc, anchor))
        doc, anchor = doc[order], anchor[order]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        doc, anchor = doc[new], anchor[new]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        n = np.diff(np.append(first, len(anchor)))
        many = np.repeat(n > 1, n)
        bucket = anchor[first] * buckets >> ANCHOR_BITS
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(int(k), pack(np.diff(anchor[first[edges[k] : edges[k + 1]]], prepend=0)), pack(doc[first[edges[k] : edges[k + 1]]]), pack(n[edges[k] : edges[k + 1]])) for k in np.flatnonzero(np.diff(edges))]
        anchor, doc = anchor[many], doc[many]
        edges = np.searchsorted(anchor * buckets >> ANCHOR_BITS, np.arange(buckets + 1))
        rows += [(int(k), pack(anchor[edges[k] : edges[k + 1]]), pack(doc[edges[k] : edges[k + 1]]), None) for k in np.flatnonzero(np.diff(edges))]
        for i in range(0, len(rows), 64):
            k, a, d, c = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.binary()), pa.array(d, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "anchors", "docs", "n"])

    def apply(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, raw, at in pieces(batches, limit=PIECE):
            _, _, text, anchor, _ = windows(raw, at)
            if len(text):
                held.append((integers(rows.column(0))[text], anchor))
            if sum(len(d) for d, _ in held) > HELD:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    return apply


def _shared(often: int):
    """(doc_id, anchor) of anchors that at least two documents have, with OFTEN set where more than `often` have it."""

    def out(doc, anchor):
        for i in range(0, len(anchor), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 100_000]), pa.array(anchor[i : i + 100_000])], names=["doc_id", "anchor"])

    def apply(batches):
        for t in runs(batches, 1):
            anchors, docs, n = [], [], []
            for a, d, c in zip(*(_each(t.column(k).combine_chunks()) for k in (1, 2, 3)), strict=True):
                anchors.append(np.cumsum(unpack(a)) if len(c) else unpack(a))
                docs.append(unpack(d))
                # those of several documents of a task come once with their number and once, as 0, for each document
                n.append(unpack(c) if len(c) else np.zeros(len(docs[-1]), np.int64))
            anchor, doc, count = np.concatenate(anchors), np.concatenate(docs), np.concatenate(n)
            order = np.argsort(anchor, kind="stable")
            anchor, doc, count = anchor[order], doc[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            total = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(anchor))))
            wanted = (total > 1) & (count < 2)
            yield from out(doc[wanted], np.where(total > often, anchor | OFTEN, anchor)[wanted])

    return apply


def equal_bytes(raw: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes of raw from each of x are those from y."""
    out, ends, i = np.ones(len(x), bool), np.cumsum(size), 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + PIECE, side="right")))
        n = size[i:j]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[i:j] = np.add.reduceat((raw[np.repeat(x[i:j], n) + inner] != raw[np.repeat(y[i:j], n) + inner]).astype(np.int32), begin) == 0
        i = j
    return out


def _classes(raw, anchor, digest, doc, at, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, own, class): places sorted by class of equal segments of an anchor and then by document; own: whether the document is the class's least.

    Equal digests are confirmed on the bytes; a segment that only has another's digest becomes a class of its own.
    """
    while True:
        order = np.lexsort((doc, size, digest, anchor))
        a, g, z = anchor[order], digest[order], size[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (g[1:] != g[:-1]) | (z[1:] != z[:-1])))
        same = np.cumsum(new) - 1
        lead = order[np.flatnonzero(new)][same]
        rest = np.flatnonzero(~new)
        wrong = rest[~equal_bytes(raw, at[order[rest]], at[lead[rest]], size[order[rest]])]
        if not len(wrong):
            return order, doc[order] == doc[lead], same
        digest = digest.copy()
        digest[order[wrong]] += 1


def _united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with those that meet or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _grouped(doc: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int):
    """(group of documents, packed documents, starts, sizes) of united spans, a row for each group."""
    doc, start, end = _united(doc, start, end)
    group = (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = order[edges[k] : edges[k + 1]]
        yield int(k), pack(np.diff(doc[own], prepend=0)), pack(start[own]), pack((end - start)[own])


def _segments(buckets: int, groups: int):
    """Segments of candidate anchors by bucket (kind 0), and spans settled here by group of documents (kind 1)."""

    def sent(held):
        raw = np.concatenate([h[0] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        at = np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)])
        size, place, doc, anchor, digest = (np.concatenate([h[k] for h in held]) for k in range(2, 7))
        order, own, _ = _classes(raw, anchor, digest, doc, at, size)
        gone, chosen = order[~own], order[own]
        out = [(k % buckets, 1, k, None, d, a, n, None) for k, d, a, n in _grouped(doc[gone], place[gone], place[gone] + size[gone], groups)]
        bucket = anchor[chosen] * buckets >> ANCHOR_BITS
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            c = chosen[edges[k] : edges[k + 1]]
            n = size[c]
            index = np.repeat(at[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((int(k), 0, 0, pack(anchor[c]), pack(doc[c]), pack(place[c]), pack(n), zstandard.compress(raw[index].tobytes(), 1)))
        for i in range(0, len(out), 64):
            k, kind, group, *columns = zip(*out[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(kind, pa.int32()), pa.array(group, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "kind", "group", "anchors", "docs", "starts", "sizes", "bytes"])

    def apply(batches):
        held, n = [], 0
        for rows, raw, at in pieces(batches, limit=PIECE):
            s, e, text, anchor, sums = windows(raw, at)
            if not len(s):
                continue
            lists = rows.column(2)
            own = lists.flatten().to_numpy().astype(np.int64)
            wanted = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()) << ANCHOR_BITS + 1 | own
            often = np.sort(wanted[own & OFTEN != 0] & ~OFTEN)
            wanted = np.sort(wanted & ~OFTEN)
            key = text << ANCHOR_BITS + 1 | anchor
            keep = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            s, e, text, anchor, key = s[keep], e[keep], text[keep], anchor[keep], key[keep]
            if not len(s):
                continue
            _, down = powers(len(raw) + 1)
            if len(often):
                single = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key
                count = (e - s + 1)[single]
                w = np.repeat(s[single] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                h = (mix((sums[w + LENGTH] - sums[w]) * down[w]) >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
                s, e = np.concatenate((s[~single], w)), np.concatenate((e[~single], w))
                text, anchor = np.concatenate((text[~single], np.repeat(text[single], count))), np.concatenate((anchor[~single], h))
            size = e - s + LENGTH
            digest = mix((sums[s + size] - sums[s]) * down[s]).view(np.int64)
            held.append((raw, s, size, s - at[text], integers(rows.column(0))[text], anchor, digest))
            n += len(s)
            if n > HELD or sum(len(h[0]) for h in held) > HELD_BYTES:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)

    return apply


def refine(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bucket): starts of all windows within the given segments of raw, and the number of each one's bucket of equal windows."""

    def within(length: int) -> np.ndarray:
        n = size - length + 1
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())

    place = within(8)
    grams = np.lib.stride_tricks.sliding_window_view(raw, 8)[place]
    bucket = np.zeros(len(raw), np.int64)
    bucket[place] = np.unique(np.ascontiguousarray(grams).view(">u8").ravel(), return_inverse=True)[1]
    length = 8
    while length < LENGTH:
        step = min(length, LENGTH - length)
        length += step
        place = within(length)
        finer = np.unique(bucket[place] << 32 | bucket[place + step], return_inverse=True)[1]
        bucket[place] = finer
    return place, bucket[place]


def digests(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the segments that raw has one after another."""
    ends = np.cumsum(size)
    out = np.empty(len(size), np.int64)
    i = 0
    while i < len(size):
        begin = int(ends[i] - size[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        own = prefix_sums(raw[begin : int(ends[j - 1])], LETTERS)
        at = ends[i:j] - size[i:j] - begin
        out[i:j] = mix((own[at + size[i:j]] - own[at]) * powers(len(own))[1][at] + size[i:j].astype(np.uint64)).view(np.int64)
        i = j
    return out


def settle(anchor, doc, start, size, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) of a bucket's segments that smaller documents' segments match; raw: the segments' bytes in order."""
    at = np.cumsum(size) - size
    order, own, same = _classes(raw, anchor, digests(raw, size), doc, at, size)
    a = anchor[order]
    first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    later = order[~own]
    out = [(doc[later], start[later], start[later] + size[later])]
    # anchors with segments that differ, which may still have windows in common
    kinds = np.concatenate(([True], a[first][1:] != a[first][:-1]))
    several = np.diff(np.append(np.flatnonzero(kinds), len(first)))[np.cumsum(kinds) - 1] > 1
    picked = np.flatnonzero(several)
    mates = np.flatnonzero(own)
    # whole anchors at a time, about PIECE bytes together
    total = np.cumsum(size[order[first[picked]]])
    while len(picked):
        j = max(1, int(np.searchsorted(total, PIECE, side="right")))
        later_anchor = a[first[picked]] != a[first[picked[j - 1]]]
        later_anchor[:j] = False
        j = int(later_anchor.argmax()) if later_anchor.any() else len(picked)
        now, picked, total = picked[:j], picked[j:], total[j:] - total[j - 1]
        seg = order[first[now]]
        n = size[seg]
        begin = np.cumsum(n) - n
        place, bucket = refine(raw[np.repeat(at[seg] - begin, n) + np.arange(n.sum())], begin, n)
        n = n - LENGTH + 1
        who = np.repeat(np.arange(len(seg)), n)
        least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, bucket, doc[seg][who])
        gone = doc[seg][who] > least[bucket]
        starts = gone & np.concatenate(([True], ~gone[:-1] | (who[1:] != who[:-1])))
        ends = gone & np.concatenate((~gone[1:] | (who[1:] != who[:-1]), [True]))
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        if len(s):
            # a result holds for each segment of the same document that has the same bytes
            low, high = np.searchsorted(same[mates], now[who[s]]), np.searchsorted(same[mates], now[who[s]], side="right")
            n = high - low
            mate = order[mates[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            shift = place[s] - begin[who[s]], place[e] - begin[who[e]] + LENGTH
            out.append((doc[mate], start[mate] + np.repeat(shift[0], n), start[mate] + np.repeat(shift[1], n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matches(groups: int):
    """Spans that smaller documents match, packed by group of documents."""

    def apply(batches):
        for t in runs(batches, 1):
            kinds, group = np.array(t.column(1).to_pylist()), t.column(2).to_pylist()
            anchors, docs, starts, sizes, raw = (_each(t.column(k).combine_chunks()) for k in range(3, 8))
            out = [(group[i], *(bytes(x[i]) for x in (docs, starts, sizes))) for i in np.flatnonzero(kinds)]
            at = np.flatnonzero(kinds == 0)
            if len(at):
                anchor, doc, start, size = (np.concatenate([unpack(x[i]) for i in at]) for x in (anchors, docs, starts, sizes))
                out += _grouped(*settle(anchor, doc, start, size, np.concatenate([np.frombuffer(zstandard.decompress(raw[i].tobytes()), np.uint8) for i in at])), groups)
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["group", "docs", "starts", "sizes"])

    return apply


def _united_of_groups(batches):
    """(doc_id, spans): every document's united spans, as start << 32 | end."""
    for t in runs(batches, 1):
        docs, starts, sizes = (_each(t.column(k).combine_chunks()) for k in (1, 2, 3))
        start = np.concatenate([unpack(x) for x in starts])
        doc, start, end = _united(np.concatenate([np.cumsum(unpack(x)) for x in docs]), start, start + np.concatenate([unpack(x) for x in sizes]))
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.append(first, len(doc))
        for i in range(0, len(first), 10_000):
            own = ends[i : i + 10_001]
            spans = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(start[own[0] : own[-1]] << 32 | end[own[0] : own[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), spans], names=["doc_id", "spans"])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(batches):
    for rows, raw, at in pieces(batches):
        out = []
        spans = rows.column(2).to_pylist()
        for k, own in enumerate(spans):
            text = raw[at[k] : at[k + 1]]
            n, removed, joined = len(text), 0, 0
            if own:
                packed = np.array(own, np.int64)
                _, start, end = _united(np.zeros(len(packed), np.int64), packed >> 32, packed & 0xFFFFFFFF)
                keep = np.ones(n + 1, np.int64)
                keep[:] = 0
                np.add.at(keep, start, 1)
                np.add.at(keep, end, -1)
                text = text[np.cumsum(keep)[:n] == 0]
                removed, joined = int((end - start).sum()), len(start)
            left = text.tobytes()
            out.append((n, removed, joined, hashlib.sha256(left).hexdigest(), left))
        n, removed, joined, digest, left = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.int64()), pa.array(digest), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, often: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes): a row for each row of docs(doc_id, text).

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller doc_id. A null text is an empty
    one. A text with a null doc_id loses nothing and takes nothing from others. Rows that share a doc_id take nothing from
    each other; each loses what any of them loses at the same place. An empty table gives an empty result; more columns
    are ignored. Texts are under 4 GB each. often: from how many documents on an anchor's windows go one by one, which
    bounds what meets in a bucket and changes no result.
    """
    docs = texts_of(docs)
    named = docs.where("doc_id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(32, 4 * parts(docs), size // BUCKET_BYTES), max(2, parts(docs), size // GROUP_BYTES)
    sent = named.mapInArrow(_anchors(buckets), "bucket int, anchors binary, docs binary, n binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    lists = sent.mapInArrow(_shared(often), "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    cut_up = named.join(lists, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_segments(buckets, groups), "bucket int, kind int, group int, anchors binary, docs binary, starts binary, sizes binary, bytes binary")
    matches = cut_up.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_matches(groups), "group int, docs binary, starts binary, sizes binary")
    spans = matches.repartition(groups, "group").sortWithinPartitions("group").mapInArrow(_united_of_groups, "doc_id long, spans array<long>")
    # the texts' shuffle is the one of the join above
    with_spans = named.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"))
    return with_spans.unionByName(nameless).mapInArrow(_kept, REMOVED)
