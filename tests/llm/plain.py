"""Plain versions of the operators, and documents of our own to hold them against."""

import collections
import fractions
import hashlib
import math
import random
import re
import struct
import zlib


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def texts(seed=1, n=120):
    """Random words with exact copies, near copies, shared passages, repeats, very short and very long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(400)]
    make = lambda k: " ".join(r.choices(vocabulary, k=k))
    passage = make(40)
    out = [make(r.randint(1, 150)) for _ in range(n)]
    out[5] = make(6000)
    for i in range(10, min(40, n), 3):
        out[i] = out[i - 1]
    for i in range(41, min(80, n), 3):
        w = out[i - 1].split()
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = "x" + r.choice(vocabulary)
        out[i] = " ".join(w)
    for i in range(81, min(100, n), 2):
        out[i] = f"{out[i]} {passage} {make(5)}"
    out += ["der " * 60, "der " * 60, "One TWO", "one two", "", "  \t\n", passage, passage.upper(), "a" * 300, "a" * 200]
    return out


#: Odd rows: nulls in each column, empty texts, repeats; their further columns have names that operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, band string, anchor string, score string, minima string, own string, spans string, c string"


def odd_rows():
    extra = ("z",) * 7
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a text without a number, five words or more"), (4, "one text that stands here twice by itself"), (4, "one text that stands here twice by itself"), (5, "one text that stands here twice by itself"), (6, "short"), (-7, "short")]
    return [(i, t, None, None, None, *extra) for i, t in rows]


def components(ids, links):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def near_duplicates(docs, percent):
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def removed(docs, length=50):
    """doc_id: (n_bytes, n_removed, n_spans, sha256 of what is left)"""
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        own = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        gone = bytearray(len(raw))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + length] = b"\1" * length
        seen.update(own)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def contained(docs, items, least=0.8):
    sets = {i: shingles(t) for i, t in items.items()}
    return {(d, i) for d, t in docs.items() for i, s in sets.items() if s and len(s & shingles(t)) >= least * len(s) - 1e-9}


def bigram_scores(docs, fold=7, rest=2):
    """doc_id: (held_out, n_tokens, n_known, N, base, score) with exact shares of contexts."""
    out_of = lambda i: zlib.crc32(str(i).encode()) % fold == rest
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, t in docs.items():
        if not out_of(i):
            w = [*words(t), None]
            one.update(w)
            for x, y in zip([None, *w], w, strict=False):
                two[x, y] += 1
                after[x].add(y)
    n, v = sum(one.values()), len(one)
    p1 = lambda y: (one[y] + 1) / (n + v + 1)
    result = {}
    for i, t in docs.items():
        w = [*words(t), None]
        score = sum(math.log10((two[x, y] + len(after[x]) * p1(y)) / (one[x] + len(after[x])) if one[x] else p1(y)) for x, y in zip([None, *w], w, strict=False))
        result[i] = (out_of(i), len(w), sum(one[y] > 0 for y in w), n, sum(math.log10(p1(y)) for y in w), score)
    return result


def trigram_scores(docs, fold=7, rest=2):
    """As bigram_scores, with the two words before; the first word of a text has only the end of a text before it."""
    held = lambda i: zlib.crc32(str(i).encode()) % fold == rest
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    after, after_two = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in docs.items():
        if not held(i):
            w = [None, *words(t), None]
            one.update(w[1:])
            for x, y in zip(w, w[1:], strict=False):
                two[x, y] += 1
                after[x].add(y)
            for x, y, z in zip(w, w[1:], w[2:], strict=False):
                three[x, y, z] += 1
                after_two[x, y].add(z)
    n, v = sum(one.values()), len(one)
    p1 = lambda y: (one[y] + 1) / (n + v + 1)
    p2 = lambda x, y: (two[x, y] + len(after[x]) * p1(y)) / (one[x] + len(after[x])) if one[x] else p1(y)
    p3 = lambda x, y, z: (three[x, y, z] + len(after_two[x, y]) * p2(y, z)) / (two[x, y] + len(after_two[x, y])) if two[x, y] else p2(y, z)
    result = {}
    for i, t in docs.items():
        w = [None, *words(t), None]
        score = math.log10(p2(w[0], w[1])) + sum(math.log10(p3(x, y, z)) for x, y, z in zip(w, w[1:], w[2:], strict=False))
        result[i] = (held(i), len(w) - 1, sum(one[y] > 0 for y in w[1:]), n, sum(math.log10(p1(y)) for y in w[1:]), score)
    return result


def quality_model(rows, epochs, alpha, beta, l1, l2, size):
    """A plain follow-the-regularised-leader: rows are (features as {index: value}, label); returns {index: weight}, the bias at `size`."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def quality_tokens(text):
    out, before = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text or ""):
        word = lowered(m[0])
        if word == before:
            out.append("<same>")
        else:
            if len(re.findall("[A-Z]", m[0])) > 1 and not re.search("[a-z]", m[0]):
                out.append("<upper>")
            out.append(word)
        before = word
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licences(text, notices, tag, permissive):
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, by plain search and a parser of two functions."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = [(i, label) for p, label in PHRASES.items() for i in places(p)]
    labels = {label for _, label in base} | {label for p, label in notices.items() if places(p)}
    score = max(0.6 * bool(base), 0.9 * any(places(p) for p in notices))
    free = None

    def either(t):
        value = both(t)
        while t and t[0] == "or":
            t.pop(0)
            right = both(t)
            value = (value[0] | right[0], value[1] or right[1])
        return value

    def both(t):
        value = one(t)
        while t and t[0] == "and":
            t.pop(0)
            right = one(t)
            value = (value[0] | right[0], value[1] and right[1])
        return value

    def one(t):
        token = t.pop(0)
        if token == "(":
            value = either(t)
            assert t.pop(0) == ")"
        else:
            value = ({token}, token.rstrip("+") in permissive)
        if t and t[0] == "with":
            del t[:2]
        return value

    if places(tag):
        for m in re.finditer(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", lowered(text)):
            ids, ok = either(re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", m[1]))
            labels |= ids
            free = ok if free is None else free and ok
            score = 1.0
    at = [i for i, _ in base]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), score, free


def repairs(roles):
    """The least cost of making a conversation legal, over every way to merge, relabel and insert; and the texts of the ways that cost it.

    A turn may join the one before it (1), be given a role (2 unless it is its own), and empty turns may be put before it and at the
    end (3 each). Legal: a system turn at most, first, then user and assistant by turns from a user's to an assistant's.
    """
    every = ("system", "user", "assistant")
    best = {}

    def legal(turns):
        talk = [r for r, _ in turns[1:]] if turns and turns[0][0] == "system" else [r for r, _ in turns]
        return bool(talk) and talk == ["user", "assistant"] * (len(talk) // 2)

    def grow(k, turns, cost, before):
        if cost > 3 * len(roles) + 8:
            return
        if k == len(roles):
            for extra in ((), ("assistant",), ("user", "assistant")):
                done = [*turns, *((r, "") for r in extra)]
                if legal(done):
                    best.setdefault(cost + 3 * len(extra), set()).add("\n".join(f"<|{r}|>\n{t}" for r, t in done) + "\n<|end|>")
            return
        for role in every:
            named = 0 if roles[k] == role else 2
            if before == role:
                grow(k + 1, [*turns[:-1], (role, f"{turns[-1][1]}\n\nt{k}")], cost + named + 1, role)
            for extra in ((), ("user",), ("assistant",)):
                grow(k + 1, [*turns, *((r, "") for r in extra), (role, f"t{k}")], cost + named + 3 * len(extra), role)

    grow(0, [], 0, None)
    least = min(best)
    return least, best[least]


def periodic(text, doc, change=False):
    """(n_runs, start, length, period, exponent_milli, sha256 of the runs, of the kept words) of one document."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if change and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = []
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and w[j] == w[j + q]:
                j += 1
            own = w[k : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                runs.append((k, len(own), q))
            k = max(j, k + 1)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = max(runs, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (*told, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(" ".join(w[i] for i in range(n) if i not in gone)))


def spelling(rows, change=False):
    """word: (n, form, root, n_near, form_n) of rows (doc_id, text)."""
    counts = collections.Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if change and doc is not None and h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    less = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            less[w[:k] + w[k + 1 :]].add((w, k))
    near = collections.defaultdict(set)
    for w in n:
        near[w] |= {x for x, _ in less[w]}
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            if cut in n:
                near[w].add(cut)
            near[w] |= {x for x, j in less[cut] if j == k and x != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], form[w], root, len(near[w]), n[form[w]] if form[w] else None)
    return out


def token_places(rows, encode, end):
    """[(doc_id, start, n_tokens, crc32)] of rows (doc_id, text) with distinct ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text or ""), end]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out
