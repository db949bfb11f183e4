"""Token files, spelling variants and periodic runs against plain versions."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.llm import periods, queries, spelling, tokenfiles
from lodestar.llm.frames import Scratch
from lodestar.llm.words import mix
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def lines(seed=4, n=150):
    """Words of few kinds with stretches that repeat, some of them whole texts."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = r.choice([1, 2, 3, 8, 60])
        w = [f"W{r.randrange(kinds)}é" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            if len(w) > 8:
                a, p = r.randrange(len(w)), r.randint(1, max(1, len(w) // 4))
                for k in range(a, min(len(w), a + r.randint(1, 90))):
                    w[k] = w[a + (k - a) % p]
        out.append(r.choice([" ", "\t", "\n  "]).join(w))
    return [*out, "", None, " \x0b ", "a " * 500, "x y " * 3 + "x", "one two three four five six"]


@pytest.mark.parametrize("change", [False, True])
def test_periodic_runs(spark, change):
    rows = list(enumerate(lines())) + [(None, "b b b b b b b"), (None, None)]
    got = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), change).collect()
    own = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got), key=str)
    assert own == sorted(((i, *plain.periodic(t, i, change)) for i, t in rows), key=str)
    assert not change or sum(r.n_runs > 0 for r in got) > 5


def test_runs_of_documents_that_lie_together():
    """Many short documents searched in one line keep their runs apart."""
    r = random.Random(8)
    docs = [[r.randrange(2) for _ in range(r.randint(0, 40))] for _ in range(300)]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    s, e, q = periods.runs_in(mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(9)), first)
    got = list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True))
    want = [plain.periodic(" ".join(map(str, d)), None)[0] for d in docs]
    assert [sum(first[i] <= x[0] < first[i + 1] for x in got) for i in range(len(docs))] == want


def test_equal_sums_of_unlike_words_are_no_run(monkeypatch):
    """Where sums say equal for everything, the words themselves decide."""
    monkeypatch.setattr(periods.Line, "same", lambda self, a, q, size: np.broadcast_to(True, np.broadcast(a, q, size).shape).copy())
    w = mix(np.array([1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 5, 9, 8, 7, 6, 0], np.uint64))
    s, e, q = periods.runs_of(w, 16)
    assert (4, 11, 1) in set(zip(s.tolist(), e.tolist(), q.tolist(), strict=True))


def test_a_long_text_of_one_word(spark):
    got = periods.periodic_runs(spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli, got.collapsed) == (1, 0, 200_000, 1, 200_000_000, "la")


def spelled(seed=2):
    r = random.Random(seed)
    stems = ["".join(r.choices("abcdeéÿ", k=r.randint(4, 8))) for _ in range(60)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(40):
            x = r.choice(stems)
            if r.random() < 0.3:
                k = r.randrange(len(x))
                x = r.choice([x[:k] + x[k + 1 :], x[:k] + r.choice("abÀ") + x[k + 1 :], x[:k] + r.choice("ac") + x[k:]])
            w.append(r.choice([x, x.upper(), x]))
        rows.append((i, r.choice([" ", "-", "œ", "€1"]).join(w)))
    return [*rows, (None, "hello hello hello hella hella hella hella hella hella hella"), (-3, None), (-4, "")]


@pytest.mark.parametrize(("change", "shard", "passed"), [(True, 250_000, 48_000_000), (False, 17, 48_000_000), (True, 17, 1500)])
def test_spelling_variants(spark, monkeypatch, change, shard, passed):
    """The same words from one trie, from many, and from many passes."""
    monkeypatch.setattr(spelling, "PASS_BYTES", passed)
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    rows = spelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, change).collect()}
    want = plain.spelling(rows, change)
    assert got == want and sum(v[1] is not None for v in want.values()) > 20 and any(v[2] != v[1] for v in want.values() if v[1])


def test_small_sets_of_states(monkeypatch):
    """Split stacks find the same; words of one letter don't multiply states."""
    r = random.Random(3)
    words = sorted({"".join(r.choices("aab", k=r.randint(1, 12))).encode() for _ in range(150)} | {b"a" * 300, b"a" * 301})
    n = np.array([len(w) for w in words])
    flat, at = np.frombuffer(b"\0\0" + b"\0\0\0".join(words) + b"\0\0\0", np.uint8), np.cumsum(n + 3) - n - 1
    trie = spelling.Trie.unpack(spelling.Trie.of(words, n).pack())
    assert trie.spell(np.arange(len(words))) == words
    found = []
    for states in (1 << 17, 5):
        monkeypatch.setattr(spelling, "STATES", states)
        found.append(sorted(zip(*(x.tolist() for x in trie.near(flat, at, n)), strict=True)))
    asked = plain.spelling([(None, " ".join(w.decode() for w in words for _ in range(3)))])
    count = {w: sum(i == k for i, _ in found[0]) for k, w in enumerate(words)}
    assert found[0] == found[1] and len(set(found[0])) == len(found[0])
    both = {w for w in words if len(w) >= 6}
    assert {w: count[w] for w in both} == {w: asked[w.decode()][3] for w in both}


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "chain")).collect()}
    assert got == {w: "w37" for w, _ in chain}


@pytest.fixture(scope="module")
def tokenizer():
    places = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(places.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return places.path("byte_bpe_50k.json"), lambda t: own.encode(t, add_special_tokens=False).ids


def odd_texts():
    r = random.Random(5)
    parts = ["a", "bé", "Z", "'", "'s", "t", "re", "ll", " ", "  ", "\n", "\t", "ß", "ÿ", "1", "23", ".", "!", "-", "—", " ", "　", "中", "🙂", "٣", "<|endoftext|>", "_", "́", "\x85", " "]
    return ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)] + ["", None, "a" * 5000, " " * 700]


def test_token_files(spark, tokenizer, tmp_path):
    path, encode = tokenizer
    rows = [(i * 7 % 4001 - 50, t) for i, t in enumerate(odd_texts())] + [(None, "no number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_files(docs, path, 2, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert got == plain.token_places(rows, encode, 2)
    files = sorted((tmp_path / "t" / "ids").glob("part-*.parquet"))
    assert len(files) > 1
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["place"].encodings
        assert all(c.has_offset_index and (c.has_column_index or c is ids) for c in columns.values())


def test_a_range_of_tokens(spark, tokenizer, tmp_path):
    path, encode = tokenizer
    rows = [(i, t) for i, t in enumerate(odd_texts()[:400])]
    tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/t", path, 2, files=6)
    every = [i for _, t in rows for i in [*encode(t or ""), 2]]
    for start, stop in ((0, 10), (777, 2222), (len(every) - 5, len(every) + 9), (50, 50)):
        got = sorted(tokenfiles.read_range(spark, f"{tmp_path}/t", start, stop).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == every[start:stop] and (not got or got[0].start == start)
    numbers = tokenfiles.read_tokens(spark, f"{tmp_path}/t", "doc_id", "start", "n_tokens")
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1].split(">", 1)[0] and numbers.agg(F.sum("n_tokens")).first()[0] == len(every)


def test_queries_on_the_smallest_tables(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = {name: queries.QUERIES[name](spark, SMALL) for name in ("op11_token_files", "op12_spelling", "op13_periods")}
    got = sorted((tuple(r) for r in found["op11_token_files"].collect()), key=lambda r: r[1])
    assert got == plain.token_places(rows, tokenizer[1], 2)
    assert {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in found["op12_spelling"].collect()} == plain.spelling(rows, True)
    short = {i: t for i, t in rows if len(t or "") < 12_000}
    own = {r.doc_id: tuple(r)[1:] for r in found["op13_periods"].collect()}
    assert set(own) == {i for i, _ in rows} and {i: own[i] for i in short} == {i: plain.periodic(t, i, True) for i, t in short.items()}
