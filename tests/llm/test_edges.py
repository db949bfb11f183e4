"""Odd rows, empty tables, clashing columns, and the pipeline."""

import pytest

from lodestar.llm import bpe, chat, decontaminate, licenses, minhash, ngrams, periods, pii, quality, spelling, substrings, tokenfiles, vectors
from tests.llm import plain

EMPTY_LABELS = "doc_id long, quality int, toxic int"


def bpe_of(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def files_of(docs):
    return tokenfiles.token_files(docs, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), 2)


def operators(spark):
    labels = spark.createDataFrame([], EMPTY_LABELS)
    return {
        "minhash": minhash.near_duplicates, "substrings": substrings.remove_repeats, "ngrams": ngrams.lm_scores, "quality": lambda d: quality.quality_scores(d, labels), "pii": pii.personal_data, "bpe": bpe_of, "licenses": licenses.license_scan, "periods": periods.periodic_runs, "files": files_of,
    }


NAMES = ["minhash", "substrings", "ngrams", "quality", "pii", "bpe", "licenses", "periods", "files"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_come_out_as_often(spark, name):
    rows = plain.odd_rows()
    got = operators(spark)[name](spark.createDataFrame(rows, plain.COLUMNS)).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in rows), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], plain.COLUMNS)).count() == 0


def test_defined_results_of_odd_rows(spark):
    docs = spark.createDataFrame(plain.odd_rows(), plain.COLUMNS)
    near = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()]
    assert near.count((4, 4, 4, True)) == 2 and (5, 4, 4, False) in near and (None, 5, None, True) in near and (6, 1, -7, False) in near and (1, 0, 1, True) in near
    cut = {(r.doc_id, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert {(1, 0, 0), (6, 5, 0), (4, len("one text that stands here twice by itself"), 0)} <= cut
    assert {r.score for r in quality.quality_scores(docs, spark.createDataFrame([], EMPTY_LABELS)).collect()} == {0.5}
    runs = {(r.doc_id, r.n_runs, r.start, r.collapsed) for r in periods.periodic_runs(docs).collect()}
    assert {(1, 0, None, ""), (3, 0, None, ""), (6, 0, None, "short"), (4, 0, None, "one text that stands here twice by itself")} <= runs
    places = sorted((r.start, r.n_tokens, r.doc_id) for r in files_of(docs).collect())
    assert [p[0] + p[1] for p in places[:-1]] == [p[0] for p in places[1:]] and [p[2] for p in places] == [None, -7, 1, 2, 3, 4, 4, 5, 6] and places[2][1] == 1
    assert {(r.word, r.n, r.form, r.root, r.n_near) for r in spelling.spelling_variants(docs).collect()} == {("stands", 3, None, "stands", 0), ("twice", 3, None, "twice", 0), ("itself", 3, None, "itself", 0)}
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_contained_items_of_odd_tables(spark):
    docs, none = spark.createDataFrame(plain.odd_rows(), plain.COLUMNS), spark.createDataFrame([], "item_id long, text string, doc_id long")
    assert decontaminate.contained_items(docs, none).count() == 0 and decontaminate.clean_documents(docs, none).count() == docs.count()
    item = spark.createDataFrame([(1, "One text that stands here twice by", 9), (1, None, 9), (None, "short", 9)], none.schema)
    assert sorted(r.doc_id for r in decontaminate.contained_items(docs, item).collect()) == [4, 4, 5]
    assert decontaminate.contained_items(docs.limit(0), item).count() == 0


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, part long, position string"
    rows = [(None, None, None, None, 1, "z"), (1, 1, "user", "a", 1, "z"), (1, 1, "user", "a", 1, "z"), (2, 5, "assistant", "", 1, "z")]
    got = chat.chat_format(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.conv_id or 0, r.position) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert chat.chat_format(spark.createDataFrame([], schema)).count() == 0
    assert "".join(r.rendered for r in sorted(got, key=lambda r: r.position) if r.conv_id == 1) == "<|user|>\na\n<|assistant|>\na\n<|end|>"


def test_a_conversation_over_many_parts(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(400)] + [(i, 0, "user", "x") for i in range(2, 40)]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    long = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in long] == list(range(400)) and {r.cost for r in long} == {0.0} and {r.action for r in long} == {"keep"}


def test_empty_embeddings(spark):
    schema = "vec_id long, embedding array<float>, label int, component string, own string"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1, "z", "z"), (1, [1.0, 0.0], 1, "z", "z"), (2, [1.0, 0.0], None, "z", "z")], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", EMPTY_LABELS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_to_learn_from(spark):
    """Documents that are all held out are scored by an empty model: every token has chance 1."""
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = ngrams.lm_scores(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string"), order=3).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 3


def test_a_very_long_text(spark):
    """Two megabytes in one text go whole through every operator on documents."""
    import random

    r = random.Random(12)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(5000)]
    long = " ".join(r.choices(words, k=370_000))
    tail = long[-5000:]
    rows = [(1, long), (2, f"{tail} and more"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {name: {x.doc_id: x for x in operators(spark)[name](docs).collect()} for name in NAMES}
    assert all(set(own) == {1, 2, 3} for own in found.values())
    assert found["minhash"][1].n_shingles == len(plain.shingles(long)) and found["minhash"][2].component_id == 2
    cut = found["substrings"]
    assert cut[1].n_bytes == len(long) and (cut[2].n_removed, cut[2].n_spans) == (5000, 1)
    assert found["ngrams"][1].n_tokens == len(long.split()) + 1 and found["bpe"][1].decoded.decode() == long and found["licenses"][1].n_words == len(long.split())
    assert found["periods"][1].n_runs == 0 and found["files"][2].start == found["files"][1].n_tokens
    item = spark.createDataFrame([(7, " ".join(long.split()[300_000:300_030]))], "item_id long, text string")
    assert [x.doc_id for x in decontaminate.contained_items(docs, item).collect()] == [1]


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = plain.texts(6, 80)
    item = "these are the words of one item that a test asks for and no document may have"
    texts += [f"{texts[2]} {item} {texts[3]}", "write to someone@mail.example.com about it soon please and thank you"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in t.split()), "en", "s", 1) for i, t in enumerate(plain.texts(7, 40)) if t.strip()]
    spark.createDataFrame(docs + junk, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))] + [(d[0], 0, 0) for d in junk], EMPTY_LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, given = {r.doc_id: r for r in given.collect()}, stage(spark, given, str(tmp_path))
        given = spark.createDataFrame(given.collect(), given.schema)
        after = {r.doc_id: r for r in given.collect()}
        assert tuple(given.columns) == corpus_pipeline.COLUMNS and set(after) <= set(before)
        if name == "MinHash near-dedup":
            _, groups = plain.near_duplicates({i: r.text for i, r in before.items() if i is not None}, 80)
            assert {i for i in after if i is not None} == {i for i, g in groups.items() if i == g}
        if name == "benchmark decontamination":
            assert set(before) - set(after) == {d for d, _ in plain.contained({i: r.text for i, r in before.items()}, {1: item})}
        if name == "PII":
            assert set(before) == set(after) and not any("@mail" in (r.text or "") for r in after.values())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.decoded for i, r in out.items()} == {i: r.text or "" for i, r in after.items()}
    assert sum(i is not None and i >= 1000 for i in out) < len(junk) / 3
