"""The queries of the numbered operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import round_trip
from lodestar.llm.chat import chat_format
from lodestar.llm.decontaminate import contained_items
from lodestar.llm.licenses import license_scan
from lodestar.llm.minhash import near_duplicates
from lodestar.llm.ngrams import lm_scores
from lodestar.llm.periods import periodic_runs
from lodestar.llm.pii import personal_data
from lodestar.llm.quality import quality_scores
from lodestar.llm.spelling import spelling_variants
from lodestar.llm.substrings import remove_repeats
from lodestar.llm.tokenfiles import token_files
from lodestar.llm.vectors import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), order=3)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), change=True)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=True).drop("collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_substrings, op3_ngram_lm, op4_vectors, op5_chat, op6_quality, op7_decontamination, op8_pii, op9_bpe, op10_licenses, op11_token_files, op12_spelling, op13_periods)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(name: str, key: str, source: str) -> str:
    """CTEs: {name} has the distinct five-word shingles of each row of a table."""
    return f"""{name}_w as (select {key}, {_WORDS} as ws from {source}),
{name} as (select distinct {key}, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from {name}_w)"""


#: CTEs: reach has for each id on a link of links(a, b) every id that it reaches.
_REACH = "mirror as (select a, b from links union select b, a from links), reach(id, other) as (select a, a from mirror union select r.id, m.b from reach r join mirror m on m.a = r.other), comp as (select id, min(other) as component from reach group by 1)"
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": f"""with recursive {_shingles("s", "doc_id", "documents")}, n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)), {_REACH}
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept from documents d left join n using (doc_id) left join comp on id = d.doc_id""",
    "op4_vectors": f"""with recursive e as (select vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings where label is not null),
links as (select x.vec_id as a, y.vec_id as b from e x join e y on x.label = y.label and x.vec_id < y.vec_id where list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.98e0), {_REACH}, k as (select a, count(*) as c from mirror group by 1)
select vec_id, coalesce(c, 0) as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept from embeddings left join k on a = vec_id left join comp on id = vec_id""",
    "op7_decontamination": f"""with {_shingles("d", "doc_id", "documents")}, {_shingles("i", "item_id", "benchmark")}, n as (select item_id, count(*) as n_item from i group by 1)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*) / any_value(n_item)::double as containment from d join i using (g) join n using (item_id) group by 1, 2 having count(*) >= 0.8e0 * any_value(n_item) - 1e-9""",
}
