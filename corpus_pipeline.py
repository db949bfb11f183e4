"""Documents to tokens: each stage takes all that the one before kept and decides what goes on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import round_trip
from lodestar.llm.decontaminate import clean_documents
from lodestar.llm.frames import Scratch, workspace
from lodestar.llm.minhash import near_duplicates
from lodestar.llm.pii import redacted_documents
from lodestar.llm.quality import good_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return good_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (similarity 0.8 or more); with its doc_id, rows that share it."""
    gone = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return redacted_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded: each text's byte-level BPE and what it decodes to."""
    back = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("PII", personal), ("byte-level BPE", tokens)]
#: No stage but joins can be said in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.parquet of sf_dir.

    Each stage's table is written to the shared folder and read again; what its operators stored meanwhile goes when it
    stands, and so does the table before it: at any time one whole stage is there to go on from. Null ids and texts go
    through every stage (an empty text has no tokens). Rows go or stay by their doc_id: repeats of a row under one doc_id that
    stays all go on, under doc_ids of their own they are near copies. Columns beside those of COLUMNS are left out, and an
    empty table gives an empty result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        table = Scratch(spark, "stage")
        with workspace(spark):
            docs = table.keep(stage(spark, docs, sf_dir), "rows")
        if before:
            before.drop("rows")
        before = table
    return docs
