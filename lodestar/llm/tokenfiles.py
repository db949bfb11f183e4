"""Token ids in Parquet files: documents in ascending order, ids as list columns, readable in part.

A file holds a range of doc_ids. Its ids are a list column with dictionary encoding (a vocabulary's numbers in as few bits as its size needs), its numbers
(doc_id, part, place in the part, count) are delta-encoded; row groups have ROW_GROUP bytes and pages PAGE_ROWS rows, and
each page's least and greatest values are in the file's page index. So counts and places are read without any ids, and a
document or a range of tokens without the other row groups and pages. What the files hold is in a small table of parts.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.frames import parts, pieces, shared_dir, texts_of

ROW_GROUP, PAGE_ROWS = 16 << 20, 256
#: Text encoded at a time, and pieces of text whose ids a Python worker remembers.
STEP, REMEMBERED = 2_000_000, 1 << 19


def _cuts() -> np.ndarray:
    """For two bytes in a row, whether the pre-tokeniser's pattern always ends a piece between them, whatever stands around.

    It does before white space after a visible character, as no piece has white space behind another character; where an
    ASCII letter, digit or mark meets one of another kind, but for an apostrophe before a letter ('s, 't, 'll).
    """
    kind = np.zeros(256, np.uint8)  # 1: letter, 2: digit, 3: mark, 4: apostrophe, 5: white space, 0: all else
    for c in range(33, 127):
        kind[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if chr(c) == "'" else 3
    kind[[9, 10, 13, 32]] = 5
    ends = np.zeros((6, 6), bool)
    ends[1:5, 5] = True
    ends[1, [2, 3, 4]] = ends[2, [1, 3, 4]] = ends[3, [1, 2]] = True
    return ends[kind[:, None], kind[None]].ravel()


CUTS = _cuts()


#: Second bytes of the letters from U+00C0 to U+00FF, whose first is 0xC3: all but those of the two signs among them.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_AFTER_LATIN = np.zeros(256, bool)
_AFTER_LATIN[[9, 10, 13, *(c for c in range(32, 127) if not chr(c).isalpha())]] = True


def cut(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of pieces of the texts that can be encoded one by one, the texts' own offsets among them."""
    if not len(raw):
        return at
    ends = CUTS[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
    if len(raw) > 2:  # a two-byte letter before anything that is no letter
        ends[1:] |= (raw[:-2] == 0xC3) & _LATIN[raw[1:-1]] & _AFTER_LATIN[raw[2:]]
    inner = np.zeros(len(raw) + 1, bool)
    inner[1:-1] = ends
    inner[at] = True
    return np.flatnonzero(inner)


class Encoder:
    """A tokenizers file, with the ids of pieces met before: at most REMEMBERED of them, the rest are encoded anew."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}

    def pieces(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit integers."""
        own = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(own) if ids is None]
        for i, found in zip(new, self.tokenizer.encode_batch_fast([distinct[i].decode() for i in new], add_special_tokens=False), strict=True):
            own[i] = array("i", found.ids).tobytes()
            if len(self.known) < REMEMBERED and len(distinct[i]) < 64:
                self.known[distinct[i]] = own[i]
        return own

    def texts(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each with `end` after it."""
        offsets = cut(raw, at)
        column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())]).dictionary_encode()
        # the end is one more piece, after all of those of a text
        own = [*self.pieces(column.dictionary.to_pylist()), array("i", [end]).tobytes()]
        size = np.fromiter(map(len, own), np.int32, len(own)) // 4
        begin, flat = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(own), np.int32)
        last = np.searchsorted(offsets, at)[1:] if len(offsets) > 1 else np.zeros(len(at) - 1, np.int64)
        which = np.insert(column.indices.to_numpy(), last, len(own) - 1)
        count = size[which]
        upto = np.cumsum(count, dtype=np.int64)
        step = np.repeat((begin[which] - (upto - count)).astype(np.int32), count)
        step += np.arange(len(step), dtype=np.int32)
        first = np.concatenate(([0], upto[last + np.arange(len(last))])) if len(last) else np.zeros(1, np.int64)
        return flat[step], first


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


WRITTEN = "doc_id long, part int, place long, n_tokens long, ids array<int>"
IDS = pa.list_(pa.field("element", pa.int32(), nullable=False))


def _encoded(tokenizer: str, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", IDS)])

    def apply(batches):
        part, done = TaskContext.get().partitionId(), 0
        for rows, raw, at in pieces(batches, limit=STEP):
            ids, first = encoder(tokenizer).texts(raw, at, end)
            column = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)).cast(IDS)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(n, part, np.int32)), pa.array(done + first[:-1]), pa.array(np.diff(first)), column], schema=schema)
            done += int(first[-1])

    return apply


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, files: int | None = None) -> None:
    """Writes the ids of docs(doc_id, text) to `path`: ids/ has a row for each row of docs, parts/ a row for each of about `files` files.

    Rows go in ascending order of doc_id, nulls first; those of one doc_id by the hash of their text. Each text is encoded
    whole and by itself, strings of special tokens as ordinary text, and gets the id `end` after it; a null text is an
    empty one and has that id only. Repeated rows are written as often as they are there; more columns are left out. Texts
    are ranged by doc_id and encoded in the task that writes them.
    """
    rows = texts_of(docs)
    n = files or max(2, parts(rows))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(_encoded(tokenizer, end), WRITTEN)
    out = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP)
    out = out.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
    out.parquet(f"{path}/ids")
    # the numbers alone are read for the table of parts; a running sum over one row a file
    own = rows.sparkSession.read.schema(WRITTEN).parquet(f"{path}/ids").groupBy("part", F.col("_metadata.file_path").alias("file"))
    told = own.agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The rows of written ids with `columns` of doc_id, start (ids of all rows before), n_tokens, ids; all of them if none is named."""
    places = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("before")))
    rows = spark.read.schema(WRITTEN).parquet(f"{path}/ids").join(places, "part").withColumn("start", F.col("before") + F.col("place"))
    return rows.select(*(columns or ("doc_id", "start", "n_tokens", "ids")))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the rows with ids at places start <= place < stop of all ids, cut to these; only the files, row groups and pages that hold them are read."""
    own = spark.read.parquet(f"{path}/parts").where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start)).orderBy("part").collect()
    none = spark.createDataFrame([], "doc_id long, start long, ids array<int>")
    for p in own:  # the files that a stated range lies in, each with the bounds of its own places
        rows = spark.read.schema(WRITTEN).parquet(p["file"])
        rows = rows.where((F.col("place") < stop - p["start"]) & (F.col("place") + F.col("n_tokens") > start - p["start"])).withColumn("own", F.col("place") + p["start"])
        skip = F.greatest(F.lit(start) - F.col("own"), F.lit(0)).cast("int")
        taken = F.least(F.lit(stop) - F.col("own"), F.col("n_tokens")).cast("int") - skip
        none = none.unionByName(rows.select("doc_id", (F.col("own") + skip).alias("start"), F.slice("ids", skip + 1, taken).alias("ids")))
    return none


def _sums(batches):
    for b in batches:
        lists = b.column(3)
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        sums = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of docs(doc_id, text), from the files that write_tokens wrote to `path` (a new one in the shared folder).

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers. An empty table gives an empty result; odd rows: see write_tokens.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end)
    return read_tokens(spark, path).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
