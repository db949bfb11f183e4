"""What the operators share: where tables go, how lineage is cut, and Arrow columns as numpy arrays."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: The folder that tables go to while workspace() is open.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: that of workspace(), or spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    if _FOLDER.get():
        return _FOLDER.get()
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = sc.getCheckpointDir()
    # with its scheme, as the session's default store need not be that of a task
    path, store = _path(spark, named)
    return store.makeQualified(path).toString().rstrip("/")


def remove(spark: SparkSession, name: str) -> None:
    path, store = _path(spark, name)
    store.delete(path, True)


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """All tables that operators store meanwhile go to one folder, which goes at the end."""
    folder = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


class Scratch:
    """Parquet tables of one run of an operator: they cut lineage, are read back after a loss, and go when they are used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, computed once and written."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows as a Parquet table in the shared folder, which stays there (until a workspace() ends)."""
    return Scratch(df.sparkSession, name).keep(df, "rows")


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch where the session leaves Spark's default: texts are wide, and a batch is held on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sends Python tasks BATCH_ROWS rows at a time, unless the session has chosen a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and `more`): extra columns of a caller can't clash with an operator's own.

    Columns that have their type already stay as they are, so that a plan that reads them twice can share the shuffle.
    """
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    wanted = [docs[c] if kinds[c] == t else docs[c].cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    return docs.select(*wanted, *more)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets) of UTF-8; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches, column: str = "text", limit: int = 1_000_000):
    """Record batches cut into runs of rows of about `limit` bytes of text, so working memory follows the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = strings(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(at, at[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def integers(column: pa.Array, null: int = 0) -> np.ndarray:
    """An integer column as int64; a null becomes `null`."""
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, type=pa.binary())


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of equal bytes, no more planes than the largest needs: small by themselves and for compression."""
    values = values.astype(np.int64)
    width = 8 if len(values) and values.min() < 0 else max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(raw: np.ndarray) -> np.ndarray:
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view(np.int64).ravel()
