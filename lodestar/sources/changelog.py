"""Two Python data sources: an append-only log of catalogue changes, read and written as a stream, and shops' paged feeds.

The log is a folder: data files that tasks write, and a commit a batch that lists them with their row counts. Only committed
files exist for readers, and a batch that is committed already isn't committed again, so neither a lost task nor a restarted
query loses or repeats rows. A row's offset is its place among all committed ones. Files are reached through
pyarrow.fs, so the folder may be in any store that it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

LOG_SCHEMA = "value string, seq long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _names(store, folder: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _read(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def _publish(store, path: str, content: bytes) -> None:
    """The file appears whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, path)


@dataclass
class Segment(InputPartition):
    """Rows `skip` to `stop` of a file, of which the first in the file has offset `first`."""

    name: str
    first: int
    skip: int
    stop: int


def segments(path: str, start: int, stop: int | None = None) -> list[Segment]:
    """The committed files with rows at start <= offset < stop, in order."""
    store, folder = _store(path)
    at, found = 0, []
    for name in _names(store, f"{folder}/commits"):
        if not name.endswith(".json"):
            continue
        for file, n in json.loads(_read(store, f"{folder}/commits/{name}"))["files"]:
            own = Segment(file, at, max(0, start - at), n if stop is None else min(n, stop - at))
            if own.skip < own.stop:
                found.append(own)
            at += n
    return found


def _rows(path: str, part: Segment) -> Iterator[tuple]:
    store, folder = _store(path)
    lines = _read(store, f"{folder}/data/{part.name}").decode().split("\n")
    for k in range(part.skip, part.stop):
        yield json.loads(lines[k]), part.first + k


class _LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return segments(self.path, 0) or [Segment("", 0, 0, 0)]

    def read(self, partition):
        return _rows(self.path, partition) if partition.name else iter(())


class _LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        own = segments(self.path, 0)
        return {"at": own[-1].first + own[-1].stop if own else 0}

    def partitions(self, start: dict, end: dict):
        return segments(self.path, start["at"], end["at"]) or [Segment("", 0, 0, 0)]

    def read(self, partition):
        return _rows(self.path, partition) if partition.name else iter(())

    def commit(self, end: dict) -> None:
        """Rows stay in the log; nothing is to be done once they are used up."""


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _write(path: str, rows) -> _Written:
    """One data file of a task; nobody sees it before its commit."""
    lines = [json.dumps(r["value"]) for r in rows]
    if not lines:
        return _Written([])
    store, folder = _store(path)
    store.create_dir(f"{folder}/data", recursive=True)
    name = f"{uuid.uuid4().hex}.jsonl"
    _publish(store, f"{folder}/data/{name}", "\n".join(lines).encode())
    return _Written([(name, len(lines))])


def _commit(path: str, key: str, messages) -> None:
    """Adds the files of a batch at the end of the log, once for each key."""
    store, folder = _store(path)
    store.create_dir(f"{folder}/commits", recursive=True)
    done = _names(store, f"{folder}/commits")
    if any(n.endswith(f"-{key}.json") for n in done):
        _drop(path, messages)
        return
    files = [f for m in messages if m is not None for f in m.files]
    if files:
        place = 1 + max((int(n.split("-", 1)[0]) for n in done if n.endswith(".json")), default=-1)
        _publish(store, f"{folder}/commits/{place:012d}-{key}.json", json.dumps({"files": files}).encode())


def _drop(path: str, messages) -> None:
    store, folder = _store(path)
    for m in messages:
        for name, _ in m.files if m is not None else []:
            store.delete_file(f"{folder}/data/{name}")


class _LogWriter(DataSourceWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def write(self, rows):
        return _write(self.path, rows)

    def commit(self, messages) -> None:
        _commit(self.path, self.key, messages)

    def abort(self, messages) -> None:
        _drop(self.path, messages)


class _LogStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, producer: str):
        self.path, self.producer = path, producer

    def write(self, rows):
        return _write(self.path, rows)

    def commit(self, messages, batch: int) -> None:
        _commit(self.path, f"{self.producer}-{batch}", messages)

    def abort(self, messages, batch: int) -> None:
        _drop(self.path, messages)


class ChangeLog(DataSource):
    """format("changelog"), option path: rows (value, seq). Written are rows with a column value; option producer names a
    stream that writes, so that a batch of it is told again after a restart; a batch job may give a key of its own (option key)."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _LogStreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options["path"], self.options.get("key", uuid.uuid4().hex))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _LogStreamWriter(self.options["path"], self.options["producer"])


@dataclass
class Page(InputPartition):
    feed: str
    page: int
    path: str


class _FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, folder = _store(self.path)
        pages = []
        for feed in _names(store, folder):
            for name in _names(store, f"{folder}/{feed}"):
                if name.startswith("page-") and name.endswith(".json"):
                    pages.append(Page(feed, int(name[5:-5]), f"{folder}/{feed}/{name}"))
        return pages or [Page("", 0, "")]

    def read(self, partition):
        if not partition.path:
            return
        try:
            given = json.loads(_read(_store(self.path)[0], partition.path))
        except ValueError:
            given = None
        products = given.get("products") if isinstance(given, dict) else None
        own = [p for p in products if isinstance(p, dict)] if isinstance(products, list) else []
        for k, p in enumerate(own):
            yield partition.feed, partition.page, k, len(own), str(p.get("id")), json.dumps(p)
        if not own:
            yield partition.feed, partition.page, None, 0, None, None


class FeedPages(DataSource):
    """format("feedpages"), option path: a folder of feeds, each with pages page-N.json as a shop gave them. Each page is an input
    partition; rows (feed, page, place, n, id, product): the product as JSON, n those of its page. A page without products, or that can't be read, is a row of nulls with n = 0."""

    @classmethod
    def name(cls) -> str:
        return "feedpages"

    def schema(self) -> str:
        return "feed string, page int, place int, n int, id string, product string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeLog)
    spark.dataSource.register(FeedPages)
