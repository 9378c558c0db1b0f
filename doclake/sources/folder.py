"""Folders of files, listed and read on the executors.

``FolderSource`` is a Python data source: each of its partitions lists the folder for itself and takes the
names that a hash deals to it, so neither the driver nor any task holds the whole listing. It sees every
regular file, also those whose names begin with ``_`` or ``.``, which Spark's own readers pass over. Bytes are
read by a second step, after whatever filters there are on name and length.
"""

from __future__ import annotations

import hashlib
import io
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTED = "file_name string, path string, length long, modificationTime timestamp"
_LISTED = pa.schema(
    [("file_name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))]
)
_LISTED_BATCH = 10_000
#: Bytes of content in an Arrow batch that is sent on; a larger file makes a batch of its own.
BATCH_BYTES = 64 << 20


def _local(uri: str) -> str | None:
    """The path of a local or mounted file; None if ``uri`` names another store."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def entries(folder: str) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(name, path, length, modification time in microseconds) of the regular files of a folder, not of its
    subfolders. Local files come without length and time, which cost a look at each."""
    local = _local(folder)
    if local is not None:
        with os.scandir(local) as found:
            for entry in found:
                if entry.is_file():
                    yield entry.name, entry.path, None, None
        return
    from pyarrow import fs

    store, inside = _store(folder)
    base = folder.rstrip("/")
    for info in store.get_file_info(fs.FileSelector(inside, recursive=False)):
        if info.type == fs.FileType.File:
            time = int(info.mtime_ns // 1000) if info.mtime_ns is not None else None
            yield info.base_name, f"{base}/{info.base_name}", info.size, time


def open_bytes(path: str):
    """A seekable reader of a listed file."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    store, inside = _store(path)
    return io.BufferedReader(store.open_input_file(inside))


class _Part(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(i) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from self.listed(partition.number)

    def listed(self, number: int, start: int | None = None, end: int = 0) -> Iterator[pa.RecordBatch]:
        """The files that a hash deals to part ``number``, only those changed after ``start`` and until ``end`` if
        given. A local file that is moved into the folder counts as changed then."""
        rows: list[tuple] = []
        for name, path, length, modified in entries(self.path):
            if zlib.crc32(os.fsencode(name)) % self.parts != number:
                continue
            changed = modified
            if length is None:
                try:
                    found = os.stat(path)
                except FileNotFoundError:
                    continue  # gone since it was listed
                length, modified = found.st_size, found.st_mtime_ns // 1000
                changed = max(modified, found.st_ctime_ns // 1000)
            if start is not None and not start < (changed or 0) <= end:
                continue
            rows.append((name, path, length, modified))
            if len(rows) == _LISTED_BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()).cast(f.type) if f.name == "modificationTime" else pa.array(c, f.type) for c, f in zip(columns, _LISTED)],
            schema=_LISTED,
        )


class _TimedPart(_Part):
    """A share of the files that changed after ``start`` and until ``end``, in microseconds."""

    def __init__(self, number: int, start: int, end: int) -> None:
        super().__init__(number)
        self.start, self.end = start, end


class FolderStream(DataSourceStreamReader):
    """Files as they change: a batch is an interval of time, and each task lists its share of what changed in it.

    Nothing is remembered but the time, so a batch that is run again lists the same interval. The newest moments
    are left to the next batch, since files of the same time may still appear.
    """

    LAG = 1_000_000

    def __init__(self, options: dict) -> None:
        self.reader = FolderReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() // 1000 - self.LAG}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_TimedPart(i, start["until"], end["until"]) for i in range(self.reader.parts)]

    def read(self, partition: _TimedPart) -> Iterator[pa.RecordBatch]:
        yield from self.reader.listed(partition.number, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """``spark.read.format("folder").option("partitions", n).load(folder)`` after registration, and ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self.options)


def list_folder(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """Every regular file of one folder, not of its subfolders: file_name, path, length, modificationTime.

    ``folder``: a path that all executors can reach, or the URI of a store that Arrow opens. Listing is
    repeated by each of the ``partitions``, by default one per core.
    """
    spark.dataSource.register(FolderSource)
    parts = partitions or spark.sparkContext.defaultParallelism
    return spark.read.format("folder").option("partitions", parts).load(folder)


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's ``content`` under its ``file_name`` and return how many there were. A file appears whole or
    not at all, and a task that is run again writes the same."""
    local = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                if local is None:
                    store, inside = _store(f"{folder.rstrip('/')}/{name}")
                    with store.open_output_stream(inside) as file:
                        file.write(data)
                else:
                    draft = os.path.join(local, ".drafts", uuid.uuid4().hex)
                    os.makedirs(os.path.dirname(draft), exist_ok=True)
                    with open(draft, "wb") as file:
                        file.write(data)
                    os.replace(draft, os.path.join(local, name))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    written = files.select("file_name", "content").mapInArrow(run, "n long")
    return written.groupBy().sum("n").first()[0] or 0


def read_files(files: DataFrame, whole: int | None = None, head: int = 4096, always: tuple[bytes, ...] = ()) -> DataFrame:
    """``files`` with ``content``, the bytes at ``path``, and ``cut``, whether these are the first only.

    With ``whole``, only the first ``head`` bytes of longer files are read, unless they begin with one of
    ``always``. A file that is gone has null content. Batches are bounded by bytes.
    """

    def content(path: str, length: int) -> tuple[bytes | None, bool]:
        try:
            with open_bytes(path) as file:
                if whole is None or length <= whole:
                    return file.read(), False
                begin = file.read(head)
                if begin.startswith(always or (b"\0never",)):
                    return begin + file.read(), False
                return begin, True
        except FileNotFoundError:
            return None, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, size = 0, [], 0
            paths, lengths = batch.column("path").to_pylist(), batch.column("length").to_pylist()
            for at, (path, length) in enumerate(zip(paths, lengths)):
                held.append(content(path, length))
                size += len(held[-1][0] or b"")
                if size >= BATCH_BYTES or at == batch.num_rows - 1:
                    some = batch.slice(begin, len(held))
                    columns = [pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*batch.schema.names, "content", "cut"])
                    begin, held, size = at + 1, [], 0

    fields = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return files.mapInArrow(run, f"{fields}, content binary, cut boolean")


def with_checksum(files: DataFrame) -> DataFrame:
    """Listed files with the SHA-256 of their bytes, read in blocks; a file that is gone is left out."""

    def digest(path: str) -> str | None:
        found = hashlib.sha256()
        try:
            with open_bytes(path) as file:
                while block := file.read(1 << 22):
                    found.update(block)
        except FileNotFoundError:
            return None
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([digest(path) for path in batch.column("path").to_pylist()], pa.string())
            found = pa.RecordBatch.from_arrays([*batch.columns, sums], names=[*batch.schema.names, "checksum"])
            yield found.filter(sums.is_valid())

    fields = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return files.mapInArrow(run, f"{fields}, checksum string")
