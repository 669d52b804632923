"""Files and archives as sinks that commit: what a task has written is there whole, once, or not at all.

Each attempt of a task writes under a folder of its own, whose name begins with an
underscore, so that readers pass over it.  When all tasks are done the driver gives
one folder a task its final name (a rename each, whatever the number of files in
it), deletes what failed or doubled attempts left, and writes ``_SUCCESS`` last.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from brakta.sources.files import qualified, store

ATTEMPT, DONE = "_attempt-", "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written."""

    part: int
    folder: str
    files: int = 0
    bytes: int = 0


@dataclass
class Sink(DataSourceArrowWriter):
    """Rows as files under ``root``, each task's in a folder of its own; ``job`` tells one save from another."""

    root: str
    zipped: bool
    overwrite: bool
    job: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        out = Written(context.partitionId() if context else 0, f"{ATTEMPT}{self.job}-{uuid.uuid4().hex}")
        where, root = store(self.root)
        folder = f"{root}/{out.folder}"
        where.create_dir(folder, recursive=True)
        (self._archives if self.zipped else self._files)(where, folder, iterator, out)
        return out

    def _files(self, where: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch], out: Written) -> None:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name is not None:
                    self._put(where, f"{folder}/{safe(name)}", content, out)

    def _archives(self, where: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch], out: Written) -> None:
        """Rows of an archive stand together: each is closed when the next begins, so one is open at a time."""
        name, archive, stream = None, None, None
        for batch in batches:
            for own, entry, content in zip(*(batch.column(c).to_pylist() for c in ("name", "entry", "content")), strict=True):
                if own is None:
                    continue
                if archive is None or own != name:
                    if archive is not None:
                        archive.close()
                        stream.close()
                    name, stream = own, where.open_output_stream(f"{folder}/{safe(own)}")
                    archive = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_DEFLATED)
                    out.files += 1
                data = encoded(content)
                archive.writestr(zipfile.ZipInfo(entry), data, zipfile.ZIP_DEFLATED)
                out.bytes += len(data)
        if archive is not None:
            archive.close()
            stream.close()

    def _put(self, where: fs.FileSystem, path: str, content: object, out: Written) -> None:
        data = encoded(content)
        with where.open_output_stream(path) as f:
            f.write(data)
        out.files += 1
        out.bytes += len(data)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = store(self.root)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for found in _children(where, root):
                if not found.base_name.startswith(f"{ATTEMPT}{self.job}-"):
                    (where.delete_dir if found.type == fs.FileType.Directory else where.delete_file)(found.path)
        for m in done:
            where.move(f"{root}/{m.folder}", f"{root}/part-{m.part:05d}-{self.job}")
        self._clean(where, root)
        with where.open_output_stream(f"{root}/{DONE}") as f:
            f.write(json.dumps({"job": self.job, "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = store(self.root)
        self._clean(where, root)

    def _clean(self, where: fs.FileSystem, root: str) -> None:
        for found in _children(where, root):
            if found.base_name.startswith(f"{ATTEMPT}{self.job}-"):
                where.delete_dir(found.path)


def _children(where: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    return where.get_file_info(fs.FileSelector(root, allow_not_found=True))


class _Forward:
    """A stream that is written in order and never sought."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def safe(name: str) -> str:
    """A name that stays in its folder and that readers do not pass over."""
    plain = name.replace("/", "_").replace("\\", "_").replace("\0", "_")
    return f"-{plain}" if plain[:1] in ("", "_", ".") else plain


def encoded(content: object) -> bytes:
    """Text as UTF-8; null as nothing."""
    return b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)


class FileSink(DataSource):
    """``df.write.format("brakta_files").mode(...).option("archives", "true").save(path)``.

    Rows (name, content) are files; with ``archives`` rows (name, entry, content) are entries of ZIP files, and the
    rows of an archive must stand together in one partition (see ``archives``).  Content is text or binary.
    """

    @classmethod
    def name(cls) -> str:
        return "brakta_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Sink:
        zipped = self.options.get("archives", "false").lower() == "true"
        missing = {"name", "content", *(("entry",) if zipped else ())} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return Sink(self.options["path"], zipped, overwrite)


def save_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (name, content) as files; of one name in a task the last stays.  A row without a name is no file."""
    _save(rows.select("name", "content"), path, mode, "false")


def save_archives(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (name, place, entry, content) as a ZIP file for each name, entries in order of ``place``.

    An archive is written by one task as its rows come, so it may be of any size.
    """
    _save(rows.repartition("name").sortWithinPartitions("name", "place", "entry").select("name", "entry", "content"), path, mode, "true")


def _save(rows: DataFrame, path: str, mode: str, archives: str) -> None:
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.write.format("brakta_files").mode(mode).option("archives", archives).option("path", qualified(spark, path)).save()
