"""A Spark data source of a project's files, hidden ones included: ``spark.read.format("project").option("path", uri).load()``.

Spark's own file sources leave out names that begin with an underscore or a dot, so ``__init__.py`` and ``.env`` too. Here folders
are listed one by one, excluded ones never opened. The driver looks at folders only until there are enough of them to deal out, then
tasks walk what lies below; a folder of very many files is shared among tasks by a hash of their names. So the driver holds no list of
files. File systems are those of pyarrow: local paths, HDFS and object stores.

Options: path (with or without scheme), pattern (of names; '*'), excluded (names of folders, comma-separated), content ('false' leaves
files closed: path, size and time only), tasks (about how many partitions).
"""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that hold no files of a project.
NO_SOURCES = (".git",)
SCHEMA = "path string, size long, modified long, content string"
#: Files that one task of a folder takes, and the bytes of a batch.
FILES, BATCH = 2_000, 8 << 20
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("content", pa.string())])


@dataclass
class Folder(InputPartition):
    """Files of a folder, with those below it if deep; only those of hash part by parts."""

    path: str
    deep: bool
    part: int = 0
    parts: int = 1


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it; ValueError where pyarrow has none for the scheme."""
    try:
        if "://" in uri or uri.startswith("file:"):
            return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
        return fs.LocalFileSystem(), os.path.abspath(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as wrong:
        raise ValueError(f"no file system for {uri}: {wrong}") from None


def text_of(system: fs.FileSystem, path: str) -> str | None:
    """A file's text, bytes that are no UTF-8 replaced; None if it is gone or can't be read."""
    try:
        with system.open_input_stream(path) as file:
            return file.read().decode("utf-8", "replace")
    except OSError:
        return None


class Listing:
    """Folders of a file system, one at a time; links to local folders aren't followed, as they may lead back."""

    def __init__(self, system: fs.FileSystem, excluded: tuple[str, ...]) -> None:
        self.system, self.excluded = system, excluded
        self.local = isinstance(system, fs.LocalFileSystem)

    def of(self, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """(folders, files) in a folder, sorted by name."""
        found = sorted(self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.base_name)
        folders = [x.path for x in found if x.type == fs.FileType.Directory and x.base_name not in self.excluded and not (self.local and os.path.islink(x.path))]
        return folders, [x for x in found if x.type == fs.FileType.File]


class ProjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.pattern = options.get("pattern", "*")
        self.excluded = tuple(filter(None, options.get("excluded", ",".join(NO_SOURCES)).split(",")))
        self.content = options.get("content", "true").lower() == "true"
        self.tasks = int(options.get("tasks", 64))
        opened(self.uri)  # fails here rather than in a task

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.uri)
        listing = Listing(system, self.excluded)
        if system.get_file_info(base).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        whole, waiting = [], [base]
        while waiting and len(whole) + len(waiting) < self.tasks:
            folder = waiting.pop(0)
            folders, files = listing.of(folder)
            n = -(-len(files) // FILES)
            whole += [Folder(folder, False, k, n) for k in range(n)]
            waiting += folders
        return [*whole, *(Folder(folder, True) for folder in waiting)] or [Folder(base, False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = opened(self.uri)
        listing = Listing(system, self.excluded)
        rows: list[tuple] = []
        held, todo = 0, [partition.path]
        while todo:
            folders, files = listing.of(todo.pop())
            todo += folders[::-1] if partition.deep else []
            for file in files:
                if not fnmatch.fnmatchcase(file.base_name, self.pattern) or zlib.crc32(file.base_name.encode()) % partition.parts != partition.part:
                    continue
                text = text_of(system, file.path) if self.content else ""
                if text is None:
                    continue
                rows.append((file.path[len(base.rstrip("/")) + 1 :], file.size, file.mtime_ns, text if self.content else None))
                held += len(text)
                if held >= BATCH or len(rows) >= FILES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader(dict(self.options))
