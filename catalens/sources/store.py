"""Files of a store, listed and written by the tasks.

The listing is a data source whose partitions are folders. The driver learns of the folders that the
work is divided by, never of a file; only the columns asked for are found out, and a listing without
``length`` and ``modified`` asks the store for names alone where that is cheaper.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from catalens.shipping import ship_by_value

ship_by_value(__name__)

LISTING = "path string, name string, length bigint, modified timestamp"
_TYPES = {
    "path": pa.string(), "name": pa.string(), "length": pa.int64(), "modified": pa.timestamp("us", "UTC"),
}
# Folders that a listing may be divided by: their names pass through the driver.
MOST_FOLDERS = 100_000
_ROWS = 10_000


def resolve(path: str):
    """File system of a path, the path in it, and what to put before its paths."""
    from pyarrow import fs

    scheme, apart, _ = path.partition("://")
    if not apart or scheme == "file":
        local = path.removeprefix("file://").removeprefix("file:")
        return fs.LocalFileSystem(), local, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, f"{scheme}://"


def _entries(path: str, sizes: bool) -> Iterator[tuple[bool, str, int | None, object]]:
    """Whether it is a folder, path, size and time of all that a folder holds."""
    system, inner, before = resolve(path)
    if not before:
        with os.scandir(inner) as entries:
            for e in entries:
                if e.is_dir():
                    yield True, e.path, None, None
                elif sizes:
                    found = e.stat()
                    yield False, e.path, found.st_size, found.st_mtime_ns // 1000
                else:
                    yield False, e.path, None, None
        return
    from pyarrow import fs

    for e in system.get_file_info(fs.FileSelector(inner)):
        is_folder = e.type == fs.FileType.Directory
        time = None if e.mtime_ns is None else e.mtime_ns // 1000
        yield is_folder, before + e.path, None if is_folder else e.size, time


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        unknown = set(self.names) - set(_TYPES)
        if unknown:
            raise ValueError(f"A listing has no columns {sorted(unknown)}")
        self.folders = [tuple(f) for f in json.loads(options["folders"])]
        self.tasks = int(options.get("tasks", 200))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.tasks, len(self.folders)))
        return [_Folders(self.folders[k::n]) for k in range(n)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        sizes = bool({"length", "modified"} & set(self.names))
        rows: list[tuple] = []
        open_ = list(partition.folders)
        while open_:
            folder, deep = open_.pop()
            for is_folder, path, size, time in _entries(folder, sizes):
                if is_folder:
                    if deep:
                        open_.append((path, True))
                    continue
                rows.append((path, path.rsplit("/", 1)[-1], size, time))
                if len(rows) == _ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(_TYPES, zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], _TYPES[n]) for n in self.names], names=self.names)


class FileListing(DataSource):
    """``spark.read.format("file_listing")``; options ``folders`` (JSON) and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = [path for is_folder, path, *_ in _entries(folder, False) if is_folder]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])


def folders(spark: SparkSession, root: str, levels: int) -> list[tuple[str, bool]]:
    """Folders that hold all files below ``root``, and whether all below them counts as theirs.

    The tree is gone down ``levels`` levels by the tasks.
    """
    shallow, deep = [], [root]
    for _ in range(levels):
        level = spark.createDataFrame([(f,) for f in deep], "path string").repartition(min(len(deep), 200))
        below = [r["path"] for r in level.mapInArrow(_children, "path string").limit(MOST_FOLDERS + 1).collect()]
        if not below or len(below) > MOST_FOLDERS:
            break
        shallow, deep = shallow + deep, sorted(below)
    return [(f, False) for f in shallow] + [(f, True) for f in deep]


def list_files(
    spark: SparkSession, root: str, columns: tuple[str, ...] = ("path", "length"), levels: int = 1, tasks: int = 200
) -> DataFrame:
    """Files below a folder, with those of :data:`LISTING` that are asked for.

    The folders ``levels`` below the root divide the work: choose so that one task can list what is
    below each.
    """
    spark.dataSource.register(FileListing)
    types = dict(part.split() for part in LISTING.split(", "))
    wanted = ", ".join(f"{name} {types[name]}" for name in columns)
    reader = spark.read.format("file_listing").schema(wanted)
    return reader.options(folders=json.dumps(folders(spark, root, levels)), tasks=tasks).load()


def write_files(rows: DataFrame) -> int:
    """Write ``content`` to ``path`` for each row, and count the files.

    A file appears under its name once it is whole, so that a task that runs again does no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: set[str] = set()
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner, _ = resolve(path)
                folder = inner.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                part = f"{folder}/.{inner.rsplit('/', 1)[1]}.{os.getpid()}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, inner)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = rows.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    return written.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
