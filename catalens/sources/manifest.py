"""The manifest: one row per stored rendition, in files by media type and bucket of the path.

A batch of rows becomes visible as a whole, by one small file below ``_batches`` that names its data
files; files that no batch names (of failed tasks, of a repeated append) are never read. A batch is
known by its id: appending it again changes nothing. Rows whose path is stored already are left out, so
the manifest holds every path once and readers need not look for repeats. Appends of different batches
must not run at the same time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from catalens.functions import keys
from catalens.shipping import ship_by_value
from catalens.sources.store import resolve

ship_by_value(__name__)

MANIFEST_SCHEMA = (
    "id string, name string, filepath string, width int, height int, angle int, "
    "mirror boolean, error string, type string"
)
# Parts that paths are dealt to by hash. A fixed value: files are found by it.
BUCKETS = 32
# Files below this size are put together by :func:`compact`.
SMALL_BYTES = 64 * 1024**2
_FOLDERS = ("type", "bucket")
_NO_TYPE = "__HIVE_DEFAULT_PARTITION__"
_BATCHES = "_batches"


def manifest_rows(listing: DataFrame) -> DataFrame:
    """Listing ``filepath, name`` -> manifest rows; a name that is no key has an ``error``."""
    parsed = listing.withColumn("_k", keys.parse_key(F.col("name")))
    return parsed.select(
        keys.id_of_key(F.col("name")).alias("id"),
        "name",
        "filepath",
        *[F.col(f"_k.{c}").alias(c) for c in ("width", "height", "angle", "mirror", "error", "type")],
    )


def bucket_of(filepath: str | Column) -> Column:
    """Bucket of a path."""
    return F.pmod(F.xxhash64(filepath), F.lit(BUCKETS)).cast("int")


class _Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Tasks write Parquet files; the commit names them, or drops them if the batch is known."""

    def __init__(self, options: dict):
        self.root, self.batch = options["path"].rstrip("/"), options["batch"]
        self.removed = json.loads(options.get("removed", "[]"))
        self.rows = int(options.get("file_rows", 1_000_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow.compute as pc

        waiting: dict[tuple, list[pa.Table]] = {}
        files: list[dict] = []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for part in table.group_by(list(_FOLDERS)).aggregate([]).to_pylist():
                mine = None
                for name in _FOLDERS:
                    column = table[name]
                    same = pc.is_null(column) if part[name] is None else pc.equal(column, part[name])
                    same = pc.fill_null(same, False)
                    mine = same if mine is None else pc.and_(mine, same)
                key = tuple(part[name] for name in _FOLDERS)
                waiting.setdefault(key, []).append(table.filter(mine).drop_columns(list(_FOLDERS)))
                if sum(len(t) for t in waiting[key]) >= self.rows:
                    files.append(self._file(key, waiting.pop(key)))
        files += [self._file(key, tables) for key, tables in waiting.items()]
        return _Written(files)

    def _file(self, key: tuple, tables: list[pa.Table]) -> dict:
        from pyarrow import parquet

        type_, bucket = key
        folder = f"type={_NO_TYPE if type_ is None else type_}/bucket={bucket}"
        name = f"{folder}/{uuid.uuid4().hex}.parquet"
        system, inner, _ = resolve(f"{self.root}/{name}")
        system.create_dir(inner.rsplit("/", 1)[0])
        table = pa.concat_tables(tables).sort_by("filepath")
        parquet.write_table(table, inner, filesystem=system)
        return {"file": name, "rows": len(table), "bytes": system.get_file_info(inner).size}

    def commit(self, messages: list[_Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        system, inner, _ = resolve(f"{self.root}/{_BATCHES}/{self.batch}.json")
        system.create_dir(inner.rsplit("/", 1)[0])
        if _exists(system, inner):
            self._drop(files)
            return
        part = f"{inner}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(json.dumps({"batch": self.batch, "added": files, "removed": self.removed}).encode())
        system.move(part, inner)

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])

    def _drop(self, files: list[dict]) -> None:
        for f in files:
            system, inner, _ = resolve(f"{self.root}/{f['file']}")
            system.delete_file(inner)


def _exists(system, inner: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(inner).type != fs.FileType.NotFound


class ManifestSink(DataSource):
    """``df.write.format("rendition_manifest")`` with options ``path`` and ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "rendition_manifest"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def _safe(batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"A batch id is made of letters, digits, dots, dashes and underscores, not {batch}")
    return batch


def is_committed(path: str, batch: str) -> bool:
    return _exists(*resolve(f"{path.rstrip('/')}/{_BATCHES}/{_safe(batch)}.json")[:2])


def committed_files(path: str) -> list[dict]:
    """Data files of the manifest (file, rows, bytes). The driver reads one small file per batch."""
    from pyarrow import fs

    system, inner, _ = resolve(f"{path.rstrip('/')}/{_BATCHES}")
    added: dict[str, dict] = {}
    removed: set[str] = set()
    for entry in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if entry.path.endswith(".json"):
            with system.open_input_stream(entry.path) as stream:
                batch = json.loads(stream.read())
            added |= {f["file"]: f for f in batch["added"]}
            removed |= set(batch["removed"])
    return [f for name, f in sorted(added.items()) if name not in removed]


def _append(rows: DataFrame, path: str, batch: str, removed: list[str]) -> None:
    rows.sparkSession.dataSource.register(ManifestSink)
    placed = rows.withColumn("bucket", bucket_of("filepath"))
    writer = placed.hint("rebalance", *_FOLDERS).write.format("rendition_manifest").mode("append")
    writer.options(batch=batch, removed=json.dumps(removed)).save(path)


def write_manifest(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append the rows whose path is not stored yet, as one batch.

    With the id of a batch that is there already, nothing happens. The rebalance hint gives each folder
    files of an even size and splits one that holds most rows, so no task writes a whole type and no
    task writes a crumb of each.
    """
    batch = _safe(batch or uuid.uuid4().hex)
    if is_committed(path, batch):
        return
    new = rows.select(*_columns()).dropDuplicates(["filepath"])
    if committed_files(path):
        stored = read_manifest(rows.sparkSession, path).select("filepath")
        new = new.join(stored, "filepath", "left_anti")
    _append(new, path, batch, [])


def compact(spark: SparkSession, path: str, batch: str, small_bytes: int = SMALL_BYTES) -> int:
    """Put the small files of each folder together, as one batch; the number of files replaced."""
    if is_committed(path, _safe(batch)):
        return 0
    by_folder: dict[str, list[str]] = {}
    for f in committed_files(path):
        if f["bytes"] < small_bytes:
            by_folder.setdefault(f["file"].rsplit("/", 1)[0], []).append(f["file"])
    replaced = [name for names in by_folder.values() if len(names) > 1 for name in names]
    if replaced:
        _append(_read(spark, path, replaced).select(*_columns()), path, batch, replaced)
    return len(replaced)


def _columns() -> list[str]:
    return [c.strip().split(" ")[0] for c in MANIFEST_SCHEMA.split(",")]


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = f"{MANIFEST_SCHEMA}, bucket int"
    if not files:
        return spark.createDataFrame([], schema)
    root = path.rstrip("/")
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{f}" for f in files])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows, and the ``bucket`` of each; every path is there once.

    A filter on ``type`` or ``bucket`` prunes folders, one on ``id`` reaches the scan.
    """
    return _read(spark, path, [f["file"] for f in committed_files(path)])


def in_buckets_of(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored rows in the buckets of the paths asked for: other files are not opened.

    The driver reads the numbers of the buckets, :data:`BUCKETS` at most.
    """
    buckets = [r[0] for r in asked.where("filepath IS NOT NULL").select(bucket_of("filepath")).distinct().collect()]
    return stored.where(F.col("bucket").isin(buckets))
