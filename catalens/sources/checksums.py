"""Checksums of files of any size: dealt to tasks by their bytes, read in pieces."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catalens.shipping import ship_by_value
from catalens.sources.store import resolve

ship_by_value(__name__)
c = F.col

# Bytes read at a time.
CHUNK_BYTES = 8 * 1024 * 1024
# Bytes that a task reads, but for files that are larger.
TASK_BYTES = 4 * 1024**3
# Rows of one size that are ranked in one group.
RANKED_ROWS = 100_000


def deal_by_size(files: DataFrame, bins: int, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Files with ``bin`` (0 to bins - 1): the longest first, dealt back and forth.

    Sizes are put into classes of a quarter of a power of two. A class follows the larger ones; within
    it files are ranked in groups of about ``ranked_rows``, so that no group grows with the table.
    """
    size = F.greatest(F.coalesce("length", F.lit(0)), F.lit(1))
    classed = files.withColumn("_class", F.floor(4 * F.log2(size)).cast("int"))
    # At most 252 classes.
    counts = classed.groupBy("_class").agg(F.count("*").alias("_n"))
    larger = Window.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(larger), F.lit(0)))
    groups = F.ceil(c("_n") / ranked_rows)
    placed = classed.join(F.broadcast(counts), "_class").withColumn("_group", F.pmod(F.xxhash64("path"), groups))
    in_group = Window.partitionBy("_class", "_group").orderBy(F.desc("length"), "path")
    index = c("_before") + (F.row_number().over(in_group) - 1) * groups + c("_group")
    turn = placed.withColumn("_turn", F.pmod(index, F.lit(2 * bins)))
    bin_ = F.least(c("_turn"), F.lit(2 * bins - 1) - c("_turn")).cast("int")
    return turn.select(*files.columns, bin_.alias("bin"))


def _digest(path: str | None, algorithms: tuple[str, ...], chunk: int) -> list[str | None]:
    """A sum per algorithm, then what went wrong."""
    if path is None:
        return [*[None] * len(algorithms), "No path"]
    sums = [hashlib.new(a) for a in algorithms]
    try:
        system, inner, _ = resolve(path)
        with system.open_input_stream(inner) as stream:
            while piece := stream.read(chunk):
                for s in sums:
                    s.update(piece)
    except OSError as error:
        return [*[None] * len(algorithms), f"{type(error).__name__}: {path}"]
    return [*[s.hexdigest() for s in sums], None]


def checksums(
    files: DataFrame,
    algorithms: tuple[str, ...] = ("sha1", "md5"),
    task_bytes: int = TASK_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``path``, a column per algorithm, and ``checksum_error``: one row per file.

    ``files``: path, length. Every task opens the files dealt to it and reads them once, ``chunk_bytes``
    at a time, for all algorithms; contents are in no row. A file that cannot be read has an error.
    """
    spark = files.sparkSession
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    least = min(n, spark.sparkContext.defaultParallelism)
    bins = max(1, least, math.ceil(total / task_bytes))
    dealt = deal_by_size(files.select("path", "length"), bins).repartitionById(bins, c("bin"))
    return with_checksums(dealt.select("path"), algorithms, chunk_bytes)


def with_checksums(
    files: DataFrame, algorithms: tuple[str, ...] = ("sha1", "md5"), chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Rows with a ``path`` first, a table or a stream, and the sums of each file where the row lies."""
    unknown = set(algorithms) - hashlib.algorithms_available
    if unknown:
        raise ValueError(f"Unknown checksum algorithm, {', '.join(sorted(unknown))}")
    sums = [(name, "string") for name in (*algorithms, "checksum_error")]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*files.dtypes, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                own = [pa.array([v], pa.string()) for v in _digest(path, algorithms, chunk_bytes)]
                columns = [*batch.slice(k, 1).columns, *own]
                names = [*batch.schema.names, *algorithms, "checksum_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, schema)
