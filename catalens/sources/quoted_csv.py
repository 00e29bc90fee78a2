"""CSV files whose values may hold line breaks, read by many tasks.

A file is cut into byte ranges. One pass counts the quotes of each range; whether the number of quotes
before a range is odd tells if it begins within quotes, because a quote within a value is written twice.
The second pass cuts each range into records: a record belongs to the range its first byte is in.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalens.shipping import ship_by_value
from catalens.sources.store import list_files, resolve

ship_by_value(__name__)
c = F.col

RANGE_BYTES = 64 * 1024**2
_READ = 1024**2


def _pieces(path: str, start: int, end: int | None) -> Iterator[bytes]:
    """Bytes of a file from ``start`` to ``end`` or to where it ends."""
    system, inner, _ = resolve(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        while end is None or start < end:
            piece = file.read(_READ if end is None else min(_READ, end - start))
            if not piece:
                return
            start += len(piece)
            yield piece


def record_bounds(pieces: Iterator[bytes], start: int, end: int, inside: bool, first: bool) -> Iterator[bytes]:
    """The records that begin at ``start`` or later and before ``end``, as bytes with their line ends.

    ``pieces``: bytes from ``start`` on. ``inside``: whether ``start`` lies within quotes. ``first``: whether
    a record begins at ``start``.
    """
    held = b""
    taking, at = first, start
    for piece in pieces:
        low = begin = 0
        while low < len(piece):
            if inside:
                high = piece.find(b'"', low)
                if high < 0:
                    break
                inside, low = False, high + 1
                continue
            line = piece.find(b"\n", low)
            quote = piece.find(b'"', low, line if line >= 0 else len(piece))
            if quote >= 0:
                inside, low = True, quote + 1
                continue
            if line < 0:
                break
            # A record ends here, the next begins behind.
            if taking:
                yield held + piece[begin : line + 1]
            held, taking = b"", True
            low = begin = line + 1
            if at + begin >= end:
                return
        if taking:
            held += piece[begin:]
        at += len(piece)
    if taking and held:
        yield held


def _parsed(data: bytes, names: list[str]) -> pa.RecordBatch:
    """Records as text columns: an empty value is null unless quoted, a missing one null."""
    from pyarrow import csv as arrow_csv

    odd: list[str] = []

    def keep(row) -> str:
        odd.append(row.text)
        return "skip"

    table = arrow_csv.read_csv(
        io.BytesIO(data),
        read_options=arrow_csv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(data) + 1, 1024)),
        parse_options=arrow_csv.ParseOptions(newlines_in_values=True, invalid_row_handler=keep),
        convert_options=arrow_csv.ConvertOptions(
            column_types={n: pa.string() for n in names}, strings_can_be_null=True,
            quoted_strings_can_be_null=False, null_values=[""],
        ),
    )
    columns = [column.to_pylist() for column in table.columns]
    for text in odd:  # too few or too many values
        row = [v or None for v in next(csv.reader([text]))]
        for column, value in zip(columns, (row + [None] * len(names))[: len(names)]):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in columns], names=names)


def read_quoted(spark: SparkSession, root: str, names: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all files below a folder, or of one file, as text columns.

    UTF-8 with ``\\n`` or ``\\r\\n`` between records, quotes within a value doubled, no heading. Files whose
    name begins with a dot or an underscore are passed over. No task reads more of a file than its range
    and the rest of the last record.
    """
    system, inner, _ = resolve(root)
    found = system.get_file_info(inner)
    if found.is_file:
        files = spark.createDataFrame([(root, found.size)], "path string, length bigint")
    else:
        files = list_files(spark, root, ("path", "name", "length")).where("NOT (name LIKE '\\\\_%' OR name LIKE '.%')")
    step = F.lit(range_bytes)
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0), c("length") - 1, step)).alias("start")
    ).select("path", "start", F.least(c("start") + step, c("length")).alias("end"))
    # As many tasks as ranges, up to a bound: a range is far more work than its row.
    tasks = spark.sparkContext.defaultParallelism * 4
    ranges = ranges.repartition(tasks, "path", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(column.to_pylist() for column in batch.columns)):
                n = sum(piece.count(b'"') for piece in _pieces(path, start, end))
                values = [[path], [start], [end], [n]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["path", "start", "end", "quotes"])

    counted = ranges.mapInArrow(count, "path string, start bigint, end bigint, quotes bigint")
    # A row per range: the ranges of one file are few enough for one group.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    cut = counted.select("path", "start", "end", inside.alias("inside")).repartition(tasks, "path", "start")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, within in zip(*(column.to_pylist() for column in batch.columns)):
                first = start == 0
                if start and not within:  # does a record begin just here?
                    first = b"".join(_pieces(path, start - 1, start)) == b"\n"
                held, size = [], 0
                for record in record_bounds(_pieces(path, start, None), start, end, within, first):
                    held.append(record)
                    size += len(record)
                    if size > 4 * _READ:
                        yield _parsed(b"".join(held), names)
                        held, size = [], 0
                if held:
                    yield _parsed(b"".join(held), names)

    return cut.mapInArrow(parse, ", ".join(f"`{n}` string" for n in names))
