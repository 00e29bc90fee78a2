"""Metadata of files as they arrive.

:func:`metadata_stream` describes tags alone and keeps no state. :func:`records_stream` is the whole
record of a file: its size and checksums, its tags, and the secondary MIME type where they fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.operators import metadata as records
from catalens.sources import checksums, dumps, inventory

c = F.col


def stream_dumps(
    spark: SparkSession, root: str, files_per_batch: int = 1000, time: Column | None = None
) -> DataFrame:
    """New dump files (one dump per line) -> table of tags, with ``ts``.

    ``time`` is the event time of a line, by default when its file was written.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(root)
    ts = c("_metadata.file_modification_time") if time is None else time
    return dumps.exif_table(lines.select(c("value").alias("dump"), ts.alias("ts")), keep=("ts",))


def stream_feed(
    spark: SparkSession, root: str, files_per_batch: int = 1000, time: Column | None = None
) -> DataFrame:
    """New files of the secondary feed (CSV, a record per line) -> ``path, mimetype, ts``."""
    reader = spark.readStream.schema("path string, mimetype string").option("maxFilesPerTrigger", files_per_batch)
    ts = c("_metadata.file_modification_time") if time is None else time
    return reader.csv(root).select("path", dumps.clean_mime(c("mimetype")).alias("mimetype"), ts.alias("ts"))


def stream_files(spark: SparkSession, root: str, files_per_batch: int = 1000, sums: bool = True) -> DataFrame:
    """New media files -> ``path, length, ts`` and their checksums, read in pieces by the tasks.

    The format passes over empty files.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    path = F.regexp_replace("path", "^file:/+", "/")  # as dumps name it
    found = reader.option("maxFilesPerTrigger", files_per_batch).load(root).select(
        path.alias("path"), "length", c("modificationTime").alias("ts")
    )
    return checksums.with_checksums(found) if sums else found


def stream_checksums(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """New files -> ``path, length, sha1, md5``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    sums = [inventory.checksum(F.col("content"), a).alias(a) for a in ("sha1", "md5")]
    return files.select("path", "length", *sums)


def metadata_stream(tags: DataFrame, *keep: str) -> DataFrame:
    """Stream of tag rows -> stream of records."""
    return records.with_facts(tags).select(
        *keep, *records.record_columns(), records.record_error().alias("error")
    )


def records_stream(files: DataFrame, exif: DataFrame, feed: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Stream of whole records, as :func:`catalens.operators.metadata.metadata` gives for tables.

    ``files``: path, length, ts, and sha1, md5 and checksum_error where checksums are taken. ``exif``:
    :func:`stream_dumps`. ``feed``: path, mimetype, ts. Each has at most one row per path.

    Tags and secondary type of a file count if they are at most ``wait`` before or after it in event
    time. A record leaves as soon as all three are there, else once the watermark, ``wait`` behind the
    slowest of the streams, has passed: without tags it is the fallback record, without either it has
    an error. What comes later is dropped. State is what the last two waits brought.
    """
    def near(side: str) -> Column:
        span = F.expr(f"INTERVAL {wait}")
        same = c("path") == c(f"{side}_path")
        return same & (c(f"{side}_ts") >= c("ts") - span) & (c(f"{side}_ts") <= c("ts") + span)

    def timed(stream: DataFrame, side: str) -> DataFrame:
        named = stream.withColumnsRenamed({"path": f"{side}_path", "ts": f"{side}_ts"})
        return named.withWatermark(f"{side}_ts", wait)

    typed = feed.select("path", "ts", c("mimetype").alias("fallback_mimetype"))
    base = files.withColumnRenamed("length", "size").withWatermark("ts", wait)
    joined = base.join(timed(exif, "exif"), near("exif"), "left").join(timed(typed, "feed"), near("feed"), "left")
    sums = [s for s in ("sha1", "md5") if s in files.columns]
    unread = c("checksum_error") if "checksum_error" in files.columns else None
    return records.described(joined, "path", "size", "ts", *sums, unread=unread, raw="raw" in exif.columns)
