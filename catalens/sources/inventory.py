"""File listings and checksums of file contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.shipping import ship_by_value
from catalens.sources import store

ship_by_value(__name__)
c = F.col

# Bytes read at a time by :func:`checksum_stream`.
CHUNK_BYTES = 8 * 1024 * 1024


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below a folder: ``path, modificationTime, length, content``.

    ``content`` is only read if a later step uses it. The format passes over empty files;
    :func:`catalens.sources.store.list_files` has them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def file_sizes(files: DataFrame) -> DataFrame:
    return files.select("path", "length")


def read_listing(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """Rendition files below a folder: ``filepath, name``. The tasks list it, and names only."""
    listed = store.list_files(spark, root, ("path", "name"), levels)
    return listed.select(c("path").alias("filepath"), "name")


def checksum(content: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"Unknown checksum algorithm, {algorithm}")


def checksum_stream(paths: DataFrame, algorithms: list[str]) -> DataFrame:
    """Checksums of files too large for one cell (2 GiB): ``path`` plus a column each.

    Every task opens its own files and reads them in chunks; ``paths`` should be spread so
    that a partition holds a fair share of the bytes.
    """
    schema = "path string, " + ", ".join(f"{a} string" for a in algorithms)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                uri = path if "://" in path else "file://" + path.removeprefix("file:")
                filesystem, name = fs.FileSystem.from_uri(uri)
                sums = [hashlib.new(a) for a in algorithms]
                with filesystem.open_input_stream(name) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        for s in sums:
                            s.update(chunk)
                rows.append([path, *[s.hexdigest() for s in sums]])
            yield pd.DataFrame(rows, columns=["path", *algorithms])

    return paths.select("path").mapInPandas(digest, schema)
