"""Listing, writing and checksums of files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from catalens.operators import metadata
from catalens.sources import checksums, store

MANY = 3 * 1024**3


def test_listing(spark, tmp_path):
    sizes = {}
    for n in range(60):
        folder = tmp_path / f"d{n % 5}" / ("deep/er" if n % 3 == 0 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{n}").write_bytes(b"x" * n)
        sizes[str(folder / f"f{n}")] = n
    (tmp_path / "top").write_bytes(b"abc")
    (tmp_path / "empty").mkdir()
    sizes[str(tmp_path / "top")] = 3
    for levels in (0, 1, 2, 9):
        for root in (str(tmp_path), f"file://{tmp_path}"):
            rows = store.list_files(spark, root, levels=levels, tasks=4).collect()
            assert {r.path: r.length for r in rows} == sizes and len(rows) == len(sizes), levels
    listed = store.list_files(spark, str(tmp_path), ("name", "modified"))
    assert listed.columns == ["name", "modified"]
    assert {r.name for r in listed.collect()} == {p.split("/")[-1] for p in sizes}
    assert listed.where("modified > '2020-01-01'").count() == len(sizes)
    # Folders are divided among the tasks.
    assert store.list_files(spark, str(tmp_path), tasks=4).rdd.getNumPartitions() == 4


def test_listing_reads_no_sizes_unless_asked(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"x")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    # The size of a link without target cannot be found out; its name can.
    assert {p.split("/")[-1] for _, p, *_ in store._entries(str(tmp_path), False)} == {"f", "dangling"}
    with pytest.raises(FileNotFoundError):
        list(store._entries(str(tmp_path), True))


def test_unknown_columns_and_empty_folders(spark, tmp_path):
    with pytest.raises(KeyError):
        store.list_files(spark, str(tmp_path), ("path", "owner"))
    assert store.list_files(spark, str(tmp_path)).count() == 0


def test_written_files(spark, tmp_path):
    rows = [(f"{tmp_path}/a{i % 3}/é{i}", bytes([i]) * i) for i in range(20)] + [(f"{tmp_path}/b/none", None)]
    table = spark.createDataFrame(rows, "path string, content binary")
    for _ in range(2):  # a repeated write changes nothing
        assert store.write_files(table) == 21
    listed = {r.path: r.length for r in store.list_files(spark, str(tmp_path)).collect()}
    assert listed == {p: len(b or b"") for p, b in rows}


def test_files_dealt_by_size(spark):
    rows = [(f"small{i}", 10 + i % 7) for i in range(4000)] + [(f"big{i}", 10**9 + i) for i in range(40)]
    rows += [("zero", 0), ("none", None), (None, 5)]
    files = spark.createDataFrame(rows, "path string, length bigint")
    for ranked in (100, 100_000):
        dealt = checksums.deal_by_size(files, 20, ranked).groupBy("bin").agg(
            F.sum("length").alias("bytes"), F.count("*").alias("n")
        )
        bins = dealt.collect()
        assert sum(r.n for r in bins) == len(rows) and {r.bin for r in bins} == set(range(20))
        assert max(r.bytes for r in bins) <= (2 if ranked > 100 else 3) * 10**9 + 10**7
        assert max(r.n for r in bins) < 1.5 * len(rows) / 20


def test_checksums_in_pieces(spark, tmp_path):
    body = {str(tmp_path / f"f{n}"): os.urandom(n * 777) for n in range(30)}
    for path, content in body.items():
        with open(path, "wb") as out:
            out.write(content)
    rows = [(p, len(b)) for p, b in body.items()] + [(str(tmp_path / "gone"), 9), (None, None)]
    files = spark.createDataFrame(rows, "path string, length bigint")
    got = {r.path: r for r in checksums.checksums(files, ("sha1", "md5", "sha256"), 50_000, 1000).collect()}
    assert len(got) == len(rows)
    for path, content in body.items():
        assert got[path].sha1 == hashlib.sha1(content).hexdigest()
        assert got[path].md5 == hashlib.md5(content).hexdigest()
        assert got[path].sha256 == hashlib.sha256(content).hexdigest()
        assert got[path].checksum_error is None
    assert got[str(tmp_path / "gone")].sha1 is None and "gone" in got[str(tmp_path / "gone")].checksum_error
    assert got[None].md5 is None
    with pytest.raises(ValueError):
        checksums.checksums(files, ("sha0",))


def test_metadata_of_a_file_beyond_a_cell(spark, tmp_path):
    """A sparse file of 3 GiB: no cell could hold it."""
    path = str(tmp_path / "film.mp4")
    with open(path, "wb") as out:
        out.truncate(MANY)
    (tmp_path / "b.jpg").write_bytes(b"bb")
    files = store.list_files(spark, str(tmp_path))
    gone = spark.createDataFrame([(str(tmp_path / "gone.jpg"), 4)], "path string, length bigint")
    files = files.unionByName(gone)
    exif = spark.createDataFrame(
        [(path, True, "video/mp4", "film.mp4")], "path string, exif_ok boolean, MIMEType string, FileName string"
    )
    from catalens.sources.dumps import TAGS

    types = {"text": "string", "id": "string", "exact": "double"}
    for tag, kind in TAGS.items():
        if tag not in exif.columns:
            exif = exif.withColumn(tag, F.lit(None).cast(types.get(kind, kind)))
    feed = spark.createDataFrame(
        [(str(tmp_path / n), "image/jpeg") for n in ("b.jpg", "gone.jpg")], "path string, mimetype string"
    )
    got = {r.path.split("/")[-1]: r for r in metadata.metadata(files, exif, feed).collect()}
    sha1, md5, zeros = hashlib.sha1(), hashlib.md5(), bytes(1 << 24)
    for _ in range(MANY >> 24):
        sha1.update(zeros)
        md5.update(zeros)
    film = got["film.mp4"]
    assert (film.size, film.sha1, film.md5, film.error) == (MANY, sha1.hexdigest(), md5.hexdigest(), None)
    assert film.type == "video"
    assert (got["b.jpg"].md5, got["b.jpg"].name) == (hashlib.md5(b"bb").hexdigest(), "unknown_filename")
    assert got["gone.jpg"].sha1 is None and "gone.jpg" in got["gone.jpg"].error
    plain = metadata.metadata(files, exif, feed, checksums=False)
    assert "sha1" not in plain.columns and plain.count() == 3
