"""Whole records on streams: fallback, size and checksums against the table form; late arrivals."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from catalens.operators import metadata
from catalens.sources import dumps
from catalens.streaming import metadata_stream, request_stream

NOON = 1_700_000_000
KEPT = ["path", "size", "sha1", "md5", "name", "type", "mimetype", "error"]


def put(path, content, hour):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (NOON + 3600 * hour, NOON + 3600 * hour))


def dump(path, **tags):
    return json.dumps([{"SourceFile": path, **tags}])


def test_records_of_arriving_files(spark, tmp_path):
    media, tags, types = tmp_path / "media", tmp_path / "tags", tmp_path / "types"
    body = {n: os.urandom(50 + 7 * k) for k, n in enumerate(["ok", "bad", "none", "late", "nothing", "after"])}
    for n, content in body.items():
        put(media / n, content, 0)
    path = {n: str(media / n) for n in body}
    image = {"MIMEType": "image/png", "FileName": "a.png", "ImageWidth": 5}
    put(tags / "1.json", dump(path["ok"], **image).encode(), 0)
    put(tags / "2.json", b'[{"SourceFile": "' + path["bad"].encode() + b'", "MIME', 0)  # cut off
    put(tags / "3.json", dump(path["late"], **image).encode(), 5)
    put(tags / "4.json", dump(path["after"], **image).encode(), 1)
    feed = "".join(f'{path[n]},"application/pdf\n"\n' for n in ("ok", "bad", "none")).replace("\n\"", '"')
    put(types / "1.csv", feed.encode(), 1)
    put(types / "2.csv", f"{path['late']},text/html\n".encode(), 0)
    put(types / "3.csv", f"{path['nothing']},text/html\n".encode(), 7)
    # Ticks long after all others.
    put(media / "tick", b"t", 99)
    put(tags / "tick.json", dump("/tick", **image).encode(), 99)
    put(types / "tick.csv", b"/tick,x\n", 99)

    stream = metadata_stream.records_stream(
        metadata_stream.stream_files(spark, str(media), 2),
        metadata_stream.stream_dumps(spark, str(tags), 1),
        metadata_stream.stream_feed(spark, str(types), 1),
        wait="2 hours",
    )
    assert stream.isStreaming and "raw" in stream.columns
    out = stream.select(*KEPT, F.to_json("raw").alias("raw"))
    request_stream.run_appending(out, str(tmp_path / "out")).awaitTermination()
    rows = request_stream.read_rows(spark, str(tmp_path / "out"), out.schema).where("path NOT LIKE '%tick'")
    got = {r.path.split("/")[-1]: r for r in rows.collect()}
    assert rows.count() == len(got) == len(body)
    for n, content in body.items():
        assert (got[n].size, got[n].sha1) == (len(content), hashlib.sha1(content).hexdigest())
        assert got[n].md5 == hashlib.md5(content).hexdigest()
    assert [got[n].mimetype for n in body] == [
        "image/png", "application/pdf", "application/pdf", "text/html", None, "image/png",
    ]
    assert [got[n].name for n in body] == ["a.png", *["unknown_filename"] * 4, "a.png"]
    assert "Neither" in got["nothing"].error and got["none"].error is None
    assert json.loads(got["late"].raw) == {"MIMEType": "text/html", "FileName": "unknown_filename"}

    # The table form, given what came in time, says the same.
    files = spark.createDataFrame([(path[n], len(b), b) for n, b in body.items()], "path string, length bigint, content binary")
    texts = [(dump(path[n], **image),) for n in ("ok", "after")]
    exif = dumps.exif_table(spark.createDataFrame(texts, "dump string"))
    secondary = [(path[n], "application/pdf") for n in ("ok", "bad", "none")] + [(path["late"], "text/html")]
    table = metadata.metadata(files, exif, spark.createDataFrame(secondary, "path string, mimetype string"))
    want = {r.path.split("/")[-1]: r for r in table.select(*KEPT, F.to_json("raw").alias("raw")).collect()}
    assert {n: tuple(r) for n, r in got.items()} == {n: tuple(r) for n, r in want.items()}


def test_an_unreadable_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"a")
    files = metadata_stream.stream_files(spark, str(tmp_path / "in"))
    request_stream.run_appending(files, str(tmp_path / "out")).awaitTermination()
    (row,) = request_stream.read_rows(spark, str(tmp_path / "out"), files.schema).collect()
    assert (row.length, row.md5, row.checksum_error) == (1, hashlib.md5(b"a").hexdigest(), None)
    assert not metadata_stream.stream_files(spark, str(tmp_path / "in"), sums=False).columns[3:]
