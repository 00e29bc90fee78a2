"""Tag dumps to records: edge rows, broken dumps, and files written to disk."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from catalens.operators import metadata
from catalens.sources import dumps, inventory, manifest, people, requests
from catalens.streaming import metadata_stream, request_stream

c = F.col


def records(spark, *tag_rows, **options):
    """One record per row of tags, each a file of its own."""
    n = len(tag_rows)
    files = spark.createDataFrame(
        [(f"/f{i}", 10 + i, f"x{i}".encode()) for i in range(n)],
        "path string, length bigint, content binary",
    )
    texts = [(f"/f{i}", t if isinstance(t, str) else json.dumps([t])) for i, t in enumerate(tag_rows)]
    exif = dumps.exif_table(spark.createDataFrame(texts, "path string, dump string"), "path")
    feed = spark.createDataFrame(
        [(f"/f{i}", m) for i, m in enumerate(options.get("feed", []))], "path string, mimetype string"
    )
    found = metadata.metadata(files, exif, feed, options.get("checksums", True))
    return found.orderBy("path").collect()


def image(**tags):
    return {"MIMEType": "image/jpeg", "FileName": "a.jpg", "ImageWidth": 350, "ImageHeight": 150, **tags}


def test_image_video_audio(spark):
    picture, video, sound = records(
        spark,
        image(),
        {"MIMEType": "video/mp4", "FileName": "video1.mp4", "ImageWidth": 560, "ImageHeight": 320},
        {"MIMEType": "audio/mpeg", "FileName": "audio1.mp3", "Duration": 1.5},
    )
    assert (picture.name, picture.type, picture.mimetype) == ("a.jpg", "image", "image/jpeg")
    assert (picture.width, picture.height, picture.rawImage) == (350, 150, False)
    assert picture.where.gps is None and picture.when.device is None and picture.when.gps is None
    assert picture.sha1 == hashlib.sha1(b"x0").hexdigest()
    assert picture.md5 == hashlib.md5(b"x0").hexdigest()
    assert (video.type, video.width, video.height, video.rawImage) == ("video", 560, 320, None)
    assert (sound.type, sound.width, sound["where"], sound.when) == ("audio", None, None, None)
    assert sound.fileinfo.duration == 1.5


def test_unreadable_dumps(spark):
    broken, lost, empty = records(spark, "[{broken", "", "[]", feed=["text/plain"])
    assert (broken.name, broken.mimetype, broken.type, broken.error) == (
        "unknown_filename", "text/plain", "document", None,
    )
    assert json.loads(broken.raw.toJson()) == {
        "MIMEType": "text/plain", "FileName": "unknown_filename",
    }
    for r in (lost, empty):
        assert r.type == "other" and r.error == "Neither tags nor MIME type could be read"


@pytest.mark.parametrize(
    "text,ok",
    [
        ('[{"FileName": "a"}]', True), ("[{}]", True), ('[{"FileName": "a"', False), ("[]", False),
        ("", False), ("[{'FileName': 'a'}]", False), ('[{"ISO": NaN}]', False), ('[{"FileName": "a"}] x', False),
        ('[{"Odd": {"deep": [1, "x"]}, "FileName": "a"}, {"FileName": "b"}]', True), ("nonsense", False),
        ('{"FileName": "a"}', False), ('[{"FileName": "a"}]\n', True),
    ],
)
def test_only_strict_dumps_are_readable(spark, text, ok):
    df = spark.createDataFrame([("/f", text)], "path string, dump string")
    (row,) = dumps.exif_table(df, "path").collect()
    assert row.exif_ok == ok and row.FileName in ("a" if ok else None, None)
    (narrow,) = dumps.mime_of_dump(df).collect()
    assert narrow.MIMEType is None


def test_odd_values_cost_no_other_tag(spark):
    (r,) = records(
        spark, image(ImageWidth="350", ImageHeight=150.0, ISO="auto", Duration={"a": 1}, FrameCount="12")
    )
    assert (r.width, r.height, r.fileinfo.iso, r.fileinfo.frames, r.name) == (350, 150, None, 12, "a.jpg")


def test_missing_mime_is_no_failure(spark):
    """The secondary MIME type is for unreadable tags, not for a missing one."""
    (r,) = records(spark, {"FileName": "a"}, feed=["text/plain"])
    assert (r.mimetype, r.type, r.name) == (None, "other", "a")


def test_heavy_tags_go(spark):
    (r,) = records(spark, image(DataDump="x" * 100, ThumbnailImage="y", Warning="z", Odd=1))
    assert set(json.loads(r.raw.toJson())) == {"MIMEType", "FileName", "ImageWidth", "ImageHeight", "Odd"}


def test_raw_tags_are_cleaned_like_the_typed_ones(spark):
    (r,) = records(spark, image(ImageSize="350 150", DateTimeOriginal="    :  :     :  :  ", ISO=100))
    raw = json.loads(r.raw.toJson())
    assert raw["ImageSize"] == "350x150" and "DateTimeOriginal" not in raw and raw["ISO"] == 100


def test_first_truthy(spark):
    rows = records(
        spark,
        image(Model=0, DeviceModelName="M", Make="", DeviceManufacturer="Acme"),
        image(Model="0", DeviceModelName="M", FrameRate=0, VideoFrameRate=25, FrameCount=0),
        image(Model=5, LtcChangeTableLtcChangeFrameCount=0),
    )
    assert [r.deviceinfo.model for r in rows] == ["M", "0", "5"]
    assert rows[0].deviceinfo.make == "Acme"
    assert (rows[1].fileinfo.fps, rows[1].fileinfo.frames) == (25.0, None)
    assert rows[2].fileinfo.frames == 0


def test_serial_numbers(spark):
    rows = records(
        spark,
        image(SerialNumber="A\u0000B", InternalSerialNumber="C"),
        image(SerialNumber="", InternalSerialNumber=12),
        image(SerialNumber=0, DeviceSerialNo="D\u0000E"),
        image(),
    )
    assert [r.deviceSerialNumber for r in rows] == ["AB", "12", "D\x00E", None]


@pytest.mark.parametrize(
    "tags,angle",
    [({"Orientation": 8}, 90), ({"Orientation": 6}, 270), ({"Orientation": 3}, 180), ({"Orientation": 1}, None),
     ({"Orientation": 8, "ImageWidth": 100}, None), ({"Orientation": 8, "ImageWidth": 150}, None),
     ({"Orientation": 8, "ImageWidth": None}, None), ({"Orientation": "8"}, None)],
)
def test_angle(spark, tags, angle):
    (r,) = records(spark, image(**tags), checksums=False)
    assert r.angle == angle


def test_places(spark):
    here = {"GPSLongitude": 12.5, "GPSLatitude": -3.5, "GPSAltitude": 7}
    rows = records(
        spark,
        image(**here, Landmark="---", City="X"),
        image(**here, GPSDOP=0),
        image(**here, GPSDOP="0"),
        image(**{**here, "GPSLatitude": 0}),
        {"MIMEType": "video/mp4", "Make": "Apple", "GPSDOP": 0, "City": "X", "Landmark": "L", **here},
        {"MIMEType": "audio/mpeg", **here},
    )
    places = [r["where"] and r["where"].gps for r in rows]
    assert (places[0].longitude, places[0].altitude, places[0].city, places[0].landmark) == (12.5, 7.0, "X", "")
    assert places[1] is None and places[2] is not None and places[3] is None
    assert (places[4].latitude, places[4].city, places[4].landmark) == (-3.5, None, None)
    assert places[5] is None


def test_times(spark):
    blank = "    :  :     :  :  "
    rows = records(
        spark,
        image(DateTimeOriginal=blank, CreationDateValue="2020:01:02 03:04:05+01:00", CreateDate="bad"),
        image(DateTimeOriginal="2019:01:02 03:04:05", CreationDateValue="bad"),
        image(DateTimeOriginal="2019-01-02"),
        image(GPSDateTime="0000:00:00 00:00:00Z"),
        image(GPSDateTime="2020:01:02 03:04:05.5Z"),
        image(GPSDateTime="2020:01:02 03:04:05Z", GPSDOP=0),
        {"MIMEType": "video/mp4", "DeviceManufacturer": "Apple", "DateTimeOriginal": "2019:01:02 03:04:05",
         "CreationDate": "2021:01:02 03:04:05-02:00", "GPSDateTime": "2020:01:02 03:04:05Z"},
    )
    device = [r.when.device for r in rows]
    assert (device[0].year, device[0].timezone) == ("2020", "+01:00")
    assert (device[0].deviceType, device[0].deviceAutoDst, device[0].deviceUtcOffset) == ("unknown", False, 0)
    assert device[1].year == "2019" and device[1].timezone is None
    assert device[2] is None and rows[2].error == "Unparsable date, 2019-01-02"
    gps = [r.when.gps for r in rows]
    assert gps[3] is None and gps[4].timezone == "+00:00" and gps[5] is None
    assert device[6].year == "2021" and device[6].timezone == "-02:00" and gps[6] is None


def test_contents_never_enter_a_shuffle(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = inventory.read_files(spark, str(tmp_path))
    exif = dumps.exif_table(spark.createDataFrame([("p", "[{}]")], "path string, dump string"), "path")
    feed = spark.createDataFrame([("p", "m")], "path string, mimetype string")

    def scan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        (line,) = [x for x in text.splitlines() if "FileScan binaryFile" in x]
        return line.split("ReadSchema")[1]

    assert "content" not in scan(metadata.metadata(files, exif, feed, checksums=False))
    with_sums = metadata.metadata(files, exif, feed)
    assert "content" in scan(with_sums)
    # Not used further on: not read.
    assert "content" not in scan(with_sums.select("path", "type"))
    joined = with_sums._jdf.queryExecution().optimizedPlan().toString()
    below = joined[joined.index("Join LeftOuter") :]
    assert "sha1" in below or "_pre_computed" in below


# --- sources ----------------------------------------------------------------------------


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    body = bytes(range(256)) * 50
    (tmp_path / "sub" / "7_w20_h0_s0_a0_m0.jpg").write_bytes(body)
    (tmp_path / "notes.txt").write_bytes(b"n")
    listing = inventory.read_listing(spark, str(tmp_path))
    assert {r.name for r in listing.collect()} == {"7_w20_h0_s0_a0_m0.jpg", "notes.txt"}
    files = inventory.read_files(spark, str(tmp_path))
    assert {r.length for r in inventory.file_sizes(files).collect()} == {len(body), 1}
    sums = {r.path.split("/")[-1]: r for r in inventory.checksum_stream(files, ["sha1", "md5"]).collect()}
    assert sums["notes.txt"].md5 == hashlib.md5(b"n").hexdigest()
    assert sums["7_w20_h0_s0_a0_m0.jpg"].sha1 == hashlib.sha1(body).hexdigest()
    row, other = sorted(manifest.manifest_rows(listing).collect(), key=lambda r: r.name)
    assert other.error == "Not a rendition key" and other.type is None
    assert (row.id, row.width, row.type, row.mirror) == ("7", 20, "image", False)
    with pytest.raises(ValueError):
        inventory.checksum(c("content"), "crc")


def test_manifest_on_disk(spark, tmp_path):
    names = [f"{i}_w{i}_h0_s0_a0_m{i % 2}.{e}" for i in range(20) for e in ("jpg", "webm", "pdf", "x")]
    listing = spark.createDataFrame([(f"/cache/{n}", n) for n in names], "filepath string, name string")
    path = str(tmp_path / "manifest")
    rows = manifest.manifest_rows(listing)
    manifest.write_manifest(rows, path)
    back = manifest.read_manifest(spark, path).drop("bucket")
    assert back.count() == 80
    assert back.where("error IS NULL").count() == 60
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))
    manifest.write_manifest(rows, path)
    assert manifest.read_manifest(spark, path).count() == 80
    plan = back.where("type = 'image' AND id = '3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "EqualTo(id,3)" in plan


def test_dumps_on_disk(spark, tmp_path):
    lines = [json.dumps([{"SourceFile": f"/f{i}", "MIMEType": "image/png"}]) for i in range(3)]
    (tmp_path / "a.json").write_text("\n".join([*lines, "[{broken"]))
    table = dumps.exif_table(dumps.read_dumps(spark, str(tmp_path)))
    *good, bad = sorted(table.collect(), key=lambda r: (not r.exif_ok, r.path))
    assert [(r.path, r.MIMEType, r.bad_dump) for r in good] == [(f"/f{i}", "image/png", None) for i in range(3)]
    assert (bad.path, bad.bad_dump, bad.MIMEType) == (None, "[{broken", None)
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "b.json").write_text('[{\n "SourceFile": "/g",\n "Model": 3\n}]')
    (row,) = dumps.exif_table(dumps.read_dumps(spark, str(tmp_path / "whole"), whole_files=True)).collect()
    assert (row.path, row.Model) == ("/g", "3")


def test_mime_feed_on_disk(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('/a,"text/plain\n"\n/b,image/png\n')
    rows = dumps.read_mime_feed(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("/a", "text/plain"), ("/b", "image/png")]


def test_loosely_typed_requests(spark, tmp_path):
    lines = [
        {"request_id": 1, "id": 7, "type": "image", "angle": 90, "mirror": True, "timeindex": 1.5},
        {"request_id": 2, "id": "x", "type": "image", "angle": "90abc", "mirror": "false", "timeindex": 0},
        {"request_id": 3, "id": "x", "type": "image", "angle": 0, "mirror": False, "timeindex": "00:01"},
        {"request_id": 4, "id": "x", "type": "image", "mirror": None, "width": 20},
        {"request_id": 5, "id": "x", "type": "image", "width": "20", "height": 0},
        {"request_id": 6, "id": "x", "type": "image", "width": 20.5, "height": "tall"},
        {"request_id": 7, "id": "x", "type": "image", "width": "", "height": False},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    rows = {r.request_id: r for r in requests.read_requests(spark, str(tmp_path)).collect()}
    assert [(rows[i].angle, rows[i].mirror, rows[i].timeindex) for i in (1, 2, 3, 4)] == [
        ("90", "true", "1.5"), ("90abc", "false", None), (None, None, "00:01"), (None, None, None),
    ]
    assert rows[1].id == "7" and rows[4].width == 20
    assert [(rows[i].width, rows[i].height) for i in (5, 6, 7)] == [(20, 0), (None, None), (None, None)]
    assert [rows[i].size_error for i in (4, 5, 6, 7)] == [None, None, "Sizes are whole numbers, not 20.5", None]
    assert requests.stream_requests(spark, str(tmp_path)).isStreaming


def test_names_from_paths(spark):
    df = spark.createDataFrame([("people/Ann Lee.x.jpg",), ("train/Bo/.hid",), ("solo",)], "p string")
    found = df.select(people.name_from_file(c("p")), people.name_from_folder(c("p"))).collect()
    assert [tuple(r) for r in found] == [("Ann Lee.x", "people"), (".hid", "Bo"), ("solo", None)]


def test_dump_stream(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        tags = {"SourceFile": f"/f{i}", "MIMEType": "image/png", "Make": "Canon"}
        (source / f"{i}.json").write_text(json.dumps([tags]))
    table = metadata_stream.stream_dumps(spark, str(source), files_per_batch=1)
    rows = metadata_stream.metadata_stream(table, "path").select("path", "type", "deviceinfo.make")
    request_stream.run_appending(rows, folder).awaitTermination()
    back = request_stream.read_rows(spark, folder, "path string, type string, make string")
    assert sorted(map(tuple, back.collect())) == [(f"/f{i}", "image", "Canon") for i in range(3)]
    sums = metadata_stream.stream_checksums(spark, str(source))
    request_stream.run_appending(sums.select("sha1"), folder + "2").awaitTermination()
    assert request_stream.read_rows(spark, folder + "2", "sha1 string").distinct().count() == 3
