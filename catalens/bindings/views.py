"""Media tables derived from the given tables with plain arithmetic.

There are no media files among the given tables, so paths, tags, requests, stored renditions
and faces are computed from their keys. Every view covers its whole table. ``sql_views``
holds the same views in SQL, written separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.functions import dates, mime
from catalens.operators import lookup
from catalens.sources.dumps import image_size_text

c = F.col
CACHE = "/cache"

# Every MIME type that has a media type, then an unknown one; index 41 is missing.
MIMES = [m for t in mime.MEDIA_TYPES for m in mime.MIME_GROUPS[t]] + ["application/x-unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _pick(index: Column, values: list) -> Column:
    """Value by index; NULL for a None entry and for any other index."""
    cases = [F.when(index == i, F.lit(v)) for i, v in enumerate(values) if v is not None]
    return F.coalesce(*cases)


def mime_at(n: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in MIMES]), (n % 42 + 1).cast("int"))


def media_path(n: Column) -> Column:
    ending = _pick(n % 3, [".CR2", "", ".tar.x"])
    return F.concat(F.lit("/media/f"), n.cast("string"), ending)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        c("doc_id").alias("id"),
        F.concat(F.lit("/docs/"), c("source"), F.lit("/"), c("doc_id").cast("string")).alias("path"),
        F.lit("text/plain").alias("mimetype"),
        F.encode("text", "UTF-8").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select(
        c("page_id").alias("id"),
        F.concat(F.lit("/pages/"), c("page_id").cast("string"), F.lit("/"), c("url")).alias("path"),
        F.lit("text/html").alias("mimetype"),
        F.encode("html", "UTF-8").alias("content"),
    )
    both = documents.unionByName(pages)
    return both.withColumn("length", F.octet_length("content").cast("bigint"))


def mimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("id"),
        media_path(n).alias("path"),
        F.when(n % 5 != 0, mime_at(n)).alias("exif_mimetype"),
        F.when(n % 7 != 0, mime_at(n * 11 + 3)).alias("fallback_mimetype"),
        (n % 5 != 0).alias("exif_ok"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("p_partkey")
    m = _div(n, 42)
    return table(spark, sf_dir, "part").select(
        media_path(n).alias("path"),
        mime_at(n).alias("mimetype"),
        F.when(m % 5 == 1, F.lit(0)).when(m % 5 > 0, 16 + n * 37 % 4000).cast("int").alias("width"),
        F.when(m % 7 == 1, F.lit(0)).when(m % 7 > 0, 16 + n * 53 % 3000).cast("int").alias("height"),
        _pick(n % 13 % 3, ["dvsd", "h264", None]).alias("compression"),
    )


def _text(r: Column, missing: int, empty: int, value: Column) -> Column:
    """NULL below ``missing``, '' below ``empty``, else the value."""
    return F.when(r >= empty, value).when(r >= missing, F.lit(""))


def _number(r: Column, missing: int, zero: int, value: Column) -> Column:
    return F.when(r >= zero, value).when(r >= missing, F.lit(0))


def _date(n: Column) -> Column:
    def two(c_: Column) -> Column:
        return F.lpad(c_.cast("string"), 2, "0")

    zone = _pick(n % 4, ["", "Z", "+02:00", ".25-05:00"])
    colon = F.lit(":")
    return F.concat(
        (2000 + n % 25).cast("string"), colon, two(1 + n % 12), colon, two(1 + n % 28), F.lit(" "),
        two(n % 24), colon, two(n % 60), colon, two(n % 59), zone,
    )


def tag_values(n: Column) -> dict[str, Column]:
    """All tags of file number ``n``; missing, empty and zero values included."""
    s = n.cast("string")

    def named(letter: str, r: Column) -> Column:
        return F.concat(F.lit(letter), r.cast("string"))

    original = n % 131
    return {
        "FileName": F.concat(F.lit("f"), s, F.lit(".jpg")),
        "MIMEType": mime_at(n),
        "Make": _pick(n % 5, [None, "", "Apple", "Canon", "Sony"]),
        "DeviceManufacturer": F.when(n % 11 > 5, F.lit("Acme"))
        .when(n % 11 == 5, F.lit("Apple"))
        .when(n % 11 == 4, F.lit("")),
        "Model": _text(n % 13, 1, 2, named("M", n % 13)),
        "DeviceModelName": F.when(n % 17 > 3, named("D", n % 17)),
        "SerialNumber": _text(n % 19, 7, 8, F.concat(F.lit("S\x00"), s)),
        "InternalSerialNumber": _text(n % 23, 10, 11, F.concat(F.lit("I\x00"), s)),
        "DeviceSerialNo": F.when(n % 29 > 9, named("N", n)),
        "FileNumber": F.when(n % 31 > 9, named("100-", n)),
        "ImageWidth": _number(n % 37, 1, 2, 100 + n * 7 % 900).cast("int"),
        "ImageHeight": _number(n % 41, 1, 2, 100 + n * 11 % 900).cast("int"),
        "FrameRate": _number(n % 43, 15, 16, n % 43).cast("double"),
        "VideoFrameRate": F.when(n % 47 > 19, n % 47 + F.lit(0.5)),
        "ISO": F.when(n % 53 > 9, n % 53 * 100).cast("double"),
        "ExposureTime": F.lit(1.0) / (1 + n % 59),
        "FrameCount": _number(n % 61, 20, 21, n % 61).cast("bigint"),
        "LtcChangeTableLtcChangeFrameCount": F.when(n % 67 > 29, n % 67).cast("bigint"),
        "Duration": F.when(n % 71 > 19, n % 71 * F.lit(0.25)),
        "Orientation": (n % 73 % 9).cast("double"),
        "GPSLongitude": _number(n % 79, 10, 15, (n * 7 % 36000 - 18000) / F.lit(100.0)).cast("double"),
        "GPSLatitude": _number(n % 83, 10, 15, (n * 11 % 18000 - 9000) / F.lit(100.0)).cast("double"),
        "GPSAltitude": F.when(n % 89 > 29, n % 89 * F.lit(1.5)),
        "GPSDOP": _number(n % 97, 30, 50, n % 97).cast("double"),
        "Country": F.when(n % 101 > 49, named("C", n % 101)),
        "State": F.when(n % 103 > 49, named("S", n % 103)),
        "City": F.when(n % 107 > 49, named("T", n % 107)),
        "Landmark": F.when(n % 109 > 59, named("L", n % 109)).when(n % 109 > 29, F.lit("---")),
        "GPSAreaInformation": F.when(n % 113 > 49, named("A", n % 113)),
        "GPSDateTime": F.when(n % 127 > 69, _date(n))
        .when(n % 127 > 59, F.lit("bad date"))
        .when(n % 127 > 39, F.lit("0000:00:00 00:00:00Z"))
        .when(n % 127 > 29, F.lit("")),
        "DateTimeOriginal": F.when(original > 64, _date(n + 1))
        .when(original > 59, F.lit("bad date"))
        .when(original > 49, F.lit("    :  :     :  :  "))
        .when(original > 39, F.lit("")),
        "CreationDateValue": F.when(n % 137 > 89, _date(n + 2)),
        "CreateDate": F.when(n % 139 > 49, _date(n + 3)),
        "CreationDate": F.when(n % 149 > 59, _date(n + 4)).when(n % 149 > 54, F.lit("2001-02-03")),
        "Compression": _pick(n % 13 % 3, ["dvsd", "h264", None]),
        "ImageSize": F.when(n % 151 > 89, F.concat(s, F.lit("x"), s)).when(
            n % 151 > 29, F.concat(s, F.lit(" "), s)
        ),
    }


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as they come, one row per line item."""
    n = c("l_orderkey") * 7 + c("l_linenumber")
    numbered = table(spark, sf_dir, "lineitem").select(n.alias("id"))
    return numbered.select("id", *[v.alias(k) for k, v in tag_values(c("id")).items()])


def clean_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with blank dates removed and sizes normalised, as records are built from."""
    return exif(spark, sf_dir).withColumns(
        {
            "DateTimeOriginal": dates.drop_blank(c("DateTimeOriginal")),
            "ImageSize": image_size_text(c("ImageSize")),
        }
    )


def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    zone = _pick(n % 4, ["", "Z", "+02:00", ".25-05:00"])
    date = F.concat(day, zone)
    return table(spark, sf_dir, "orders").select(
        n.alias("id"),
        F.when(n % 11 > 1, date).when(n % 11 == 1, F.lit("")).alias("GPSDateTime"),
        F.when(n % 7 > 2, F.regexp_replace(date, ":", "/"))
        .when(n % 7 == 2, date)
        .when(n % 7 == 1, F.lit("    :  :     :  :  "))
        .alias("DateTimeOriginal"),
    )


def dumps_of(rows: DataFrame, n: Column) -> DataFrame:
    """``path, dump``: tag dumps as JSON text. Every ninth is cut off, as a crash leaves it."""
    tags = {k: v.alias(k) for k, v in tag_values(c("n")).items()}
    heavy = [F.lit("AAAA").alias("ThumbnailImage"), F.lit("minor").alias("Warning")]
    source = c("path").alias("SourceFile")
    text = F.to_json(F.array(F.struct(source, *tags.values(), *heavy)))
    cut = F.when(c("n") % 9 == 0, F.substring(text, 1, 40)).otherwise(text)
    return rows.withColumn("n", n).select("path", cut.alias("dump"))


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of the files of :func:`files`; one in ten files has none at all."""
    rows = files(spark, sf_dir).where(c("id") % 10 != 9).select("path", "id")
    return dumps_of(rows, c("id"))


def mime_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary MIME types, ending in a line break as the tool prints them."""
    return (
        files(spark, sf_dir)
        .where(c("id") % 8 != 7)
        .select("path", F.concat(c("mimetype"), F.lit("\n")).alias("mimetype"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as rendition requests."""
    n, k = c("event_id"), c("k")
    type_ = (
        F.when(c("event_type") == "view", "image")
        .when(c("event_type") == "click", "video")
        .when(c("event_type") == "purchase", "audio")
        .when(c("event_type") == "signup", "document")
        .when(k % 5 == 4, "sticker")
        .otherwise("*")
    )
    numbered = events.withColumn("k", F.from_json("props", "k int")["k"])
    return numbered.select(
        n.alias("request_id"),
        "ts",
        c("user_id").alias("id"),
        media_path(_div(n, 4)).alias("filename"),
        type_.alias("type"),
        _pick(k % 4, [None, 0, 20, 320]).alias("width"),
        _pick(_div(k, 4) % 3, [None, 20, 240]).alias("height"),
        _pick(n % 8, [None, "0", "90", "-90", "180", "270", "90abc", "45"]).alias("angle"),
        _pick(_div(n, 16) % 4, [None, "true", "false", ""]).alias("mirror"),
        _pick(_div(n, 64) % 3, [None, 0.0, 12.5]).alias("timeindex"),
        _pick(_div(n, 192) % 3, [None, True, False]).alias("deinterlace"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_key(requests(spark, sf_dir), CACHE)


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored renditions: those of half of the requests."""
    stored = lookup.valid(keyed(spark, sf_dir)).where(_div(c("request_id"), 8) % 2 == 0)
    return stored.select("filepath", "name").distinct()


def asked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to list or remove: customers of odd nations."""
    customers = table(spark, sf_dir, "customer").where(c("c_nationkey") % 2 == 1)
    return customers.select(c("c_custkey").alias("id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed requests as jobs; those of the first minutes are running."""
    flights = lookup.single_flight(keyed(spark, sf_dir))
    return flights.select(
        "filepath",
        "request_id",
        lookup.job_class(c("type")).alias("job_class"),
        (c("arrival") < F.lit("2024-01-01 00:08:00").cast("timestamp_ntz")).alias("running"),
        "arrival",
        "waiters",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces found in images: every tenth alone in its image, the others four or five to one."""
    n = c("vec_id")
    alone = n % 10 == 0
    left, top = n * 17 % 700, n * 29 % 500
    return table(spark, sf_dir, "embeddings").select(
        n,
        F.when(alone, n).otherwise(1000000 + _div(n, 5)).alias("image_id"),
        F.when(alone, F.lit(0)).when(_div(n, 5) % 2 == 0, n % 5 - 1).otherwise(n % 5).cast("int").alias("face_no"),
        F.lit(1021).alias("img_w"),
        F.lit(769).alias("img_h"),
        top.cast("int").alias("top"),
        (left + 30 + n % 91).cast("int").alias("right"),
        (top + 30 + n % 83).cast("int").alias("bottom"),
        left.cast("int").alias("left"),
        c("embedding").cast("array<double>").alias("encoding"),
        c("label").alias("person"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("face_id", c("vec_id"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with faces, and one without for every seventh face."""
    n = c("vec_id")
    found = faces(spark, sf_dir).select("image_id").distinct()
    empty = table(spark, sf_dir, "embeddings").where(n % 7 == 0)
    return found.unionByName(empty.select((2000000 + n).alias("image_id")))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known people: the faces that are alone in their image."""
    alone = faces(spark, sf_dir).where(c("image_id") < 1000000)
    name = F.concat(F.lit("person"), c("person").cast("string"))
    return alone.select(name.alias("name"), "encoding")


def unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces to be recognised: all others."""
    return faces(spark, sf_dir).where(c("image_id") >= 1000000)


def unknown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where(c("image_id") >= 1000000)
