"""Clean metadata records from file listings, tag tables and the secondary MIME feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions import dates, js, mime
from catalens.sources import checksums as piecewise, inventory

# Fixed values of records whose tags could not be read, and of device times.
UNKNOWN_NAME = "unknown_filename"
DEVICE_CONSTANTS = {"deviceType": "unknown", "deviceAutoDst": False, "deviceUtcOffset": 0}
# Angle by orientation tag.
ANGLE_BY_ORIENTATION = {8: 90, 6: 270, 3: 180}
NO_LANDMARK = "---"

c = F.col


def model() -> Column:
    return js.or_text(c("Model"), c("DeviceModelName"))


def make() -> Column:
    return js.or_text(c("Make"), c("DeviceManufacturer"))


def fps() -> Column:
    return js.or_number(c("FrameRate"), c("VideoFrameRate"))


def frames() -> Column:
    return js.or_number(c("FrameCount"), c("LtcChangeTableLtcChangeFrameCount"))


def serial_number() -> Column:
    """First serial number present; NUL characters go from the first two tags only."""
    def without_nul(tag: str) -> Column:
        return F.when(js.truthy_text(c(tag)), F.translate(c(tag), "\x00", ""))

    return F.coalesce(
        without_nul("SerialNumber"),
        without_nul("InternalSerialNumber"),
        F.when(js.truthy_text(c("DeviceSerialNo")), c("DeviceSerialNo")),
    )


def _reliable_position() -> Column:
    """A precision value of exactly 0 marks a stale position; none at all is fine."""
    return ~c("GPSDOP").eqNullSafe(F.lit(0))


def _gps_time_text() -> Column:
    """Satellite time to use, as text."""
    t = c("GPSDateTime")
    usable = js.truthy_text(t) & (t != dates.ZERO_GPS_DATE) & _reliable_position()
    return F.when(c("_visual") & ~c("_vendor") & usable, t)


def _device_time_text() -> Column:
    """Device time to use, as text: the first tag present in order of priority."""
    def present(tag: str) -> Column:
        return F.when(js.truthy_text(c(tag)), c(tag))

    usual = F.coalesce(
        present("DateTimeOriginal"), present("CreationDateValue"), present("CreateDate")
    )
    chosen = F.when(c("_vendor"), present("CreationDate")).otherwise(usual)
    return F.when(c("_visual"), chosen)


def with_facts(tags: DataFrame) -> DataFrame:
    """Add what several columns of a record depend on, so that each is worked out once.

    ``_type``, ``_visual`` (image or video), ``_vendor`` (videos of one vendor carry their
    place and time in other tags), and text and date found for both times.
    """
    typed = tags.withColumn("_type", mime.media_type(c("MIMEType")))
    return (
        typed.withColumns(
            {
                "_visual": c("_type").isin("image", "video"),
                "_vendor": F.coalesce(make() == "Apple", F.lit(False)) & (c("_type") == "video"),
            }
        )
        .withColumns({"_gps_text": _gps_time_text(), "_device_text": _device_time_text()})
        .withColumns(
            {
                "_gps_date": dates.find_date(c("_gps_text")),
                "_device_date": dates.find_date(c("_device_text")),
            }
        )
    )


# The functions below need the columns of with_facts.


def angle() -> Column:
    """Rotation of a picture stored lying down; one stored upright is already turned."""
    lying = F.coalesce(c("ImageHeight") < c("ImageWidth"), F.lit(False))
    turned = F.coalesce(
        *[F.when(c("Orientation") == k, F.lit(v)) for k, v in ANGLE_BY_ORIENTATION.items()]
    )
    return F.when(c("_visual") & ~c("_vendor") & lying, turned)


def raw_image() -> Column:
    return F.when(c("_type") == "image", mime.is_raw_image(c("MIMEType")))


def gps() -> Column:
    """Place struct; NULL without both coordinates, or if one of them is 0."""
    located = js.truthy_number(c("GPSLongitude")) & js.truthy_number(c("GPSLatitude"))

    def named(tag: str) -> Column:
        return F.when(~c("_vendor"), c(tag))

    landmark = F.when(c("Landmark") == NO_LANDMARK, F.lit("")).otherwise(c("Landmark"))
    place = F.struct(
        c("GPSLongitude").alias("longitude"),
        c("GPSLatitude").alias("latitude"),
        c("GPSAltitude").alias("altitude"),
        named("Country").alias("country"),
        named("State").alias("state"),
        named("City").alias("city"),
        F.when(~c("_vendor"), landmark).alias("landmark"),
        named("GPSAreaInformation").alias("area"),
    )
    return F.when(c("_visual") & located & (c("_vendor") | _reliable_position()), place)


def device_time() -> Column:
    parsed = dates.split_date(c("_device_date"))
    fields = [parsed[p].alias(p) for p in [*dates.DATE_PARTS, "timezone"]]
    constants = [F.lit(v).alias(k) for k, v in DEVICE_CONSTANTS.items()]
    return F.when(c("_device_date") != "", F.struct(*fields, *constants))


def gps_time() -> Column:
    return dates.split_date(c("_gps_date"))


def gps_time_error() -> Column:
    return dates.date_error(c("_gps_text"), c("_gps_date"))


def device_time_error() -> Column:
    return dates.date_error(c("_device_text"), c("_device_date"))


def record_error() -> Column:
    """First thing that would make reading the record fail."""
    return F.coalesce(gps_time_error(), device_time_error())


def record_columns() -> list[Column]:
    """Columns of the record that come from tags (size and checksums come from the file)."""
    visual = c("_visual")
    place = F.struct(gps().alias("gps"))
    time = F.struct(gps_time().alias("gps"), device_time().alias("device"))
    return [
        c("FileName").alias("name"),
        c("_type").alias("type"),
        c("MIMEType").alias("mimetype"),
        F.struct(model().alias("model"), make().alias("make")).alias("deviceinfo"),
        F.struct(
            c("FileNumber").alias("number"),
            c("ImageWidth").alias("width"),
            c("ImageHeight").alias("height"),
            fps().alias("fps"),
            c("ISO").alias("iso"),
            c("ExposureTime").alias("exposure"),
            frames().alias("frames"),
            c("Duration").alias("duration"),
        ).alias("fileinfo"),
        serial_number().alias("deviceSerialNumber"),
        F.when(visual, c("ImageWidth")).alias("width"),
        F.when(visual, c("ImageHeight")).alias("height"),
        angle().alias("angle"),
        raw_image().alias("rawImage"),
        F.when(visual, place).alias("where"),
        F.when(visual, time).alias("when"),
    ]


def resolve_mime(exif_ok: Column, exif_mime: Column, fallback_mime: Column) -> Column:
    """The tags' MIME type; the secondary one only if reading the tags failed."""
    return F.when(F.coalesce(exif_ok, F.lit(False)), exif_mime).otherwise(fallback_mime)


def with_fallback(exif: DataFrame) -> DataFrame:
    """Replace unreadable tags by the secondary MIME type and a placeholder name.

    Needs ``exif_ok`` and ``fallback_mimetype`` next to the tag columns.
    """
    ok = F.coalesce(c("exif_ok"), F.lit(False))
    return exif.withColumns(
        {
            "MIMEType": resolve_mime(c("exif_ok"), c("MIMEType"), c("fallback_mimetype")),
            "FileName": F.when(ok, c("FileName")).otherwise(F.lit(UNKNOWN_NAME)),
        }
    )


def metadata(
    files: DataFrame,
    exif: DataFrame,
    mime_fallback: DataFrame,
    checksums: bool = True,
    sums: DataFrame | None = None,
) -> DataFrame:
    """One record per file.

    ``files``: path, length, and content where checksums are to be taken of cells. Without that column
    the files are read in pieces by the tasks (:func:`catalens.sources.checksums.checksums`), which is
    the way for files beyond 2 GiB; ``sums`` (path, sha1, md5) are checksums taken before. ``exif``: path, exif_ok,
    raw and tag columns (:func:`catalens.sources.dumps.exif_table`). ``mime_fallback``: path,
    mimetype. Each has at most one row per path.

    Checksums are taken in the scan, so contents never enter a shuffle; without them they are
    not read at all. All joins are on the path and share one partitioning of the files. A file whose
    content cannot be read has no checksums and an ``error``.
    """
    kinds = ("sha1", "md5")
    in_cells = []
    if checksums and sums is None:
        if "content" in files.columns:
            in_cells = [inventory.checksum(c("content"), a).alias(a) for a in kinds]
        else:
            sums = piecewise.checksums(files, kinds)
    base = files.select("path", c("length").alias("size"), *in_cells)
    unread = F.lit(None).cast("string")
    if checksums and sums is not None:
        if "checksum_error" in sums.columns:
            unread = c("checksum_error")
        base = base.join(sums, "path", "left")
    feed = mime_fallback.select("path", c("mimetype").alias("fallback_mimetype"))
    joined = base.join(exif, "path", "left").join(feed, "path", "left")
    sums_of = kinds if checksums else ()
    return described(joined, "path", "size", *sums_of, unread=unread, raw="raw" in exif.columns)


def described(
    joined: DataFrame, path: str, *kept: str, unread: Column | None = None, raw: bool = False
) -> DataFrame:
    """Record per row of files with their tags and secondary MIME types, a table or a stream.

    Columns ``path``, then ``raw`` if asked for, then ``kept``, the record, ``error``.
    """
    joined = with_facts(with_fallback(joined))
    ok = F.coalesce(c("exif_ok"), F.lit(False))
    unreadable = F.when(
        ~ok & c("fallback_mimetype").isNull(), F.lit("Neither tags nor MIME type could be read")
    )
    raws = []
    if raw:
        placeholder = F.to_variant_object(
            F.struct(c("MIMEType").alias("MIMEType"), c("FileName").alias("FileName"))
        )
        raws = [F.when(ok, c("raw")).otherwise(placeholder).alias("raw")]
    errors = [unreadable, record_error(), *([unread] if unread is not None else [])]
    return joined.select(path, *raws, *kept, *record_columns(), F.coalesce(*errors).alias("error"))
