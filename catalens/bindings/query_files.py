"""Queries on files, MIME types, keys and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.bindings import views
from catalens.bindings.registry import query
from catalens.bindings.sql_views import in_group, media_type, with_views
from catalens.functions import dates, keys, mime
from catalens.operators import metadata
from catalens.sources import checksums, dumps, inventory, manifest, people, requests, store
from catalens.sources.shared import shared_folder

c = F.col


# --- sources ----------------------------------------------------------------------------


def _below(folder, name):
    """Path of a file in one of 64 folders."""
    return F.concat(F.lit(f"{folder}/"), F.hex(F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(64))), F.lit("/"), name)


def _written_files(spark, sf_dir):
    """Folder in which every document and page is a file."""
    folder = shared_folder(spark, "files")
    kind = F.when(c("mimetype") == "text/html", "page").otherwise("document")
    name = F.concat_ws("-", kind, c("id").cast("string"))
    store.write_files(views.files(spark, sf_dir).select(_below(folder, name).alias("path"), "content"))
    return folder


_WRITTEN = "(SELECT *, CASE WHEN mimetype = 'text/html' THEN 'page-' ELSE 'document-' END || id AS name FROM files)"


@query("s1_file_inventory", with_views(f"SELECT name, length FROM {_WRITTEN}", "files"))
def s1_file_inventory(spark, sf_dir):
    """Documents and pages written as files, and what their listing says."""
    listed = store.list_files(spark, _written_files(spark, sf_dir), ("name", "length"))
    return listed.select("name", "length")


@query("s1_file_sizes", with_views("SELECT path, length FROM files", "files"))
def s1_file_sizes(spark, sf_dir):
    return inventory.file_sizes(views.files(spark, sf_dir))


@query(
    "s2_exif_dump",
    with_views(
        """
SELECT path, exif_ok, "FileName", nullif("Model", '') AS "Model", "ImageWidth", "FrameCount", "ExposureTime",
  CAST("Orientation" AS DOUBLE) AS "Orientation",
  nullif("DateTimeOriginal", '    :  :     :  :  ') AS "DateTimeOriginal", replace("ImageSize", ' ', 'x') AS "ImageSize",
  NULL AS bad_dump
FROM dumped WHERE exif_ok
UNION ALL
SELECT NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  substr('[{"SourceFile":"' || path || '","FileName":"f' || id || '.jpg"', 1, 40) FROM dumped WHERE NOT exif_ok""",
        "dumped",
    ),
)
def s2_exif_dump(spark, sf_dir):
    """Dumps written one per line, read back and parsed. One that was cut off keeps its text."""
    folder = shared_folder(spark, "dumps")
    views.dumps(spark, sf_dir).select(c("dump").alias("value")).write.text(folder)
    table = dumps.exif_table(dumps.read_dumps(spark, folder))
    return table.select(
        "path", "exif_ok", "FileName", F.nullif(c("Model"), F.lit("")).alias("Model"),
        "ImageWidth", "FrameCount", "ExposureTime", "Orientation", "DateTimeOriginal", "ImageSize",
        "bad_dump",
    )


@query(
    "s3_narrow_mime",
    with_views('SELECT path, CASE WHEN exif_ok THEN "MIMEType" END AS "MIMEType" FROM dumped', "dumped"),
)
def s3_narrow_mime(spark, sf_dir):
    return dumps.mime_of_dump(views.dumps(spark, sf_dir))


@query(
    "s3_narrow_size",
    with_views(
        """
SELECT path, CASE WHEN exif_ok THEN "ImageWidth" END AS "ImageWidth",
  CASE WHEN exif_ok THEN "ImageHeight" END AS "ImageHeight" FROM dumped""",
        "dumped",
    ),
)
def s3_narrow_size(spark, sf_dir):
    return dumps.size_of_dump(views.dumps(spark, sf_dir))


@query("s4_secondary_mime", with_views("SELECT path, mimetype FROM mime_feed", "mime_feed"))
def s4_secondary_mime(spark, sf_dir):
    """The feed written as one CSV file, line breaks included, and read back in small ranges."""
    folder = shared_folder(spark, "mimes")
    feed = views.mime_feed(spark, sf_dir).coalesce(1)
    feed.write.options(quoteAll=True, escape='"').csv(folder)
    return dumps.read_mime_feed(spark, folder, range_bytes=16 * 1024)


_GROUP_ROWS = "\nUNION ALL ".join(
    f"SELECT '{g}' AS grp, unnest([{', '.join(repr(m) for m in members)}]) AS mimetype"
    for g, members in mime.MIME_GROUPS.items()
)


@query(
    "s5_mime_groups",
    with_views(
        f"""
SELECT grp, count(*) AS files FROM ({_GROUP_ROWS}) g
JOIN mimes ON exif_mimetype = mimetype GROUP BY grp""",
        "mimes",
    ),
)
def s5_mime_groups(spark, sf_dir):
    groups = F.broadcast(mime.mime_dimension(spark))
    typed = views.mimes(spark, sf_dir).select(c("exif_mimetype").alias("mimetype"))
    return typed.join(groups, "mimetype").groupBy("grp").agg(F.count("*").alias("files"))


@query("s6_cache_listing", with_views("SELECT '/cache/' || name AS filepath, name FROM cached", "cached"))
def s6_cache_listing(spark, sf_dir):
    """Stored renditions written as files and listed by name."""
    folder = shared_folder(spark, "renditions")
    name = c("name")
    rows = views.cached(spark, sf_dir).select(_below(folder, name).alias("path"), F.encode(name, "UTF-8").alias("content"))
    store.write_files(rows)
    found = inventory.read_listing(spark, folder)
    # The folder is new each time; the rest of the path must be what was written.
    whole = c("filepath") == _below(folder, c("name"))
    return found.select(F.when(whole, F.concat(F.lit("/cache/"), name)).alias("filepath"), "name")


@query(
    "s7_request_source",
    with_views(
        """
SELECT request_id, CAST(id AS VARCHAR) AS id, filename, type, width, height, size_error, angle_text AS angle,
  mirror, CASE WHEN timeindex <> 0 THEN '12.5' END AS timeindex, deinterlace FROM (
    SELECT * REPLACE (CASE WHEN request_id % 11 = 5 AND width > 0 THEN NULL ELSE width END AS width),
      CASE WHEN request_id % 11 = 5 AND width > 0 THEN 'Sizes are whole numbers, not ' || width || '.5' END AS size_error
    FROM requests)""",
        "requests",
    ),
)
def s7_request_source(spark, sf_dir):
    """Requests written as JSON lines and read back; sizes come as numbers, text and fractions."""
    folder = shared_folder(spark, "requests")
    n, width = c("request_id"), c("width")
    fraction = (n % 11 == 5) & (width > 0)
    loose = (
        F.when(fraction, (width + F.lit(0.5)).cast("string").cast("variant"))
        .when(n % 3 == 0, width.cast("string").cast("variant"))
        .otherwise(width.cast("variant"))
    )
    views.requests(spark, sf_dir).withColumn("width", loose).write.json(folder)
    return requests.read_requests(spark, folder).drop("ts")


@query(
    "s8_people_folders",
    with_views(
        """
SELECT path, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS by_file,
  CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] END AS by_folder
FROM (SELECT path FROM files UNION ALL SELECT path FROM media)""",
        "files", "media",
    ),
)
def s8_people_folders(spark, sf_dir):
    paths = views.files(spark, sf_dir).select("path").unionByName(
        views.media(spark, sf_dir).select("path")
    )
    return paths.select(
        "path",
        people.name_from_file(c("path")).alias("by_file"),
        people.name_from_folder(c("path")).alias("by_folder"),
    )


@query(
    "s9_manifest_sink",
    with_views(
        """
SELECT DISTINCT name, filepath, CAST(id AS VARCHAR) AS id, coalesce(width, 0) AS width,
  coalesce(height, 0) AS height, coalesce(angle, 0) AS angle, coalesce(mirror <> '', false) AS mirror,
  CASE WHEN type = '*' THEN 'Unknown extension, ' END AS error,
  CASE type WHEN 'audio' THEN 'video' WHEN '*' THEN NULL ELSE type END AS type
FROM keyed WHERE error IS NULL AND request_id // 8 % 2 = 0""",
        "keyed",
    ),
)
def s9_manifest_sink(spark, sf_dir):
    """Stored renditions appended in two batches, one of them again, then put together and read back."""
    folder = shared_folder(spark, "manifest")
    rows = manifest.manifest_rows(views.cached(spark, sf_dir))
    manifest.write_manifest(rows.where("type = 'image'"), folder, "images")
    for _ in range(2):
        manifest.write_manifest(rows, folder, "all")
    manifest.compact(spark, folder, "together")
    return manifest.read_manifest(spark, folder).drop("bucket")


# --- MIME and keys ----------------------------------------------------------------------


@query("p1_media_type", with_views(f"SELECT id, {media_type('exif_mimetype')} AS type FROM mimes", "mimes"))
def p1_media_type(spark, sf_dir):
    return views.mimes(spark, sf_dir).select(
        "id", mime.media_type(c("exif_mimetype")).alias("type")
    )


_FLAGS = {
    "p2_is_raw_image": ("rawimage", mime.is_raw_image),
    "p3_is_image": ("image", mime.is_image),
    "p4_is_video": ("video", mime.is_video),
    "p5_is_audio": ("audio", mime.is_audio),
    "p6_is_pdf": ("pdf", mime.is_pdf),
    "p7_is_document": ("document", mime.is_document),
    "p8_is_ms_document": ("msdocument", mime.is_ms_document),
}


def _flag_query(predicate):
    def run(spark, sf_dir):
        flag = predicate(c("exif_mimetype")).alias("flag")
        return views.mimes(spark, sf_dir).select("id", "exif_mimetype", flag)

    return run


for _name, (_group, _predicate) in _FLAGS.items():
    query(
        _name,
        with_views(
            f"SELECT id, exif_mimetype, {in_group('exif_mimetype', _group)} AS flag FROM mimes",
            "mimes",
        ),
    )(_flag_query(_predicate))


@query(
    "p9_extension_of_type",
    with_views(
        """
SELECT request_id, type, CASE type WHEN 'image' THEN 'jpg' WHEN 'video' THEN 'webm'
  WHEN 'audio' THEN 'webm' WHEN 'document' THEN 'pdf' END AS extension,
  CASE WHEN type = 'sticker' THEN 'Unknown format type, sticker' END AS error
FROM requests""",
        "requests",
    ),
)
def p9_extension_of_type(spark, sf_dir):
    return views.requests(spark, sf_dir).select(
        "request_id",
        "type",
        mime.extension_of_type(c("type")).alias("extension"),
        mime.type_error(c("type")).alias("error"),
    )


@query(
    "p10_type_of_extension",
    with_views(
        """
SELECT name, extension, CASE extension WHEN 'jpg' THEN 'image' WHEN 'webm' THEN 'video'
  WHEN 'pdf' THEN 'document' END AS type,
  CASE WHEN extension NOT IN ('jpg', 'webm', 'pdf') THEN 'Unknown extension, ' || extension END AS error
FROM (SELECT name, string_split(name, '.')[-1] AS extension FROM cached)""",
        "cached",
    ),
)
def p10_type_of_extension(spark, sf_dir):
    extension = F.element_at(F.split("name", "\\."), -1)
    return (
        views.cached(spark, sf_dir)
        .select("name", extension.alias("extension"))
        .select(
            "name",
            "extension",
            mime.type_of_extension(c("extension")).alias("type"),
            mime.extension_error(c("extension")).alias("error"),
        )
    )


@query(
    "p11_build_key",
    with_views("SELECT request_id, name, filepath, error FROM keyed", "keyed"),
)
def p11_build_key(spark, sf_dir):
    return views.keyed(spark, sf_dir).select("request_id", "name", "filepath", "error")


@query(
    "p12_parse_key",
    with_views(
        """
SELECT DISTINCT name, CASE type WHEN 'audio' THEN 'video' WHEN '*' THEN NULL ELSE type END AS type,
  coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(angle, 0) AS angle,
  coalesce(mirror <> '', false) AS mirror, CASE WHEN type = '*' THEN 'Unknown extension, ' END AS error
FROM keyed WHERE error IS NULL AND request_id // 8 % 2 = 0""",
        "keyed",
    ),
)
def p12_parse_key(spark, sf_dir):
    parsed = keys.parse_key(c("name"))
    return views.cached(spark, sf_dir).select("name", parsed.alias("k")).select("name", "k.*")


@query(
    "p13_angle",
    with_views(
        """
SELECT request_id, angle_text AS asked, angle,
  CASE WHEN starts_with(error, 'Valid') THEN error END AS error FROM keyed""",
        "keyed",
    ),
)
def p13_angle(spark, sf_dir):
    return views.requests(spark, sf_dir).select(
        "request_id",
        c("angle").alias("asked"),
        keys.normalise_angle(c("angle")).alias("angle"),
        keys.angle_error(c("angle")).alias("error"),
    )


@query(
    "p14_id_filter",
    with_views(
        """
SELECT name, regexp_extract(name, '^[^_]*') AS id FROM cached
WHERE regexp_extract(name, '^[^_]*') IN (SELECT CAST(id AS VARCHAR) FROM asked_ids)""",
        "cached", "asked_ids",
    ),
)
def p14_id_filter(spark, sf_dir):
    wanted = views.asked_ids(spark, sf_dir).select(c("id").cast("string").alias("id"))
    listing = views.cached(spark, sf_dir).select("name", keys.id_of_key(c("name")).alias("id"))
    return listing.join(wanted, "id", "left_semi").select("name", "id")


@query(
    "p15_extension_filter",
    with_views(
        """
SELECT DISTINCT k.filename, k.type, s.name FROM keyed k JOIN cached s ON s.name = k.name
WHERE k.error IS NULL AND (k.type = '*' OR ends_with(s.name, '.' || CASE k.type WHEN 'image' THEN 'jpg'
  WHEN 'document' THEN 'pdf' ELSE 'webm' END))""",
        "keyed", "cached",
    ),
)
def p15_extension_filter(spark, sf_dir):
    asked = views.keyed(spark, sf_dir).where("error IS NULL").select("filename", "type", "name")
    extension = mime.extension_of_type(c("type"))
    both = asked.distinct().join(views.cached(spark, sf_dir).select("name"), "name")
    return both.where(keys.has_extension(c("name"), extension)).select("filename", "type", "name")


# --- tags and records -------------------------------------------------------------------


def _facts(spark, sf_dir):
    return metadata.with_facts(views.clean_exif(spark, sf_dir))


_LIGHT = [
    "FileName", "MIMEType", "Make", "DeviceManufacturer", "Model", "DeviceModelName", "SerialNumber",
    "InternalSerialNumber", "DeviceSerialNo", "FileNumber", "ImageWidth", "ImageHeight", "FrameRate",
    "VideoFrameRate", "ISO", "ExposureTime", "FrameCount", "LtcChangeTableLtcChangeFrameCount",
    "Duration", "Orientation", "GPSLongitude", "GPSLatitude", "GPSAltitude", "GPSDOP", "Country",
    "State", "City", "Landmark", "GPSAreaInformation", "GPSDateTime", "DateTimeOriginal",
    "CreationDateValue", "CreateDate", "CreationDate", "Compression", "ImageSize",
]


@query(
    "p16_light_tags",
    with_views(
        "SELECT path, CASE WHEN exif_ok THEN concat_ws(',', "
        + ", ".join(
            f"CASE WHEN \"{t}\" IS NOT NULL THEN '{t}' END" for t in sorted([*_LIGHT, "SourceFile"])
        )
        + ") END AS tags FROM (SELECT *, path AS \"SourceFile\" FROM dumped)",
        "dumped",
    ),
)
def p16_light_tags(spark, sf_dir):
    kept = F.map_keys(dumps.light_tags(c("dump")))
    return views.dumps(spark, sf_dir).select(
        "path", F.array_join(F.array_sort(kept), ",").alias("tags")
    )


@query(
    "p17_blank_date",
    with_views(
        """
SELECT id, nullif("DateTimeOriginal", '    :  :     :  :  ') AS "DateTimeOriginal" FROM exif""",
        "exif",
    ),
)
def p17_blank_date(spark, sf_dir):
    return views.exif(spark, sf_dir).select(
        "id", dates.drop_blank(c("DateTimeOriginal")).alias("DateTimeOriginal")
    )


@query(
    "p18_image_size",
    with_views("""SELECT id, replace("ImageSize", ' ', 'x') AS "ImageSize" FROM exif""", "exif"),
)
def p18_image_size(spark, sf_dir):
    return views.exif(spark, sf_dir).select(
        "id", dumps.image_size_text(c("ImageSize")).alias("ImageSize")
    )


_FIRST = """
  CASE WHEN "Model" <> '' THEN "Model" ELSE "DeviceModelName" END AS model,
  CASE WHEN "Make" <> '' THEN "Make" ELSE "DeviceManufacturer" END AS make,
  CASE WHEN "FrameRate" <> 0 THEN "FrameRate" ELSE "VideoFrameRate" END AS fps,
  CASE WHEN "FrameCount" <> 0 THEN "FrameCount" ELSE "LtcChangeTableLtcChangeFrameCount" END AS frames"""


@query(
    "p19_base_record",
    with_views(
        f"""
SELECT id, "FileName" AS name, {media_type('"MIMEType"')} AS type, "MIMEType" AS mimetype, {_FIRST},
  "FileNumber" AS number, "ImageWidth" AS width, "ImageHeight" AS height, "ISO" AS iso,
  "ExposureTime" AS exposure, "Duration" AS duration
FROM exif""",
        "exif",
    ),
)
def p19_base_record(spark, sf_dir):
    record = _facts(spark, sf_dir).select("id", *metadata.record_columns())
    return record.select("id", "name", "type", "mimetype", "deviceinfo.*", "fileinfo.*")


@query("p20_first_truthy", with_views(f"SELECT id, {_FIRST} FROM exif", "exif"))
def p20_first_truthy(spark, sf_dir):
    return views.exif(spark, sf_dir).select(
        "id",
        metadata.model().alias("model"),
        metadata.make().alias("make"),
        metadata.fps().alias("fps"),
        metadata.frames().alias("frames"),
    )


_SERIAL = """CASE WHEN "SerialNumber" <> '' THEN replace("SerialNumber", chr(0), '')
  WHEN "InternalSerialNumber" <> '' THEN replace("InternalSerialNumber", chr(0), '')
  WHEN "DeviceSerialNo" <> '' THEN "DeviceSerialNo" END"""


@query("p21_serial_number", with_views(f"SELECT id, {_SERIAL} AS serial FROM exif", "exif"))
def p21_serial_number(spark, sf_dir):
    return views.exif(spark, sf_dir).select("id", metadata.serial_number().alias("serial"))


# Tags with the classification that most record columns depend on.
_TYPED = f"""(SELECT *, type IN ('image', 'video') AS visual, coalesce(maker = 'Apple', false) AND type = 'video' AS vendor
FROM (SELECT *, {media_type('"MIMEType"')} AS type,
  CASE WHEN "Make" <> '' THEN "Make" ELSE "DeviceManufacturer" END AS maker,
  nullif("DateTimeOriginal", '    :  :     :  :  ') AS original FROM {{source}}))"""
_TYPED_EXIF = _TYPED.format(source="exif")
_ANGLE = """CASE WHEN visual AND NOT vendor AND "ImageHeight" < "ImageWidth" THEN
  CASE "Orientation" WHEN 8 THEN 90 WHEN 6 THEN 270 WHEN 3 THEN 180 END END"""
_RAW = f"""CASE WHEN type = 'image' THEN {in_group('"MIMEType"', 'rawimage')} END"""


@query(
    "p22_visual_fields",
    with_views(
        f"""
SELECT id, CASE WHEN visual THEN "ImageWidth" END AS width, CASE WHEN visual THEN "ImageHeight" END AS height,
  visual AS has_where, visual AS has_when FROM {_TYPED_EXIF}""",
        "exif",
    ),
)
def p22_visual_fields(spark, sf_dir):
    record = _facts(spark, sf_dir).select("id", *metadata.record_columns())
    return record.select(
        "id", "width", "height",
        c("where").isNotNull().alias("has_where"), c("when").isNotNull().alias("has_when"),
    )


@query("p23_vendor_branch", with_views(f"SELECT id, vendor FROM {_TYPED_EXIF}", "exif"))
def p23_vendor_branch(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", c("_vendor").alias("vendor"))


@query("p24_orientation_angle", with_views(f"SELECT id, {_ANGLE} AS angle FROM {_TYPED_EXIF}", "exif"))
def p24_orientation_angle(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", metadata.angle().alias("angle"))


@query("p25_raw_flag", with_views(f'SELECT id, {_RAW} AS "rawImage" FROM {_TYPED_EXIF}', "exif"))
def p25_raw_flag(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", metadata.raw_image().alias("rawImage"))


_LOCATED = """visual AND "GPSLongitude" <> 0 AND "GPSLatitude" <> 0 AND (vendor OR "GPSDOP" IS DISTINCT FROM 0)"""
_GPS = f"""
  CASE WHEN {_LOCATED} THEN "GPSLongitude" END AS longitude,
  CASE WHEN {_LOCATED} THEN "GPSLatitude" END AS latitude,
  CASE WHEN {_LOCATED} THEN "GPSAltitude" END AS altitude,
  CASE WHEN {_LOCATED} AND NOT vendor THEN "Country" END AS country,
  CASE WHEN {_LOCATED} AND NOT vendor THEN "State" END AS state,
  CASE WHEN {_LOCATED} AND NOT vendor THEN "City" END AS city,
  CASE WHEN {_LOCATED} AND NOT vendor THEN replace("Landmark", '---', '') END AS landmark,
  CASE WHEN {_LOCATED} AND NOT vendor THEN "GPSAreaInformation" END AS area"""


@query("p26_gps", with_views(f"SELECT id, {_GPS} FROM {_TYPED_EXIF}", "exif"))
def p26_gps(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", metadata.gps().alias("gps")).select("id", "gps.*")


# Fixed value: the pattern of dates, as in catalens.functions.dates.
_DATE = (
    r"([0-9]{4})[:/]([0-9]{2})[:/]([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?([\+|\-|Z].*)?"
)


def _date_part(text: str, i: int) -> str:
    return f"nullif(regexp_extract({text}, '{_DATE}', {i}), '')"


def _date_columns(text: str, prefix: str = "") -> str:
    parts = [
        f"{_date_part(text, i + 1)} AS {prefix}{p}" for i, p in enumerate(dates.DATE_PARTS)
    ]
    zone = _date_part(text, 7)
    return ", ".join([*parts, f"CASE {zone} WHEN 'Z' THEN '+00:00' ELSE {zone} END AS {prefix}timezone"])


_GPS_TIME = """CASE WHEN visual AND NOT vendor AND "GPSDateTime" NOT IN ('', '0000:00:00 00:00:00Z')
  AND "GPSDOP" IS DISTINCT FROM 0 THEN "GPSDateTime" END"""
_DEVICE_TIME = """CASE WHEN NOT visual THEN NULL WHEN vendor THEN nullif("CreationDate", '')
  ELSE coalesce(nullif(original, ''), nullif("CreationDateValue", ''), nullif("CreateDate", '')) END"""


def _date_error(text: str) -> str:
    return f"CASE WHEN NOT regexp_matches({text}, '{_DATE}') THEN 'Unparsable date, ' || {text} END"


@query(
    "p27_gps_time",
    with_views(
        f"""
SELECT id, {_date_columns("t")}, {_date_error("t")} AS error
FROM (SELECT id, {_GPS_TIME} AS t FROM {_TYPED_EXIF})""",
        "exif",
    ),
)
def p27_gps_time(spark, sf_dir):
    return (
        _facts(spark, sf_dir)
        .select("id", metadata.gps_time().alias("d"), metadata.gps_time_error().alias("error"))
        .select("id", "d.*", "error")
    )


@query(
    "p28_device_time",
    with_views(
        f"""
SELECT id, {_date_columns("t")}, {_date_error("t")} AS error,
  CASE WHEN ok THEN 'unknown' END AS "deviceType", CASE WHEN ok THEN false END AS "deviceAutoDst",
  CASE WHEN ok THEN 0 END AS "deviceUtcOffset"
FROM (SELECT *, regexp_matches(t, '{_DATE}') AS ok FROM (SELECT id, {_DEVICE_TIME} AS t FROM {_TYPED_EXIF}))""",
        "exif",
    ),
)
def p28_device_time(spark, sf_dir):
    return (
        _facts(spark, sf_dir)
        .select("id", metadata.device_time().alias("d"), metadata.device_time_error().alias("error"))
        .select("id", "d.*", "error")
    )


@query(
    "p29_exif_date",
    with_views(
        f"""
SELECT id, {_date_columns('"GPSDateTime"', "gps_")}, {_date_columns('"DateTimeOriginal"', "original_")}
FROM exif_dates""",
        "exif_dates",
    ),
)
def p29_exif_date(spark, sf_dir):
    parts = [*dates.DATE_PARTS, "timezone"]
    parsed = views.exif_dates(spark, sf_dir).select(
        "id",
        dates.parse_date(c("GPSDateTime")).alias("g"),
        dates.parse_date(c("DateTimeOriginal")).alias("o"),
    )
    return parsed.select(
        "id",
        *[c(f"g.{p}").alias(f"gps_{p}") for p in parts],
        *[c(f"o.{p}").alias(f"original_{p}") for p in parts],
    )


@query(
    "p30_checksums_in_pieces",
    with_views(f"SELECT name, length, sha1(content) AS sha1, md5(content) AS md5 FROM {_WRITTEN}", "files"),
)
def p30_checksums_in_pieces(spark, sf_dir):
    """Sums of files that the tasks open, dealt to them by size and read a piece at a time."""
    listed = store.list_files(spark, _written_files(spark, sf_dir), ("path", "length"))
    sums = checksums.checksums(listed, chunk_bytes=4096)
    joined = listed.join(sums.where("checksum_error IS NULL"), "path", "left")
    return joined.select(keys.base_name(c("path")).alias("name"), "length", "sha1", "md5")


@query(
    "p30_checksums",
    with_views(
        "SELECT path, sha1(content) AS sha1, md5(content) AS md5, sha256(content) AS sha256 FROM files",
        "files",
    ),
)
def p30_checksums(spark, sf_dir):
    sums = [inventory.checksum(c("content"), a).alias(a) for a in ("sha1", "md5", "sha256")]
    return views.files(spark, sf_dir).select("path", *sums)


@query(
    "p31_mime_resolve",
    with_views(
        "SELECT id, CASE WHEN exif_ok THEN exif_mimetype ELSE fallback_mimetype END AS mimetype FROM mimes",
        "mimes",
    ),
)
def p31_mime_resolve(spark, sf_dir):
    return views.mimes(spark, sf_dir).select(
        "id",
        metadata.resolve_mime(
            c("exif_ok"), c("exif_mimetype"), c("fallback_mimetype")
        ).alias("mimetype"),
    )


_RECORDS = f"""(SELECT f.path, f.length AS size, f.content, m.mimetype AS fallback, coalesce(d.exif_ok, false) AS ok, d.* EXCLUDE
  (path, exif_ok, "MIMEType", "FileName"),
  CASE WHEN d.exif_ok THEN d."MIMEType" ELSE m.mimetype END AS "MIMEType",
  CASE WHEN d.exif_ok THEN d."FileName" ELSE 'unknown_filename' END AS "FileName"
FROM files f LEFT JOIN (SELECT path, exif_ok, {', '.join(f'CASE WHEN exif_ok THEN "{t}" END AS "{t}"' for t in _LIGHT)} FROM dumped) d ON f.path = d.path
LEFT JOIN mime_feed m ON f.path = m.path)"""
_TYPED_RECORDS = _TYPED.format(source=_RECORDS)


@query(
    "p32_fallback_record",
    with_views(
        f"""
SELECT path, size, "FileName" AS name, "MIMEType" AS mimetype, type,
  CASE WHEN NOT ok AND fallback IS NULL THEN 'Neither tags nor MIME type could be read' END AS error
FROM {_TYPED_RECORDS}""",
        "files", "dumped", "mime_feed",
    ),
)
def p32_fallback_record(spark, sf_dir):
    records = _metadata(spark, sf_dir, checksums=False)
    # Dates are the concern of another query: keep the message about unreadable files only.
    return records.select(
        "path", "size", "name", "mimetype", "type",
        F.when(c("error").startswith("Neither"), c("error")).alias("error"),
    )


def _metadata(spark, sf_dir, checksums):
    feed = views.mime_feed(spark, sf_dir)
    return metadata.metadata(
        views.files(spark, sf_dir),
        dumps.exif_table(views.dumps(spark, sf_dir), "path"),
        feed.select("path", dumps.clean_mime(c("mimetype")).alias("mimetype")),
        checksums,
    )


@query(
    "metadata_get",
    with_views(
        f"""
SELECT path, size, sha1(content) AS sha1, md5(content) AS md5, "FileName" AS name, type, "MIMEType" AS mimetype, {_FIRST},
  "Duration" AS duration, {_SERIAL} AS serial, {_ANGLE} AS angle, {_RAW} AS "rawImage", {_GPS},
  {_date_columns("gps_time", "gps_")}, {_date_columns("device_time", "device_")},
  coalesce(CASE WHEN NOT ok AND fallback IS NULL THEN 'Neither tags nor MIME type could be read' END,
    {_date_error("gps_time")}, {_date_error("device_time")}) AS error
FROM (SELECT *, {_GPS_TIME} AS gps_time, {_DEVICE_TIME} AS device_time FROM {_TYPED_RECORDS})""",
        "files", "dumped", "mime_feed",
    ),
)
def metadata_get(spark, sf_dir):
    parts = [*dates.DATE_PARTS, "timezone"]
    return _metadata(spark, sf_dir, checksums=True).select(
        "path", "size", "sha1", "md5", "name", "type", "mimetype", "deviceinfo.*",
        "fileinfo.fps", "fileinfo.frames", "fileinfo.duration",
        c("deviceSerialNumber").alias("serial"), "angle", "rawImage", "where.gps.*",
        *[c(f"when.gps.{p}").alias(f"gps_{p}") for p in parts],
        *[c(f"when.device.{p}").alias(f"device_{p}") for p in parts],
        "error",
    )
