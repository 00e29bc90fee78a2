"""Tag dumps (JSON text per media file) and the secondary MIME feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.functions import dates
from catalens.sources import quoted_csv

# Bulky tags never kept.
HEAVY_TAGS = [
    "DataDump",
    "ThumbnailImage",
    "Directory",
    "FilePermissions",
    "TextJunk",
    "ColorBalanceUnknown",
    "Warning",
]

# Tags that are read, with the type they are read as. "id" is text of which a
# numeric zero counts as empty; "exact" is a number only if written as one.
TAGS = {
    "MIMEType": "text",
    "FileName": "text",
    "Model": "id",
    "DeviceModelName": "text",
    "Make": "id",
    "DeviceManufacturer": "text",
    "FileNumber": "text",
    "ImageWidth": "int",
    "ImageHeight": "int",
    "FrameRate": "double",
    "VideoFrameRate": "double",
    "ISO": "double",
    "ExposureTime": "double",
    "FrameCount": "bigint",
    "LtcChangeTableLtcChangeFrameCount": "bigint",
    "Duration": "double",
    "SerialNumber": "id",
    "InternalSerialNumber": "id",
    "DeviceSerialNo": "id",
    "GPSLongitude": "double",
    "GPSLatitude": "double",
    "GPSAltitude": "double",
    "GPSDOP": "exact",
    "Country": "text",
    "State": "text",
    "City": "text",
    "Landmark": "text",
    "GPSAreaInformation": "text",
    "GPSDateTime": "text",
    "DateTimeOriginal": "text",
    "CreationDateValue": "text",
    "CreateDate": "text",
    "CreationDate": "text",
    "Orientation": "exact",
    "Compression": "text",
    "ImageSize": "text",
}


def read_dumps(spark: SparkSession, root: str, whole_files: bool = False) -> DataFrame:
    """Dump texts ``dump``: one per line (splittable), or one per file."""
    return spark.read.text(root, wholetext=whole_files).select(F.col("value").alias("dump"))


# A dump is JSON in the strict sense, or it is malformed.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# Kinds that depend on how a value was written; all others are read as text and cast.
_WRITTEN = ("id", "exact")


def parse_dump(dump: Column, tags: list[str] | None = None) -> Column:
    """First object of a dump as a struct of the tags asked for, nothing else being parsed.

    NULL if the text is malformed or holds no object. Values are text, or VARIANT where it
    matters how they were written; see :func:`tag_columns`.
    """
    fields = {t: "variant" if TAGS.get(t) in _WRITTEN else "string" for t in tags or TAGS}
    schema = ", ".join(f"`{t}`: {kind}" for t, kind in fields.items())
    return _first(dump, f"struct<{schema}>")


def _first(dump: Column, schema: str) -> Column:
    """First element of a list. The parser would pass over what follows its end."""
    ends_as_list = F.rtrim(dump, F.lit(" \t\r\n")).endswith("]")
    whole = F.when(ends_as_list, dump)
    return F.get(F.from_json(whole, f"array<{schema}>", _STRICT), F.lit(0))


def _tag(value: Column, kind: str) -> Column:
    if kind == "text":
        return value
    if kind in _WRITTEN:
        is_text = F.schema_of_variant(value) == "STRING"
        number = F.try_variant_get(value, "$", "double")
        if kind == "exact":
            return F.when(~is_text, number)
        return F.when(~is_text & (number == 0), F.lit("")).otherwise(
            F.try_variant_get(value, "$", "string")
        )
    return value.try_cast("double").try_cast(kind)


def tag_columns(parsed: str, tags: list[str] | None = None) -> list[Column]:
    """Typed columns of a parsed dump (a column name), cleaned of known oddities."""
    columns = []
    for tag in tags or TAGS:
        value = _tag(F.col(f"{parsed}.{tag}"), TAGS[tag])
        if tag == "DateTimeOriginal":
            value = dates.drop_blank(value)
        elif tag == "ImageSize":
            value = image_size_text(value)
        columns.append(value.alias(tag))
    return columns


def image_size_text(c: Column) -> Column:
    """``350 150`` -> ``350x150``."""
    return F.regexp_replace(c, " ", "x")


def light_tags(dump: Column) -> Column:
    """All tags of the first object but the bulky ones, as MAP<STRING, VARIANT>."""
    tags = _first(dump, "map<string, variant>")
    return F.map_filter(tags, lambda k, _: ~k.isin(HEAVY_TAGS))


def clean_tags(tags: Column) -> Column:
    """The same oddities removed as in the typed columns: blank dates, spaces in sizes."""
    def text(v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    dated = F.map_filter(
        tags,
        lambda k, v: ~((k == "DateTimeOriginal") & text(v).eqNullSafe(F.lit(dates.BLANK_DATE))),
    )
    return F.transform_values(
        dated,
        lambda k, v: F.when(
            (k == "ImageSize") & F.contains(text(v), F.lit(" ")),
            image_size_text(text(v)).cast("variant"),
        ).otherwise(v),
    )


def exif_table(dumps: DataFrame, path: str = "SourceFile", keep: tuple[str, ...] = ()) -> DataFrame:
    """Dump texts -> ``path``, ``raw`` (VARIANT without bulky tags) and the typed tags.

    Columns of the table named in ``keep`` come first.

    The media path is the dump's own ``SourceFile`` tag unless the table has a column of the
    name given. A malformed dump keeps its row, with ``exif_ok`` false and its text in
    ``bad_dump``; so does a dump that names no file.
    """
    own = path not in dumps.columns
    tags = [*([path] if own else []), *TAGS]
    parsed = dumps.withColumn("_tags", parse_dump(F.col("dump"), tags))
    named = parsed.withColumn("path", F.col(f"_tags.{path}") if own else F.col(path))
    return named.select(
        *keep,
        "path",
        F.to_variant_object(clean_tags(light_tags(F.col("dump")))).alias("raw"),
        F.col("_tags").isNotNull().alias("exif_ok"),
        F.when(F.col("_tags").isNull() | F.col("path").isNull(), F.col("dump")).alias("bad_dump"),
        *tag_columns("_tags"),
    )


def _narrow(dumps: DataFrame, tags: list[str]) -> DataFrame:
    parsed = dumps.withColumn("_tags", parse_dump(F.col("dump"), tags))
    return parsed.select("path", *tag_columns("_tags", tags))


def mime_of_dump(dumps: DataFrame) -> DataFrame:
    """Only the MIME type of each dump."""
    return _narrow(dumps, ["MIMEType"])


def size_of_dump(dumps: DataFrame) -> DataFrame:
    """Only the picture size of each dump."""
    return _narrow(dumps, ["ImageWidth", "ImageHeight"])


def read_mime_feed(spark: SparkSession, root: str, range_bytes: int = quoted_csv.RANGE_BYTES) -> DataFrame:
    """Secondary MIME types: CSV ``path,mimetype``, stray line breaks removed.

    Quotes within a value are doubled. A file is read by as many tasks as it has ranges.
    """
    feed = quoted_csv.read_quoted(spark, root, ["path", "mimetype"], range_bytes)
    return feed.select("path", clean_mime(F.col("mimetype")).alias("mimetype"))


def clean_mime(c: Column) -> Column:
    return F.regexp_replace(c, "\n", "")
