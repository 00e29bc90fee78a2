"""MIME groups, media types, and the extension each type is stored under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The MIME types of each group. A type may be in several groups.
MIME_GROUPS: dict[str, list[str]] = {
    "rawimage": [
        "image/x-canon-cr2",
        "image/x-raw",
        "image/x-canon-crw",
        "image/x-nikon-nef",
        "image/CR2",
        "image/x-panasonic-rw2",
        "image/x-fujifilm-raf",
    ],
    "image": [
        "image/jpeg",
        "image/gif",
        "image/tiff",
        "image/png",
        "image/bmp",
        "image/x-canon-cr2",
        "image/x-raw",
        "image/x-canon-crw",
        "image/x-nikon-nef",
        "image/CR2",
        "image/x-panasonic-rw2",
        "image/x-fujifilm-raf",
    ],
    "video": [
        "video/mpeg",
        "video/avi",
        "video/quicktime",
        "video/x-ms-wmv",
        "video/mp4",
        "video/3gpp",
        "video/x-msvideo",
        "video/m2ts",
        "video/x-matroska",
        "video/x-m4v",
    ],
    "audio": [
        "audio/mpeg",
        "audio/x-wav",
        "audio/x-m4a",
        "audio/mp4",
    ],
    "pdf": [
        "application/pdf",
    ],
    "document": [
        "application/json",
        "application/pdf",
        "text/plain",
        "text/html",
        "application/xml",
        "application/vnd.ms-excel",
        "application/msword",
        "application/vnd.ms-powerpoint",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.oasis.opendocument.text",
        "application/vnd.oasis.opendocument.spreadsheet",
        "application/vnd.oasis.opendocument.presentation",
    ],
    "msdocument": [
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ],
}

# Media types in the order in which they are tried.
MEDIA_TYPES = ["image", "video", "audio", "document"]

# Stored extension of a rendition type, and the way back.
EXTENSION_BY_TYPE = {"image": "jpg", "video": "webm", "audio": "webm", "document": "pdf"}
TYPE_BY_EXTENSION = {"jpg": "image", "webm": "video", "pdf": "document"}

# Asks for any type: it has no extension.
ANY_TYPE = "*"


def in_group(mimetype: Column, group: str) -> Column:
    return F.coalesce(mimetype.isin(MIME_GROUPS[group]), F.lit(False))


def is_raw_image(mimetype: Column) -> Column:
    return in_group(mimetype, "rawimage")


def is_image(mimetype: Column) -> Column:
    return in_group(mimetype, "image")


def is_video(mimetype: Column) -> Column:
    return in_group(mimetype, "video")


def is_audio(mimetype: Column) -> Column:
    return in_group(mimetype, "audio")


def is_pdf(mimetype: Column) -> Column:
    return in_group(mimetype, "pdf")


def is_document(mimetype: Column) -> Column:
    return in_group(mimetype, "document")


def is_ms_document(mimetype: Column) -> Column:
    return in_group(mimetype, "msdocument")


def media_type(mimetype: Column) -> Column:
    """First media type whose group holds the MIME type, else ``other``."""
    found = [F.when(in_group(mimetype, t), F.lit(t)) for t in MEDIA_TYPES]
    return F.coalesce(*found, F.lit("other"))


def _mapped(c: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])


def extension_of_type(type_: Column) -> Column:
    """jpg, webm or pdf; NULL for ``*`` and for an unknown type."""
    return _mapped(type_, EXTENSION_BY_TYPE)


def type_error(type_: Column) -> Column:
    known = F.coalesce(type_.isin([*EXTENSION_BY_TYPE, ANY_TYPE]), F.lit(False))
    return F.when(
        ~known, F.concat(F.lit("Unknown format type, "), F.coalesce(type_, F.lit("undefined")))
    )


def type_of_extension(extension: Column) -> Column:
    return _mapped(extension, TYPE_BY_EXTENSION)


def extension_error(extension: Column) -> Column:
    known = F.coalesce(extension.isin(list(TYPE_BY_EXTENSION)), F.lit(False))
    return F.when(
        ~known, F.concat(F.lit("Unknown extension, "), F.coalesce(extension, F.lit("undefined")))
    )


def strict(value: Column, error: Column) -> Column:
    """The value, or a failed job if the row carries an error."""
    return F.when(error.isNull(), value).otherwise(F.raise_error(error))


def mime_dimension(spark: SparkSession) -> DataFrame:
    """The groups as a table ``(grp, mimetype)``; about fifty rows, safe to broadcast."""
    rows = [(g, m) for g, members in MIME_GROUPS.items() for m in members]
    return spark.createDataFrame(rows, "grp string, mimetype string")
