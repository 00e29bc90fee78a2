"""Rendition keys: the file name under which a rendition of an id is stored."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens.functions import js, mime

# Fixed value: layout of a key (id, width, height, square, angle, mirror, extension).
KEY_PATTERN = r"^(.*?)_w(.*?)_h(.*?)_s(.*?)_a(.*?)_m(.*?)\.(.*?)\z"

# Rotations that may be asked for, and the message for any other.
ROTATIONS = [90, 180, 270]
ID_ERROR = "Missing id"
SIZE_ERROR = "Sizes are whole numbers, not "
ANGLE_ERROR = "Valid angle values are: -270, -180, -90, 90, 180 and 270"


def rotation(parsed: Column) -> Column:
    """Parsed angle -> INT; NULL when absent, zero, not a number or not allowed."""
    return F.when(F.abs(parsed).isin(ROTATIONS), parsed.cast("int"))


def rotation_error(parsed: Column) -> Column:
    return F.when(~F.abs(parsed).isin([0, *ROTATIONS]), F.lit(ANGLE_ERROR))


def normalise_angle(angle: Column) -> Column:
    """Requested angle text -> INT; NULL when absent, zero, not a number or not allowed."""
    return rotation(js.parse_int(angle))


def angle_error(angle: Column) -> Column:
    return rotation_error(js.parse_int(angle))


def build_key(
    id_: Column, type_: Column, width: Column, height: Column, angle: Column, mirror: Column
) -> Column:
    """Key of a rendition; NULL for an unknown type.

    ``angle`` is the normalised one. The square flag compares the sizes as asked for,
    before a missing one is printed as 0: both missing is square, 0 and missing is not.
    -90 and 270 stay different keys.
    """
    key = F.concat(
        id_.cast("string"),
        F.lit("_w"), F.coalesce(width, F.lit(0)).cast("string"),
        F.lit("_h"), F.coalesce(height, F.lit(0)).cast("string"),
        F.lit("_s"), F.when(width.eqNullSafe(height), F.lit("1")).otherwise("0"),
        F.lit("_a"), F.coalesce(angle, F.lit(0)).cast("string"),
        F.lit("_m"), F.when(js.truthy_text(mirror), F.lit("1")).otherwise("0"),
        F.lit("."), F.coalesce(mime.extension_of_type(type_), F.lit("")),
    )
    return F.when(mime.type_error(type_).isNull(), key)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_key(name: Column) -> Column:
    """Key -> struct(type, width, height, angle, mirror, error).

    Takes the name without its directory, so that a folder called ``x_w1_h1`` cannot
    change the outcome.
    """
    # One match gives all parts; the separator is in no file name.
    marked = F.regexp_replace(name, KEY_PATTERN, "\x00".join(f"${n}" for n in range(1, 8)))
    split = F.split(marked, "\x00")
    return F.get(F.transform(F.array(split), _parsed), F.lit(0))


def _parsed(parts: Column) -> Column:
    def part(group: int) -> Column:
        return F.when(F.size(parts) == 7, F.get(parts, F.lit(group - 1)))

    extension = part(7)
    matched = F.coalesce(F.size(parts) == 7, F.lit(False))
    return F.struct(
        F.when(matched, mime.type_of_extension(extension)).alias("type"),
        js.parse_int(part(2)).try_cast("int").alias("width"),
        js.parse_int(part(3)).try_cast("int").alias("height"),
        js.parse_int(part(5)).try_cast("int").alias("angle"),
        F.when(matched, F.coalesce(js.parse_int(part(6)) == 1, F.lit(False))).alias("mirror"),
        F.when(~matched, F.lit("Not a rendition key"))
        .otherwise(mime.extension_error(extension))
        .alias("error"),
    )


def id_of_key(name: Column) -> Column:
    """Text before the first underscore: an id that holds one itself is never found."""
    return F.substring_index(name, "_", 1)


def has_extension(name: Column, extension: Column) -> Column:
    """True without an extension to look for, or if the name ends in it."""
    return ~js.truthy_text(extension) | name.endswith(F.concat(F.lit("."), extension))


def path_in(folder: str, name: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)
