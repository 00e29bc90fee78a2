"""Dates as the tag tool prints them: parsed into parts, never into an instant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens.functions import js

# Fixed value: date with ':' or '/' separators, optional fraction (dropped), optional zone.
DATE_PATTERN = (
    r"([0-9]{4})[:/]([0-9]{2})[:/]([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})"
    r"(?:\.[0-9]+)?([\+|\-|Z].*)?"
)
# Texts that stand for "no date".
BLANK_DATE = "    :  :     :  :  "
ZERO_GPS_DATE = "0000:00:00 00:00:00Z"

DATE_PARTS = ["year", "month", "day", "hour", "minute", "second"]


def find_date(text: Column) -> Column:
    """The part of the text that is a date; '' if there is none, NULL for a missing text."""
    return F.regexp_extract(text, DATE_PATTERN, 0)


def split_date(found: Column) -> Column:
    """What :func:`find_date` gives -> struct(year .. second, timezone), all STRING.

    All parts but the last have a fixed place, so the pattern is matched only once.
    """
    starts = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2)}
    starts["second"] = (18, 2)
    parts = [F.substring(found, *starts[p]).alias(p) for p in DATE_PARTS]
    zone = F.regexp_replace(F.substr(found, F.lit(20)), r"^\.[0-9]+", "")
    timezone = F.when(zone == "Z", F.lit("+00:00")).otherwise(F.nullif(zone, F.lit("")))
    return F.when(found != "", F.struct(*parts, timezone.alias("timezone")))


def parse_date(text: Column) -> Column:
    """Text -> struct of date parts; NULL if it does not hold a date."""
    return split_date(find_date(text))


def date_error(text: Column, found: Column) -> Column:
    """Message for a date that is present but cannot be parsed."""
    bad = js.truthy_text(text) & (found == "")
    return F.when(bad, F.concat(F.lit("Unparsable date, "), text))


def drop_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(BLANK_DATE))
