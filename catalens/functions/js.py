"""Truthiness, defaults and number parsing for loosely typed input.

Tags and requests come from tools and clients that do not declare types. A value
counts as present only if it is neither missing, zero, NaN nor the empty string,
and ``a or b`` yields ``b`` as it is, even when ``b`` is itself empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space skipped before a number.
_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*"
_INT_PREFIX = "^" + _SPACE + "([+-]?[0-9]+)"


def truthy_text(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def truthy_number(c: Column) -> Column:
    d = c.cast("double")
    return F.coalesce((d != 0) & ~F.isnan(d), F.lit(False))


def or_text(a: Column, b: Column) -> Column:
    return F.when(truthy_text(a), a).otherwise(b)


def or_number(a: Column, b: Column) -> Column:
    return F.when(truthy_number(a), a).otherwise(b)


def parse_int(c: Column) -> Column:
    """Leading integer of a text as DOUBLE, NULL if there is none.

    DOUBLE and not INT: any number of digits is a number, so an absurdly long one
    must fail a later range check instead of looking missing.
    """
    digits = F.regexp_extract(c, _INT_PREFIX, 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def number_text(c: Column) -> Column:
    """A number as plain text: no exponent, no trailing zeros (12.0 -> 12)."""
    text = c.cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
