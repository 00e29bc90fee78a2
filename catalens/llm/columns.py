"""Column expressions shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what stands between these characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def total(values: Column) -> Column:
    """Sum of an array of long values."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
