"""Names of people taken from file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens.functions import keys


def name_from_file(path: Column) -> Column:
    """``people/Ann Lee.jpg`` -> ``Ann Lee``: one file per person."""
    return F.regexp_replace(keys.base_name(path), r"(?<!^)\.[^.]*$", "")


def name_from_folder(path: Column) -> Column:
    """``train/Ann Lee/1.jpg`` -> ``Ann Lee``: one folder per person."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))
