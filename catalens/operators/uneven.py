"""Joins in which one key may hold a large part of the left rows.

The runtime splits an over-full partition of a sort-merge join, but only where both sides
come straight from a shuffle. A right side that was just made unique by the join key keeps
that partitioning, is joined without another shuffle, and so takes the split away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def apart(*key: str) -> Column:
    """Hash to group by next to the key, so that the join has to shuffle the unique rows.

    They are few next to the left rows; that shuffle is what keeps the join splittable.
    """
    return F.xxhash64(*key).alias("_apart")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key, ready to be the right side of a join on it."""
    return rows.select(key, apart(key)).distinct().select(key)
