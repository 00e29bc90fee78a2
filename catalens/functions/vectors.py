"""Distances between encodings, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two ARRAY<DOUBLE>."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def as_doubles(encoding: Column) -> Column:
    return encoding.cast("array<double>")
