"""Distances in bulk: cells of known encodings, and close pairs of two groups of encodings.

A distance by array functions takes about ten microseconds in the JVM, as part of a matrix
product about ten nanoseconds; Spark does the partitioning, Arrow hands over the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F

from catalens.shipping import ship_by_value

ship_by_value(__name__)
c = F.col

# Relative slack on pruning bounds, far above rounding error.
SLACK = 1e-9
# Rows of a group compared at a time, entries of their product, and candidates that differences decide.
TILE = 512
ENTRIES = 1 << 20
CANDIDATES = 1 << 14
# Pairs that a group hands on at a time.
PAIRS = 1 << 16


def matrix(encodings: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Encodings of equal length, none of them NULL, as rows of a matrix."""
    if isinstance(encodings, pa.ChunkedArray):
        encodings = encodings.combine_chunks()
    values = encodings.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(encodings), -1)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of every row to each of a few points, from differences (no cancellation)."""
    result = np.empty((len(rows), len(points)))
    for i, point in enumerate(points):
        result[:, i] = np.sqrt(np.square(rows - point).sum(axis=1))
    return result


def is_usable(encoding: Column) -> Column:
    """An encoding without gaps; one with a NULL or NaN is near nothing."""
    return F.forall(encoding, lambda v: v.isNotNull() & ~F.isnan(v))


def same_length(least: int, most: int) -> None:
    if least != most:
        raise ValueError(f"known encodings have between {least} and {most} components")


class CellIndex:
    """Centres picked from known encodings, and the radius of the cell around each."""

    def __init__(self, centres: np.ndarray, people: int):
        self.centres = centres
        self.people = people
        self.radii = np.full(len(centres), -np.inf)
        self.members = np.zeros(len(centres), dtype=int)

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    @classmethod
    def of(cls, known: DataFrame, most: int) -> CellIndex | None:
        """About the square root of the number of encodings as cells, at most ``most``.

        ``known``: usable encodings.

        Centres are picked by hash. Which ones they are affects the speed of a match, never
        its result. None if nobody is known; an error if encodings differ in length.
        """
        # One pass counts the encodings and picks the centres.
        seen = Observation("known encodings")
        size = F.size("encoding")
        counted = known.select("encoding").observe(
            seen, F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most")
        )
        picked = counted.orderBy(F.xxhash64("encoding"), "encoding").limit(most).collect()
        if not picked:
            return None
        same_length(seen.get["least"], seen.get["most"])
        wanted = min(most, int(np.ceil(np.sqrt(seen.get["n"]))))
        centres = np.unique(np.array([r[0] for r in picked[:wanted]], dtype=float), axis=0)
        index = cls(centres, seen.get["n"])
        near = known.select(index.nearest()("encoding").alias("n"))
        for cell, radius, n in near.groupBy("n.cell").agg(F.max("n.d"), F.count("*")).collect():
            index.radii[cell], index.members[cell] = radius, n
        return index

    def bundles(self, most: int) -> np.ndarray:
        """Ascending number of each cell's bundle: as many cells in a row as ``most`` people fill, or one cell."""
        numbers, held = [0], int(self.members[0])
        for n in self.members[1:].tolist():
            full = held + n > most
            held = n if full else held + n
            numbers.append(numbers[-1] + full)
        return np.array(numbers)

    def nearest(self) -> Callable[[Column], Column]:
        """Column function: encoding -> struct(cell, d)."""
        centres = self.centres

        @F.arrow_udf("struct<cell:int,d:double>")
        def nearest_cell(encodings: pa.Array) -> pa.Array:
            d = distances(matrix(encodings), centres)
            cell = d.argmin(axis=1)
            return pa.StructArray.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())],
                names=["cell", "d"],
            )

        return nearest_cell

    def visited(self, tolerance: float) -> Callable[[Column], Column]:
        """Column function: encoding -> cells that may hold an encoding within the tolerance."""
        near = self._near(tolerance)

        @F.arrow_udf("array<int>")
        def visited_cells(encodings: pa.Array) -> pa.Array:
            return _lists(near(matrix(encodings)))

        return visited_cells

    def visited_bundles(self, tolerance: float, bundles: np.ndarray) -> Callable[[Column], Column]:
        """Column function: encoding -> struct(bundles, cells), ``cells`` a bit for each that is visited."""
        near, starts = self._near(tolerance), np.flatnonzero(np.diff(bundles, prepend=-1))

        @F.arrow_udf("struct<bundles:array<int>,cells:binary>")
        def visited(encodings: pa.Array) -> pa.Array:
            cells = near(matrix(encodings))
            bits = np.packbits(cells, axis=1)
            ends = np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]
            masks = pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(bits.tobytes())])
            lists = _lists(np.logical_or.reduceat(cells, starts, axis=1))
            return pa.StructArray.from_arrays([lists, masks], names=["bundles", "cells"])

        return visited

    def _near(self, tolerance: float) -> Callable[[np.ndarray], np.ndarray]:
        """Function: rows -> whether each visits each cell."""
        centres, radii = self.centres, self.radii

        def near(rows: np.ndarray) -> np.ndarray:
            d = distances(rows, centres)
            bound = np.minimum(radii + tolerance, d.min(axis=1, keepdims=True) + 2 * tolerance)
            return d <= bound + SLACK * (1 + np.abs(d))

        return near


def _lists(hits: np.ndarray) -> pa.Array:
    """Per row the numbers of the columns that are set."""
    row, column = np.nonzero(hits)
    ends = np.searchsorted(row, np.arange(len(hits) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column, pa.int32()))


def projection_buckets(
    dimensions: int, tables: int, bucket_length: float, seed: int
) -> Callable[[Column], Column]:
    """Column function: encoding -> bucket number in each of a few random projections.

    Close encodings fall into the same bucket of at least one projection with high
    probability, never with certainty.
    """
    directions = np.random.default_rng(seed).normal(size=(tables, dimensions))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)

    @F.arrow_udf("array<int>")
    def buckets(encodings: pa.Array) -> pa.Array:
        numbers = np.floor(matrix(encodings) @ directions.T / bucket_length)
        known = np.nan_to_num(numbers).astype(np.int32)
        offsets = np.arange(0, known.size + 1, tables, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(known.ravel()))

    return buckets


GROUP = ["cell", "chunk", "block"]


def cell_parts(faces: DataFrame, people: DataFrame, most: tuple[int, int]) -> DataFrame:
    """``cell, chunks, blocks`` of the cells that hold both faces and people.

    ``most``: faces and people that may meet in one group.
    """
    counts = [rows.groupBy("cell").agg(F.count("*").alias("n")) for rows in (faces, people)]
    faces_in, people_in = counts[0], counts[1].withColumnRenamed("n", "m")
    return faces_in.join(people_in, "cell").select(
        "cell",
        F.ceil(c("n") / most[0]).cast("int").alias("chunks"),
        F.ceil(c("m") / most[1]).cast("int").alias("blocks"),
    )


def in_groups(
    faces: DataFrame, people: DataFrame, most: tuple[int, int], tolerance: float
) -> DataFrame:
    """Close pairs of faces and people that share a ``cell`` (any type).

    ``faces``: face_id, image_id, encoding, cell; ``people``: name, encoding, copies, cell,
    each row in one group or several. A cell is cut by hash into chunks of faces and blocks
    of people of about ``most`` rows each, by what the cell itself holds: a cell that fits a
    group is not copied at all, and one without faces or without people is left out. Each
    chunk meets each block once. Both may have ``buckets`` and ``nth``: then a pair that
    shares an earlier bucket as well is left to the group of that one.

    ``cell`` may be a bundle of cells, at most some hundred in all. Faces then have ``cells``, the bits of
    the cells that they visit, and people ``own``, their cell: a group compares only these.
    """
    parts = cell_parts(faces, people, most)
    if "cells" in faces.columns:
        parts = F.broadcast(parts)  # saves a shuffle of all visits

    def spread(key: list[str], number: str) -> Column:
        return F.pmod(F.xxhash64(*key), c(number)).cast("int")

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0), c(number) - 1))

    left = faces.join(parts, "cell").withColumn("chunk", spread(["face_id"], "chunks"))
    left = left.withColumn("block", every("blocks")).drop("chunks", "blocks")
    right = people.join(parts, "cell").withColumn("block", spread(["name", "encoding"], "blocks"))
    right = right.withColumn("chunk", every("chunks")).drop("chunks", "blocks")
    types = dict(faces.dtypes)
    schema = (
        f"face_id {types['face_id']}, image_id {types['image_id']}, name string, copies bigint, "
        "distance double"
    )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        known = group["known"]
        faces, people = group.filter(pc.invert(known)), group.filter(known)
        del group
        yield from pair_batches(faces, people, tolerance)

    # One table, not two that meet, as only such groups hand on their pairs while they find them.
    both = left.withColumn("known", F.lit(False)).unionByName(
        right.withColumn("known", F.lit(True)), allowMissingColumns=True
    )
    pairs = both.groupBy(*GROUP).applyInArrow(met, schema)
    # One row per copy, as each is a known encoding of its own.
    return pairs.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "face_id", "image_id", "name", "distance"
    )


def _seen_before(faces: pa.Table, people: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether faces i and people j share a bucket before the one they are grouped by."""
    if "buckets" not in faces.column_names:
        return lambda i, j: np.zeros(len(i), dtype=bool)
    nth = faces["nth"][0].as_py()
    a, b = matrix(faces["buckets"])[:, :nth], matrix(people["buckets"])[:, :nth]
    return lambda i, j: (a[i] == b[j]).any(axis=1)


def _met(faces: pa.Table, people: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of faces and people to compare: all, or cell by cell those that visit and live there."""
    if "cells" not in faces.column_names:
        yield np.arange(faces.num_rows), np.arange(people.num_rows)
        return
    masks = np.frombuffer(b"".join(faces["cells"].to_pylist()), np.uint8).reshape(faces.num_rows, -1)
    own = people["own"].to_numpy()
    for cell in np.unique(own).tolist():
        rows = np.flatnonzero(masks[:, cell // 8] & (128 >> cell % 8))
        if len(rows):
            yield rows, np.flatnonzero(own == cell)


def _candidates(
    a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, tolerance: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be within the tolerance, a bounded number at a time."""
    others = b[columns]
    squares = np.square(others).sum(axis=1) * (1 - SLACK)
    height = max(1, min(TILE, ENTRIES // len(columns)))
    for start in range(0, len(rows), height):
        tile = a[rows[start : start + height]]
        # |x|^2 + |y|^2 - 2 x.y, less the slack.
        product = tile @ others.T
        product *= -2
        product += squares
        product += np.square(tile).sum(axis=1)[:, None] * (1 - SLACK)
        i, j = np.nonzero(product <= tolerance**2 + SLACK)
        for at in range(0, len(i), CANDIDATES):
            yield rows[start + i[at : at + CANDIDATES]], columns[j[at : at + CANDIDATES]]


def pair_batches(faces: pa.Table, people: pa.Table, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a group of faces and a group of people within the tolerance, some ``PAIRS`` at a time.

    Squared distances by matrix product pick the candidates, with slack for cancellation;
    differences decide.
    """
    if not faces.num_rows or not people.num_rows:
        return
    a, b = matrix(faces["encoding"]), matrix(people["encoding"])
    seen_before = _seen_before(faces, people)
    ids = {n: faces[n].combine_chunks() for n in ("face_id", "image_id")}
    names = {n: people[n].combine_chunks() for n in ("name", "copies")}

    def batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j, d = (pa.array(np.concatenate(x)) for x in zip(*found))
        taken = {n: v.take(i) for n, v in ids.items()} | {n: v.take(j) for n, v in names.items()}
        return pa.RecordBatch.from_pydict(taken | {"distance": d})

    found, held = [], 0
    for rows, columns in _met(faces, people):
        for i, j in _candidates(a, b, rows, columns, tolerance):
            d = np.sqrt(np.square(a[i] - b[j]).sum(axis=1))
            keep = (d <= tolerance) & ~seen_before(i, j)
            found.append((i[keep], j[keep], d[keep]))
            held += int(keep.sum())
            if held >= PAIRS:
                yield batch(found)
                found, held = [], 0
    if held:
        yield batch(found)


def close_pairs(faces: pa.Table, people: pa.Table, tolerance: float) -> pa.Table:
    """All of :func:`pair_batches` at once."""
    empty = {"face_id": faces, "image_id": faces, "name": people, "copies": people}
    fields = [pa.field(n, t.schema.field(n).type) for n, t in empty.items()] + [pa.field("distance", pa.float64())]
    return pa.Table.from_batches(pair_batches(faces, people, tolerance), pa.schema(fields))
