"""Nearest neighbours by blocks of a matrix product.

Queries and candidates are cut into blocks, and every block of queries meets every block of candidates
as one tile. Vectors are quantised to int8 with a scale of their own; a tile's product of the int8
matrices gives each inner product up to an error that the norms of the quantisation errors bound:

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|        (x', y' the quantised vectors)

A pair survives if its upper bound reaches the k-th greatest lower bound of its query in the tile or the
k-th score found before. Survivors are computed anew in double precision from the original vectors, and
per query a heap keeps the k best. The answer is exact.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without
id. Of rows with the same id the one with the greatest vector (in array order) counts. Only vectors of
the same length are compared. Ties go to the smaller id; with fewer candidates than k all are returned.
An empty table gives no rows. Columns but id and vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.shipping import ship_by_value

ship_by_value(__name__)

_BLOCK = "dim int, rows int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one per id."""
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(embedding).cast("array<double>").alias("vector"),
        )
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & F.exists("vector", lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"))
    )


def _blocks(size: int):
    """Rows of a partition as matrices of at most ``size`` rows of one length."""
    schema = pa.schema(
        [("dim", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]
    )

    def block(dim: int, rows: list) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], "<i8")
        matrix = np.array([r[1] for r in rows], "<f8")
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type)
             for v, f in zip((dim, len(rows), ids.tobytes(), matrix.tobytes()), schema)],
            schema=schema,
        )

    def run(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = v.values.to_numpy()
                rows = waiting.setdefault(len(vector), [])
                rows.append((i, vector))
                if len(rows) == size:
                    yield block(len(vector), waiting.pop(len(vector)))
        for dim, rows in waiting.items():
            yield block(dim, rows)

    return run


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of the quantised rows, norms of the errors."""
    scale = np.abs(matrix).max(1) / 127
    small = np.rint(matrix / scale[:, None]).astype(np.int8)
    near = small * scale[:, None]
    # A little more than the norms, for what rounding in double precision may take.
    return small, scale, np.linalg.norm(near, axis=1), np.linalg.norm(matrix - near, axis=1) + 1e-12 * (
        np.linalg.norm(matrix, axis=1)
    )


def bounds(q, c, q_matrix, c_matrix) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of a tile and the bound of their errors."""
    (qi, qs, qn, qe), (ci, cs, _, ce) = q, c
    # Sums of products of int8 are whole numbers, exact in float32 below 2**24.
    exact = np.float32 if q_matrix.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qi.astype(exact) @ ci.astype(exact).T).astype(np.float64)
    near = product * qs[:, None] * cs[None, :]
    error = qe[:, None] * np.linalg.norm(c_matrix, axis=1)[None, :] + qn[:, None] * ce[None, :]
    return near, error + 1e-12 * np.abs(near)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added one after another."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _tiles(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(dim, rows, ids, vectors):
        return np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(vectors.as_py(), "<f8").reshape(rows, dim)

    def search(heaps: dict[int, list], q_ids, q_matrix, c_ids, c_matrix) -> None:
        near, error = bounds(quantised(q_matrix), quantised(c_matrix), q_matrix, c_matrix)
        own = q_ids[:, None] == c_ids[None, :]
        low, high = near - error, near + error
        low[own] = high[own] = -np.inf
        least = np.full(len(q_ids), -np.inf)
        if low.shape[1] > k:
            least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        for n, i in enumerate(q_ids.tolist()):
            heap = heaps.get(i, ())
            if len(heap) == k:
                least[n] = max(least[n], heap[0][0])
        qs, cs = np.nonzero((high >= least[:, None]) & ~own)
        for at in range(0, len(qs), 1 << 16):
            a, b = qs[at : at + (1 << 16)], cs[at : at + (1 << 16)]
            scores = _inner(q_matrix[a], c_matrix[b])
            for i, j, s in zip(q_ids[a].tolist(), c_ids[b].tolist(), scores.tolist()):
                heap = heaps.setdefault(i, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -j))
                elif (s, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -j))

    def run(batches):
        # A heap for each query that met a tile of this task; k entries each.
        heaps: dict[int, list] = {}
        for batch in batches:
            names = ("dim", "rows", "ids", "vectors")
            for n in range(batch.num_rows):
                row = [batch.column(c)[n] for c in range(batch.num_columns)]
                q = [v.as_py() if c < 2 else v for c, v in enumerate(row[: len(names)])]
                c = [q[0]] + [v.as_py() if c < 1 else v for c, v in enumerate(row[len(names) :])]
                search(heaps, *matrix(*q), *matrix(*c))
            if len(heaps) > 100_000:
                yield _flat(heaps, schema)
                heaps = {}
        yield _flat(heaps, schema)

    return run


def _flat(heaps: dict[int, list], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(i, -j, s) for i, heap in heaps.items() for s, j in heap]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, schema)], schema=schema
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_rows: int = 512,
    candidate_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query.

    ``is_query``: condition on ``vec_id``. Blocks of candidates are spread over the shuffle partitions,
    and each block of queries goes to every partition.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = rows.filter(is_query).mapInArrow(_blocks(query_rows), _BLOCK)
    candidates = rows.mapInArrow(_blocks(candidate_rows), _BLOCK)
    spread = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    placed = candidates.select(
        "dim", F.col("rows").alias("c_rows"), F.col("ids").alias("c_ids"),
        F.col("vectors").alias("c_vectors"),
        F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int").alias("slot"),
    )
    # Sizes are estimated without the copies that explode makes, so that the copied blocks could be broadcast.
    tiles = spread.hint("merge").join(placed, ["slot", "dim"]).select(
        "dim", "rows", "ids", "vectors", "c_rows", "c_ids", "c_vectors"
    )
    found = tiles.mapInArrow(_tiles(k), _FOUND)
    # The best k of each task are merged; Spark drops rows beyond k before the shuffle as well.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
