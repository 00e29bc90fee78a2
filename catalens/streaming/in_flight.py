"""Requests in flight on a stream: admission until the outcome, one answer per request.

A path is in flight from the request that starts its job to the first outcome of the path at or after
that request. Whoever asks for it meanwhile gets that outcome. Both operators read one stream of
requests and outcomes, see :func:`arrivals`. Paths are dealt to buckets, and state and timers are kept by
bucket: most paths have one or two rows, and a call for each of them would cost more than its rows. Rows of
a bucket travel and are stored as Arrow record batches, and a bucket's rows are worked on at once.

Arrivals: ``filepath``, ``ts`` (event time), ``request_id`` for a request, ``outcome`` for an outcome.
A row without a path only tells the time: without later rows the last requests would wait for ever.

A key has several states and timers. Spark's default state store, which holds them on the heap, cannot
keep them; :func:`run_appending` starts a stream with one that can, whatever the session's setting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from catalens.operators import lookup
from catalens.session import SETTINGS, starting_with
from catalens.shipping import ship_by_value
from catalens.streaming import request_stream

ship_by_value(__name__)
c = F.col

TIMED_OUT = "timed out"
_STORE = "spark.sql.streaming.stateStore.providerClass"
# The default, which keeps one state per key.
_SINGLE = "HDFSBackedStateStoreProvider"
# Memory outside the heap: bytes of rows on their way to Python, and of each partition's rows not yet in a file.
_LEAN = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
}
# Parts that the waiters of a hot path are dealt to.
HOT_PARTS = 32
# Buckets that paths are dealt to. A stream keeps the number that it started with.
BUCKETS = 512
_SECOND = 1_000_000
# A task packs so many rows or bytes at once; stored and emitted batches have at most so many rows.
_PACK_ROWS, _PACK_BYTES, _CHUNK = 1 << 16, 1 << 23, 1 << 16
_ROWS = pa.schema(
    [("filepath", pa.large_string()), ("us", pa.int64()), ("request_id", pa.int64()), ("outcome", pa.large_string())]
)
_BEFORE = np.iinfo(np.int64).min


def arrivals(keyed: DataFrame, outcomes: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Valid requests, outcomes (``filepath, outcome_ts, outcome``) and ticks (``ts``) as one stream."""
    requests = lookup.valid(keyed).select("filepath", "ts", c("request_id").cast("bigint").alias("request_id"))
    ended = outcomes.where("filepath IS NOT NULL").select(
        "filepath", c("outcome_ts").alias("ts"), F.coalesce("outcome", F.lit("")).alias("outcome")
    )
    both = requests.unionByName(ended, allowMissingColumns=True)
    if clock is None:
        return both
    return both.unionByName(clock.select("ts"), allowMissingColumns=True)


def hot_paths(keyed: DataFrame, share: float = 0.01) -> list[str]:
    """Paths with more than ``share`` of the valid requests of a table: at most 1 / share of them."""
    requests = lookup.valid(keyed)
    counts = requests.groupBy("filepath").agg(F.count("*").alias("n"))
    many = share * requests.count()
    return sorted(r["filepath"] for r in counts.where(c("n") > many).select("filepath").collect())


def _micros(seconds: float) -> int:
    return round(seconds * _SECOND)


def _bytes(table: pa.Table) -> list[bytes]:
    """Record batches of at most ``_CHUNK`` rows, without their schema."""
    return [b.serialize().to_pybytes() for b in table.combine_chunks().to_batches(max_chunksize=_CHUNK)]


def _table(blobs: Iterable[bytes], schema: pa.Schema = _ROWS) -> pa.Table:
    batches = [pa.ipc.read_record_batch(pa.py_buffer(bytes(b)), schema) for b in blobs]
    return pa.Table.from_batches(batches, schema)


def _packing(combine: Callable[[pa.Table], pa.Table] | None = None):
    """Rows of a task as one record batch per bucket, with the latest time of its rows."""
    schema = pa.schema([("bucket", pa.int32()), ("us", pa.int64()), ("rows", pa.binary())])

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if combine is not None:
            table = combine(table)
        if pc.any(pc.and_(pc.is_valid(table["filepath"]), pc.is_null(table["us"]))).as_py():
            raise ValueError("arrivals of a path need a time")
        table = table.take(pc.sort_indices(table["bucket"])).combine_chunks()
        buckets = table["bucket"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        rows = table.select(_ROWS.names).cast(_ROWS)
        found = []
        for low, high in zip(edges, edges[1:]):
            part = rows.slice(low, high - low)
            named = part.filter(pc.is_valid(part["filepath"]))
            found += [
                (int(buckets[low]), pc.max(part["us"]).as_py(), blob)
                for blob in _bytes(named) or [b""]
            ]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= _PACK_ROWS or size >= _PACK_BYTES:
                yield from packs(held)
                held, n, size = [], 0, 0
        if held:
            yield from packs(held)

    return run


def _unpacking(columns: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in schema])
        for batch in batches:
            for blob in batch.column("rows"):
                yield from _table([blob.as_py()], schema).cast(plain).to_batches()

    return lambda df: df.mapInArrow(run, columns)


def _by_bucket(rows: DataFrame, bucket: Column, delay: str, combine=None):
    """Arrivals packed by bucket, with a watermark on the latest time of a pack, and grouped."""
    dealt = rows.select(
        bucket.cast("int").alias("bucket"), "filepath", F.unix_micros("ts").alias("us"), "request_id", "outcome"
    )
    packed = dealt.mapInArrow(_packing(combine), "bucket int, us bigint, rows binary")
    timed = packed.select("bucket", F.timestamp_micros("us").alias("ts"), "rows").withWatermark("ts", delay)
    return timed.groupBy("bucket")


class _Times:
    """Times of paths (as numbers), sorted by path and time; finds the first one of a path from a time on."""

    def __init__(self, codes: np.ndarray, us: np.ndarray):
        self.codes, self.us = codes, us
        self.times = np.unique(us)
        self.keys = self._key(codes, us, "left")

    def _key(self, codes: np.ndarray, us: np.ndarray, side: str) -> np.ndarray:
        return codes * (len(self.times) + 1) + np.searchsorted(self.times, us, side)

    def first(self, codes: np.ndarray, us: np.ndarray, side: str = "left") -> tuple[np.ndarray, np.ndarray]:
        """Places of the first times at or after (``right``: after) those given, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.searchsorted(self.keys, self._key(codes, us, side))
        there = at < len(self.keys)
        at[~there] = 0
        return at, there & (self.codes[at] == codes)


def _numbered(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Number of each row's path, the paths, the times, and which rows are outcomes."""
    paths = table["filepath"].combine_chunks().dictionary_encode()
    if isinstance(paths, pa.ChunkedArray):
        paths = paths.combine_chunks()
    codes = paths.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, paths.dictionary, table["us"].to_numpy(), pc.is_valid(table["outcome"]).to_numpy()


class _Bucket(StatefulProcessor):
    """Rows of a bucket, the time up to which it is settled, and its one timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")
        self.clock = handle.getValueState("clock", "settled bigint, alarm bigint")

    def _clock(self) -> tuple[int | None, int | None]:
        return tuple(self.clock.get()) if self.clock.exists() else (None, None)

    def _arrived(self, rows, settled: int | None) -> pa.Table:
        """New rows; what was settled without them is not taken up again."""
        table = _table(r.rows for r in rows if r.rows)
        return table if settled is None else table.filter(pc.greater(table["us"], settled))

    def _held(self) -> pa.Table:
        return _table(r[0] for r in self.rows.get())

    def _keep(self, table: pa.Table) -> None:
        blobs = _bytes(table)
        if not blobs:
            self.rows.clear()
        for n, blob in enumerate(blobs):
            if n:
                self.rows.appendValue((blob,))
            else:
                self.rows.put([(blob,)])

    def _set(self, settled: int | None, at: int | None, alarm: int | None) -> None:
        """Time settled, and the timer moved from ``alarm`` to ``at``."""
        if at != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            if at is not None:
                self.handle.registerTimer(at)
        self.clock.update((settled, at))


_ANSWERS = pa.schema(
    [("request_id", pa.int64()), ("filepath", pa.large_string()), ("us", pa.int64()), ("answered", pa.int64()),
     ("outcome", pa.large_string())]
)


class _Answers(_Bucket):
    """Waiters and outcomes of the paths of a bucket until the watermark settles them."""

    def __init__(self, within: int):
        self.within = within

    def _next(self, us: np.ndarray, ends: np.ndarray) -> int | None:
        """The first moment at which something may be settled."""
        return -(-int(np.where(ends, us, us + self.within).min()) // 1000) if len(us) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        settled, alarm = self._clock()
        new = self._arrived(rows, settled)
        if new.num_rows:
            for blob in _bytes(new):
                self.rows.appendValue((blob,))
            at = self._next(new["us"].to_numpy(), pc.is_valid(new["outcome"]).to_numpy())
            self._set(settled, at if alarm is None else min(at, alarm), alarm)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # Nothing at or before the watermark can arrive any more.
        held = self._held()
        codes, _, us, ends = _numbered(held)
        names = held["outcome"].combine_chunks().filter(pa.array(ends)).to_pylist()
        o_codes, o_us = codes[ends], us[ends]
        order = sorted(range(len(names)), key=lambda i: (o_codes[i], o_us[i], names[i]))
        outcomes = _Times(o_codes[order], o_us[order])
        waiting = np.flatnonzero(~ends)
        last = us[waiting] + self.within
        at, found = outcomes.first(codes[waiting], us[waiting])
        answered = last.copy()
        if len(order):
            answered[found] = outcomes.us[at[found]]
        found &= answered <= last
        answered[~found] = last[~found]
        out = answered <= now
        if out.any():
            said = [names[order[k]] if there else TIMED_OUT for k, there in zip(at[out].tolist(), found[out].tolist())]
            rows = held.take(waiting[out])
            columns = [rows["request_id"], rows["filepath"], rows["us"], pa.array(answered[out]), pa.array(said, pa.large_string())]
            for blob in _bytes(pa.table(columns, schema=_ANSWERS)):
                yield Row(rows=blob)
        left = ends & (us > now)
        left[waiting[~out]] = True
        self._keep(held.filter(pa.array(left)))
        self._set(now, self._next(us[left], ends[left]), None)


def answers(
    arriving: DataFrame,
    within: float = 1800,
    delay: str = "1 hour",
    hot: list[str] | tuple[str, ...] = (),
    parts: int = HOT_PARTS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``request_id, filepath, ts, answered_ts, outcome``: one row per request.

    A request gets the first outcome of its path at or after it (of outcomes at one time the first by
    name), or ``timed out`` once ``within`` seconds have passed without one. Answers leave when the
    watermark, ``delay`` behind the latest arrival, has passed them, so that they do not depend on how
    rows fall into batches. Arrivals later than ``delay`` are lost once their bucket is settled up to their time.

    Waiters of the paths in ``hot`` (see :func:`hot_paths`) are spread over ``parts`` keys and their
    outcomes go to each of them; all other paths are one key and travel once. Keys are dealt to ``buckets``.
    """
    is_hot = c("filepath").isin(*hot) if hot else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    own = F.array(F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int"))
    part = F.when(~F.coalesce(is_hot, F.lit(False)), F.array(F.lit(0))).when(c("outcome").isNull(), own).otherwise(every)
    dealt = arriving.select("filepath", "ts", "request_id", "outcome", F.explode(part).alias("part"))
    bucket = F.pmod(F.xxhash64("filepath", "part"), F.lit(buckets))
    packed = _by_bucket(dealt, bucket, delay).transformWithState(
        _Answers(_micros(within)), "rows binary", "Append", "EventTime"
    )
    out = packed.transform(_unpacking(
        "request_id bigint, filepath string, us bigint, answered bigint, outcome string", _ANSWERS
    ))
    return out.select(
        "request_id", "filepath", F.timestamp_micros("us").alias("ts"),
        F.timestamp_micros("answered").alias("answered_ts"), "outcome",
    )


class _Admission(_Bucket):
    """Since when the paths of a bucket are in flight, and outcomes that later requests may still come before.

    A path in flight is a row without outcome, at the time of the request that started its job.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def _until(self, outcomes: _Times, codes: np.ndarray, since: np.ndarray) -> np.ndarray:
        until = since + self.horizon
        at, found = outcomes.first(codes, since)
        if found.any():
            until[found] = np.minimum(until[found], outcomes.us[at[found]])
        return until

    def _admitted(self, new: pa.Table, now: int, alarm: int | None) -> pa.Table:
        """New requests that start a job. Keeps what requests after the watermark still need, and one timer."""
        held = self._held()
        both = pa.concat_tables([held, new]).combine_chunks()
        codes, paths, us, ends = _numbered(both)
        came = np.arange(len(us)) >= held.num_rows
        ended = np.flatnonzero(ends)
        ended = ended[np.lexsort((us[ended], codes[ended]))]
        outcomes = _Times(codes[ended], us[ended])
        since, flies = np.zeros(len(paths), np.int64), np.zeros(len(paths), bool)
        flying = ~ends & ~came
        since[codes[flying]], flies[codes[flying]] = us[flying], True

        asking = np.flatnonzero(~ends & came)
        ids = both["request_id"].combine_chunks()
        unknown = pc.is_null(ids).to_numpy(zero_copy_only=False)[asking]
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[asking]
        asking = asking[np.lexsort((ids, unknown, us[asking], codes[asking]))]
        requests = _Times(codes[asking], us[asking])
        # The next job of each path at once, until no path has a request after its last job.
        asked = np.unique(requests.codes)
        free = np.where(flies[asked], self._until(outcomes, asked, since[asked]), _BEFORE)
        starts = []
        while len(asked):
            at, found = requests.first(asked, free, "right")
            asked, at = asked[found], at[found]
            since[asked], flies[asked] = requests.us[at], True
            starts.append(asking[at])
            free = self._until(outcomes, asked, since[asked])

        flight = np.flatnonzero(flies)
        until = self._until(outcomes, flight, since[flight])
        flight, until = flight[until > now], until[until > now]
        flies[:] = False
        flies[flight] = True
        ended = np.unique(ended[(outcomes.us > now) & (~flies[outcomes.codes] | (outcomes.us >= since[outcomes.codes]))])
        nothing = pa.nulls(len(flight))
        kept = pa.table([paths.take(pa.array(flight)), pa.array(since[flight]), nothing.cast(pa.int64()),
                         nothing.cast(pa.large_string())], schema=_ROWS)
        self._keep(pa.concat_tables([kept, both.take(ended)]))
        needed = np.concatenate([until, us[ended]])
        self._set(now, int(needed.max()) // 1000 + 1 if len(needed) else None, alarm)
        return both.take(np.concatenate([np.zeros(0, np.int64), *starts]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        settled, alarm = self._clock()
        new = self._arrived(rows, settled)
        if new.num_rows:
            for blob in _bytes(self._admitted(new, timerValues.getCurrentWatermarkInMs() * 1000, alarm)):
                yield Row(rows=blob)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._admitted(_ROWS.empty_table(), timerValues.getCurrentWatermarkInMs() * 1000, None)
        return iter(())


def _without_repeats(table: pa.Table) -> pa.Table:
    """One request per path and time, the first by id, and one outcome."""
    named = table.append_column("ends", pc.is_valid(table["outcome"]))
    kept = named.group_by(["bucket", "filepath", "us", "ends"]).aggregate([("request_id", "min"), ("outcome", "min")])
    return kept.select(["bucket", "filepath", "us", "request_id_min", "outcome_min"]).rename_columns(
        ["bucket", "filepath", "us", "request_id", "outcome"]
    )


def admissions(
    arriving: DataFrame, horizon: float = 3600, delay: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """``request_id, filepath, ts`` of each request that starts a job; emitted at once.

    A path in flight admits nobody else. Its first outcome frees it; without one it counts as free once
    ``horizon`` seconds have passed, which also bounds the state. A request at the very time of the
    outcome still belongs to the ended flight. As nothing is held back, a request must not arrive in an
    earlier batch than requests and outcomes of its path that come before it in time; outcomes known
    ahead of their time do no harm.

    A path is in one of ``buckets``: its arrivals of a batch meet in one task, those of one instant combined
    before. The trigger bounds how many that are.
    """
    bucket = F.pmod(F.xxhash64("filepath"), F.lit(buckets))
    packed = _by_bucket(arriving, bucket, delay, _without_repeats).transformWithState(
        _Admission(_micros(horizon)), "rows binary", "Append", "EventTime"
    )
    out = packed.transform(_unpacking(
        "filepath string, us bigint, request_id bigint, outcome string", _ROWS
    ))
    return out.select("request_id", "filepath", F.timestamp_micros("us").alias("ts"))


def run_appending(stream: DataFrame, folder: str, **options: str) -> StreamingQuery:
    """:func:`request_stream.run_appending` with a state store that holds several states per key.

    A row is a pack of some kilobytes here, so batches of rows are bounded by bytes, if the session does not say how.
    """
    spark = stream.sparkSession
    own = spark.conf.getAll
    settings = {key: value for key, value in _LEAN.items() if key not in own}
    if own.get(_STORE, _SINGLE).endswith(_SINGLE):
        settings[_STORE] = SETTINGS[_STORE]
    with starting_with(spark, **settings):
        return request_stream.run_appending(stream, folder, **options)
