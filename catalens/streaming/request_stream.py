"""Request streams: admission of each path once, hits and misses, outcomes, live counts.

Input streams have an event time ``ts`` (TIMESTAMP). ``horizon`` bounds how long a rendition
counts as being made: a stream needs such a bound, or its state would grow for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalens.operators import lookup
from catalens.session import starting_with
from catalens.shipping import ship_by_value
from catalens.sources import manifest

ship_by_value(__name__)
c = F.col

# Copies of each outcome in the pairing join.
OUTCOME_COPIES = 8
# Partitions that a stream's state may have in any case, however few the cores.
LEAST_PARTITIONS = 8
_PARTITIONS = "spark.sql.shuffle.partitions"


def _earliest_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table.group_by("filepath").aggregate([("ts", "min")])
        renamed = kept.select(["filepath", "ts_min"]).rename_columns(["filepath", "ts"])
        yield from renamed.to_batches()


def admit_once(keyed: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """First request of each path; repeats are dropped until the horizon has passed.

    Emits at once. Repeats within a task's batch are dropped before the shuffle, so a path
    that holds much of the stream does not fill one task; within a micro-batch they would
    have been dropped after it all the same.
    """
    stream = lookup.valid(keyed).select("filepath", "ts")
    first = stream.mapInArrow(_earliest_per_batch, "filepath string, ts timestamp")
    return first.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["filepath"])


def flight_windows(keyed: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Per path and horizon-long window: first request, arrival, number of waiters."""
    stream = lookup.valid(keyed).withWatermark("ts", horizon)
    first = F.min_by("request_id", F.struct("ts", "request_id"))
    return (
        stream.groupBy(F.window("ts", horizon), "filepath")
        .agg(
            first.alias("first_request"),
            F.min("ts").alias("arrival"),
            F.count("*").alias("waiters"),
        )
        .select(
            "filepath", c("window.start").alias("window_start"),
            "first_request", "arrival", "waiters",
        )
    )


def class_counts(keyed: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Valid requests per window and class of work."""
    stream = lookup.valid(keyed).withWatermark("ts", delay)
    return (
        stream.groupBy(F.window("ts", window), lookup.job_class(c("type")).alias("job_class"))
        .agg(F.count("*").alias("requests"))
        .select(c("window.start").alias("window_start"), "job_class", "requests")
    )


def pair_outcomes(
    keyed: DataFrame,
    outcomes: DataFrame,
    within: str = "30 minutes",
    delay: str = "1 hour",
    copies: int = OUTCOME_COPIES,
) -> DataFrame:
    """Every request with the outcome of its path that arrives within the given time.

    ``outcomes``: filepath, outcome_ts, outcome. A path has few outcomes but may have most
    of the requests, so each outcome is copied and the requests are spread over the copies.
    """
    copy = F.pmod(F.xxhash64("request_id"), F.lit(copies))
    waiting = (
        lookup.valid(keyed)
        .select("request_id", "filepath", "ts", copy.alias("copy"))
        .withWatermark("ts", delay)
    )
    numbers = F.array(*[F.lit(i).cast("bigint") for i in range(copies)])
    done = (
        outcomes.select(
            c("filepath").alias("done_path"), "outcome_ts", "outcome",
            F.explode(numbers).alias("done_copy"),
        )
        .withWatermark("outcome_ts", delay)
    )
    in_time = (c("outcome_ts") >= c("ts")) & (
        c("outcome_ts") <= c("ts") + F.expr(f"INTERVAL {within}")
    )
    same = (c("filepath") == c("done_path")) & (c("copy") == c("done_copy"))
    return waiting.join(done, same & in_time).select(
        "request_id", "filepath", "ts", "outcome_ts", "outcome"
    )


# --- running ----------------------------------------------------------------------------


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: the session's shuffle partitions, but no more than run at once.

    Each batch opens and commits the stores of every partition, with or without rows, so that partitions beyond
    the cores only add to its time: with a number that grows with the input, each batch would pay for the
    whole of it. A stream keeps the number that it started with.
    """
    at_once = max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)
    return min(int(spark.conf.get(_PARTITIONS)), at_once)


def run_appending(stream: DataFrame, folder: str, **options: str) -> StreamingQuery:
    """Process what is there now into Parquet files, exactly once, and stop."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .options(**options)
        .trigger(availableNow=True)
    )
    spark = stream.sparkSession
    with starting_with(spark, **{_PARTITIONS: str(state_partitions(spark))}):
        return writer.start()


def run_batches(
    stream: DataFrame,
    folder: str,
    transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "append",
    partitions: int | None = None,
) -> StreamingQuery:
    """Process what is there now batch by batch; each batch owns one output folder.

    A batch run again after a failure overwrites its own folder, so no row is doubled.
    ``transform`` sees an ordinary DataFrame and is planned as a batch query. Its joins, too, are dealt
    to ``partitions``, by default :func:`state_partitions`.
    """
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
    )
    spark = stream.sparkSession
    with starting_with(spark, **{_PARTITIONS: str(partitions or state_partitions(spark))}):
        return writer.start()


def read_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a run has written so far; ``batch`` tells the batch if it was run in batches."""
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def latest(changes: DataFrame, *key: str) -> DataFrame:
    """Last state of each key from the changes of an updating query."""
    values = [name for name in changes.columns if name not in (*key, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_v")
    return changes.groupBy(*key).agg(newest).select(*key, "_v.*")


def lookup_stream(
    keyed: DataFrame, read_cached: Callable[[], DataFrame], folder: str
) -> StreamingQuery:
    """Hit or miss of each request; the stored paths are read anew for every batch.

    Of a manifest, which has a ``bucket``, only the files of the buckets that the batch asks for are
    read. Only rows that it asks for go on from the scan, as long as its paths are few enough to be
    sent there.
    """
    def answer(batch: DataFrame) -> DataFrame:
        asked = lookup.valid(batch).select("filepath").distinct()
        cached = read_cached()
        if "bucket" in cached.columns:
            cached = manifest.in_buckets_of(cached, asked)
        stored = cached.join(asked, "filepath", "left_semi")
        return lookup.hit_or_miss(batch, stored).select("request_id", "filepath", "hit")

    # No state: the joins keep the session's partitions.
    return run_batches(keyed, folder, answer, partitions=int(keyed.sparkSession.conf.get(_PARTITIONS)))
