"""Session settings the operators are written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: joins are broadcast only once a side is measured to be small,
    # partitions are sized from real map output, and an over-full join partition is split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A record has dozens of columns. Generated methods longer than this are never compiled to
    # machine code by HotSpot; operators that would need one run as smaller pieces instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stream state lives on disk and in the checkpoint, not on the executor heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "catalens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` holds further settings by their full name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def starting_with(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Streams started within take over ``settings`` (by full name); afterwards the session has its own again."""
    conf = spark.conf
    named = {key: conf.getAll.get(key) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        yield
    finally:
        for key, value in named.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)
