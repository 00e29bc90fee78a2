"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.sources.shared import shared_folder

_REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within delete their shuffle files when they end.

    Else Spark deletes them some time after the driver has collected what refers to them.
    """
    before = spark.conf.get(_REMOVES_SHUFFLES, "false")
    spark.conf.set(_REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVES_SHUFFLES, before)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The table, written once, so that what follows does not depend on how it came about.

    The shuffle files behind it go at once, and the driver collects its garbage, so that disk and memory
    are free for the next step.
    """
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(folder)
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def connected(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node it reaches, for every end of a link (a, b).

    Large-star and small-star in turn: each node ties its greater neighbours, then its smaller ones, to
    its smallest neighbour, until every node hangs at the root of a star. The number of rounds grows with
    the logarithm of the longest path, and a round combines per task before it shuffles.
    """
    folder = shared_folder(links.sparkSession, "components")
    pairs = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    pairs, n, total = written(pairs, f"{folder}/0"), 0, None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        small = (
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        n += 1
        pairs = written(small, f"{folder}/{n}")
        # Links stay the same in number and sum only when nothing moves any more.
        now = tuple(pairs.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == total:
            break
        total = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
