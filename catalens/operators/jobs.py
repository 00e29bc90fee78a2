"""The job table: which jobs there were, from requests and from records of their start and end.

A job of a path begins with the first request after the end of the one before, and all requests up to
its own end are its waiters. It is waiting from its arrival, running from its start, and gone from its
end on.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens.operators import lookup

c = F.col

# Stretch of time, in seconds, that the records of one path are taken together for.
STRETCH = 3600


def _next_end(events: DataFrame, stretch: float) -> DataFrame:
    """Events (filepath, ts, end) with ``next_end``: the first end of the path at or after each.

    A path may hold a third of all events. They are therefore taken a stretch of time at a time; what
    follows a stretch is known from one row per path and stretch.
    """
    size = F.lit(round(stretch * 1_000_000))
    placed = events.withColumn("_part", F.floor(F.unix_micros(c("ts").cast("timestamp")) / size))
    within = Window.partitionBy("filepath", "_part").orderBy("ts").rangeBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    own = placed.withColumn("_own", F.min("end").over(within))
    after = Window.partitionBy("filepath").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    parts = placed.groupBy("filepath", "_part").agg(F.min("end").alias("_first"))
    later = parts.select("filepath", "_part", F.min("_first").over(after).alias("_later"))
    joined = own.join(later, ["filepath", "_part"], "left")
    return joined.withColumn("next_end", F.coalesce("_own", "_later")).drop("_part", "_own", "_later")


def job_table(keyed: DataFrame, started: DataFrame, ended: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """One row per job: path, fields of its first request, class, arrival, waiters, start, end, outcome.

    ``started``: filepath, started_ts. ``ended``: filepath, ended_ts, outcome. A record of a path that
    nobody asked for makes no job. Of several starts the first counts, of outcomes of one moment the
    first by name. A job without a start or end record has none; a start before its arrival counts
    from the arrival. Rows without a path are left out.
    """
    fields = F.struct("ts", "request_id", *[f for f in lookup.JOB_FIELDS if f != "request_id"])
    requests = lookup.valid(keyed).where("filepath IS NOT NULL")
    kind = requests.schema["ts"].dataType
    nothing = F.lit(None)
    asked = requests.select(
        "filepath", "ts", nothing.cast(kind).alias("end"), fields.alias("asked"),
        nothing.cast(kind).alias("start"), nothing.cast("string").alias("outcome"),
    )
    starts = started.where("filepath IS NOT NULL").select(
        "filepath", c("started_ts").cast(kind).alias("ts"), c("started_ts").cast(kind).alias("start")
    )
    ends = ended.where("filepath IS NOT NULL").select(
        "filepath", c("ended_ts").cast(kind).alias("ts"), c("ended_ts").cast(kind).alias("end"), "outcome"
    )
    events = asked.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    jobs = (
        _next_end(events, stretch).groupBy("filepath", "next_end").agg(
            F.min("asked.ts").alias("arrival"),
            F.min_by("asked", F.when(c("asked").isNotNull(), F.struct("asked.ts", "asked.request_id"))).alias("first"),
            F.count("asked").alias("waiters"),
            F.min("start").alias("start"),
            F.min("outcome").alias("outcome"),
        )
        .where("arrival IS NOT NULL")
    )
    return jobs.select(
        "filepath",
        *[c(f"first.{f}").alias(f) for f in lookup.JOB_FIELDS],
        lookup.job_class(c("first.type")).alias("job_class"),
        "arrival",
        "waiters",
        F.greatest("start", F.when(c("start").isNotNull(), c("arrival"))).alias("started_ts"),
        c("next_end").alias("ended_ts"),
        "outcome",
    )


def jobs_at(table: DataFrame, instants: list[datetime] | Column) -> DataFrame:
    """Jobs that wait or run at each of a few instants (``at``), with ``running``.

    For one instant the result is what :func:`catalens.operators.lookup.status` and
    :func:`catalens.operators.lookup.admit` take.
    """
    kind = table.schema["arrival"].dataType
    times = instants if isinstance(instants, Column) else F.array(*[F.lit(t).cast(kind) for t in instants])
    timed = table.withColumn("at", F.explode(times))
    alive = timed.where((c("arrival") <= c("at")) & (c("ended_ts").isNull() | (c("ended_ts") > c("at"))))
    return alive.withColumn("running", F.coalesce(c("started_ts") <= c("at"), F.lit(False)))
