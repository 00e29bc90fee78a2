"""From requests to the plan of every rendition that is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalens.operators import lookup
from catalens.plans import routing, steps


def jobs_to_render(
    requests: DataFrame, cached: DataFrame, media: DataFrame, cache_path: str
) -> DataFrame:
    """One job per missing rendition with a readable source.

    The requests are collapsed in the map tasks to one row per path and source, most of them
    leave as what they ask for is stored, and only the rest meets the sources. The first
    request of a path that has a source (one without never becomes a job) decides.
    """
    keyed = lookup.valid(lookup.with_key(requests, cache_path))
    first = F.min_by(F.struct(*lookup.JOB_FIELDS), F.struct("ts", "request_id"))
    # The source's name is in the group's key as well, so that two sources stay two rows.
    asked = keyed.groupBy("filepath", F.col("filename").alias("_source")).agg(
        first.alias("first"), F.min("ts").alias("arrival"), F.count("*").alias("waiters")
    )
    missing = asked.join(cached.select("filepath"), "filepath", "left_anti")
    flat = missing.select("filepath", "first.*", "arrival", "waiters")
    source = ("mimetype", "src_w", "src_h", "compression")
    sourced = routing.with_source(flat, media)
    earliest = F.min_by(
        F.struct(*lookup.JOB_FIELDS, *source), F.struct("arrival", "request_id")
    )
    jobs = sourced.groupBy("filepath").agg(
        earliest.alias("first"), F.min("arrival").alias("arrival"), F.sum("waiters").alias("waiters")
    )
    return jobs.select("filepath", "first.*", "arrival", "waiters")


def plan(
    requests: DataFrame,
    cached: DataFrame,
    media: DataFrame,
    cache_path: str,
    work_root: str,
    thread_count: int = 1,
) -> DataFrame:
    """Steps, result file and predicted size per missing rendition, or an impossible one's error.

    ``work_root``: folder for the files between the steps, on every machine that runs them.
    """
    jobs = jobs_to_render(requests, cached, media, cache_path)
    routable = jobs.where(lookup.job_class(F.col("type")).isNotNull())
    routed = steps.with_work_dir(routing.route(routable), work_root, thread_count)
    return steps.with_result(steps.with_size(steps.with_steps(routed))).select(
        "filepath", "converter", "steps", "result", "out_w", "out_h", "waiters", "error"
    )
