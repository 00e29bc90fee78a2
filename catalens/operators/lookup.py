"""Rendition requests against what is stored: hits, misses, collapse, admission, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalens.functions import js, keys, mime
from catalens.operators import uneven

c = F.col

# Groups a top-k is split into before its final round.
ADMISSION_SPREAD = 64
# Class of work a rendition type belongs to; ``*`` belongs to none.
JOB_CLASS_BY_TYPE = {
    "image": "image",
    "document": "image",
    "video": "video",
    "audio": "video",
}


def with_key(requests: DataFrame, cache_path: str) -> DataFrame:
    """Add ``name``, ``filepath`` and ``error``; ``angle`` becomes the normalised one."""
    parsed = requests.withColumn("_angle", js.parse_int(c("angle")))
    checked = parsed.withColumns(
        {
            "angle": keys.rotation(c("_angle")),
            "error": F.coalesce(
                F.when(c("id").isNull(), F.lit(keys.ID_ERROR)),
                c("size_error") if "size_error" in requests.columns else F.lit(None),
                keys.rotation_error(c("_angle")),
                mime.type_error(c("type")),
            ),
        }
    ).drop("_angle")
    parts = [c(p) for p in ("id", "type", "width", "height", "angle", "mirror")]
    named = checked.withColumn("name", F.when(c("error").isNull(), keys.build_key(*parts)))
    return named.withColumn("filepath", keys.path_in(cache_path, c("name")))


def valid(keyed: DataFrame) -> DataFrame:
    return keyed.where("error IS NULL")


def stored_paths(cached: DataFrame) -> DataFrame:
    """Distinct paths: a manifest appended to twice must not double any answer."""
    return uneven.unique(cached, "filepath")


def hit_or_miss(keyed: DataFrame, cached: DataFrame) -> DataFrame:
    """Valid requests with ``hit``.

    Many requests may ask for one path. The request side is the left one, which the
    runtime may split when a path holds most rows; the other side has one row per path.
    """
    stored = stored_paths(cached).withColumn("hit", F.lit(True))
    joined = valid(keyed).join(stored, "filepath", "left")
    return joined.withColumn("hit", F.coalesce(c("hit"), F.lit(False)))


def hits(keyed: DataFrame, cached: DataFrame) -> DataFrame:
    return valid(keyed).join(cached.select("filepath"), "filepath", "left_semi")


def misses(keyed: DataFrame, cached: DataFrame) -> DataFrame:
    return valid(keyed).join(cached.select("filepath"), "filepath", "left_anti")


def missing_sources(missed: DataFrame, files: DataFrame) -> DataFrame:
    """Misses whose source file does not exist."""
    sources = files.select(c("path").alias("filename"))
    return missed.join(sources, "filename", "left_anti")


def _spread_null(key: str) -> Column:
    """Join key that gives rows without one a value of their own, which matches nothing.

    An outer join would otherwise send all requests without a key to one task.
    """
    return F.coalesce(c(key), F.concat(F.lit("\x00"), c("request_id").cast("string")))


def lookup(
    requests: DataFrame, cached: DataFrame, files: DataFrame, cache_path: str
) -> DataFrame:
    """Answer per request: ``request_id, filepath, status, error``.

    ``status`` is hit, miss (to be rendered), unroutable (a miss of type ``*``, which no
    class of work takes) or error. A source is only asked for after a miss.
    """
    keyed = with_key(requests, cache_path).select(
        "request_id", "filename", "type", "filepath", "error"
    )
    stored = stored_paths(cached).select(c("filepath").alias("_path"), F.lit(True).alias("hit"))
    sources = uneven.unique(files.select(c("path").alias("_source")), "_source").withColumn(
        "found", F.lit(True)
    )
    joined = (
        keyed.withColumns({"_path": _spread_null("filepath"), "_source": _spread_null("filename")})
        .join(stored, "_path", "left")
        .join(sources, "_source", "left")
    )
    status = (
        F.when(c("error").isNotNull(), "error")
        .when(c("hit"), "hit")
        .when(c("found").isNull(), "error")
        .when(c("type") == mime.ANY_TYPE, "unroutable")
        .otherwise("miss")
    )
    no_source = F.concat(F.lit("No such file, "), F.coalesce(c("filename"), F.lit("undefined")))
    return joined.withColumn("status", status).select(
        "request_id",
        "filepath",
        "status",
        F.when(c("status") == "error", F.coalesce(c("error"), no_source)).alias("error"),
    )


# Columns of a request that a job takes over from the first request for its path.
JOB_FIELDS = [
    "request_id",
    "filename",
    "type",
    "width",
    "height",
    "angle",
    "mirror",
    "timeindex",
    "deinterlace",
]


def single_flight(keyed: DataFrame, *more: str) -> DataFrame:
    """One job per path: format and source of the first request, ``arrival``, ``waiters``.

    A path asked for by most requests shrinks to one row per map task before the shuffle.
    ``more`` names further columns taken over from the first request.
    """
    first = F.min_by(F.struct(*JOB_FIELDS, *more), F.struct("ts", "request_id"))
    grouped = valid(keyed).groupBy("filepath").agg(
        first.alias("first"), F.min("ts").alias("arrival"), F.count("*").alias("waiters")
    )
    return grouped.select("filepath", "first.*", "arrival", "waiters")


def key_conflicts(keyed: DataFrame) -> DataFrame:
    """Paths whose requests differ in something the key leaves out.

    The first request decides what is stored; the others get it as well.
    """
    def differs(name: str) -> Column:
        present = F.count(c(name))
        mixed = (present > 0) & (present < F.count("*"))
        return F.coalesce(F.min(name) != F.max(name), F.lit(False)) | mixed

    fields = ["filename", "timeindex", "deinterlace"]
    grouped = valid(keyed).groupBy("filepath").agg(*[differs(f).alias(f) for f in fields])
    return grouped.where(F.greatest(*[c(f) for f in fields]))


def job_class(type_: Column) -> Column:
    cases = [F.when(type_ == t, F.lit(k)) for t, k in JOB_CLASS_BY_TYPE.items()]
    return F.coalesce(*cases)


def status(jobs: DataFrame, *by: str) -> DataFrame:
    """Number of jobs per class and state, and per further columns."""
    return jobs.groupBy(*by, "job_class", "running").agg(F.count("*").alias("jobs"))


def admit(jobs: DataFrame, slots: dict[str, int], spread: int = ADMISSION_SPREAD) -> DataFrame:
    """Jobs to start next: per class the earliest waiting ones, as far as slots are free.

    There are two classes, so one ranking per class would put half of all jobs in a task.
    The jobs are therefore ranked in ``spread`` parts of each class first; only the leading
    ones of each part, at most the slots of the class, enter the final ranking. That loses
    nothing: a job behind that many others of its own part is behind them in the class too.
    """
    waiting = jobs.where(~c("running") & c("job_class").isin(list(slots)))
    limit = F.coalesce(*[F.when(c("job_class") == k, F.lit(n)) for k, n in slots.items()])
    most = max(slots.values())
    order = ["arrival", "request_id", "filepath"]

    part = F.pmod(F.xxhash64("filepath"), F.lit(spread))
    in_part = Window.partitionBy("job_class", "_part").orderBy(*order)
    leading = (
        waiting.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(in_part))
        .where(c("_rank") <= most)
        .where(c("_rank") <= limit)
    )
    in_class = Window.partitionBy("job_class").orderBy(*order)
    ranked = leading.withColumn("_rank", F.row_number().over(in_class)).where(c("_rank") <= most)

    # At most one row per class.
    busy = jobs.where("running").groupBy("job_class").agg(F.count("*").alias("_busy"))
    free = limit - F.coalesce(c("_busy"), F.lit(0))
    return (
        ranked.join(F.broadcast(busy), "job_class", "left")
        .where(c("_rank") <= free)
        .withColumn("position", c("_rank"))
        .drop("_part", "_rank", "_busy")
    )


def versions(
    cached: DataFrame, ids: DataFrame, type_: str = mime.ANY_TYPE, parsed: bool = False
) -> DataFrame:
    """Stored renditions of the ids asked for, of one type or of any (``*``).

    The parsed form has ``type, width, height, angle, mirror`` of each.
    """
    if type_ not in (*mime.EXTENSION_BY_TYPE, mime.ANY_TYPE):
        raise ValueError(f"Unknown format type, {type_}")
    extension = F.lit(mime.EXTENSION_BY_TYPE.get(type_))
    listing = cached.where(keys.has_extension(c("name"), extension)).select(
        keys.id_of_key(c("name")).alias("id"), "name", "filepath"
    )
    found = listing.join(_wanted(ids), "id", "left_semi")
    if not parsed:
        return found.select("id", "filepath")
    return found.select("id", "filepath", keys.parse_key(c("name")).alias("k")).select(
        "id", "filepath", "k.*"
    )


def _wanted(ids: DataFrame) -> DataFrame:
    """Ids as text. Repeated ones do no harm, as they only enter semi and anti joins."""
    return ids.select(c("id").cast("string").alias("id"))


def remove(cached: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored renditions split into those of the ids (to delete) and the remaining ones."""
    listing = cached.withColumn("id", keys.id_of_key(c("name")))
    wanted = _wanted(ids)
    return listing.join(wanted, "id", "left_semi"), listing.join(wanted, "id", "left_anti")


def removed_count(to_delete: DataFrame) -> DataFrame:
    return to_delete.agg(F.count("*").alias("removed"))
