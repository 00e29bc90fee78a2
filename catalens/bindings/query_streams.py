"""Streaming queries: each runs over a whole table and ends when all of it is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.bindings import views
from catalens.bindings.query_files import (
    _ANGLE, _DEVICE_TIME, _TYPED_EXIF, _TYPED_RECORDS, _date_columns,
)
from catalens.bindings.registry import query
from catalens.bindings.sql_views import with_views
from catalens.functions import dates
from catalens.operators import lookup
from catalens.sources import manifest
from catalens.sources.shared import shared_folder
from catalens.streaming import in_flight, metadata_stream, request_stream

c = F.col
HORIZON = "1 hour"


def _stream(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder: a pattern may stand for either."""
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _keyed_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    return lookup.with_key(views.requests_of(events), views.CACHE)


# Parts of a staged stream, and files of each.
STAGED_PARTS, STAGED_FILES = 4, 8
TICK = "tick"
# Their clock runs so many times as fast, or hardly two requests of a path would meet.
FASTER = 200


def _staged_requests(spark, sf_dir):
    """Keyed requests written in order of time as several micro-batches, then a tick a day later."""
    folder = shared_folder(spark, "staged")
    faster = F.timestamp_micros(F.expr(f"unix_micros(cast(ts AS timestamp)) div {FASTER}"))
    events = views.table(spark, sf_dir, "events").withColumn("ts", faster)
    keyed = lookup.with_key(views.requests_of(events), views.CACHE).select("request_id", "filepath", "ts", "error")
    shares = [i / STAGED_PARTS for i in range(1, STAGED_PARTS)]
    micros = F.unix_micros("ts")
    bounds, last = keyed.agg(F.percentile_approx(micros, shares), F.max(micros)).first()
    edges = [None, *(bounds or []), None]
    for low, high in zip(edges, edges[1:]):
        part = keyed if low is None else keyed.where(micros > low)
        part = part if high is None else part.where(micros <= high)
        part.repartition(STAGED_FILES).write.mode("append").parquet(folder)
    tick = spark.range(1).select(
        F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("filepath"),
        (F.timestamp_micros(F.lit(last or 0)) + F.expr("INTERVAL 1 day")).alias("ts"), F.lit(TICK).alias("error"),
    )
    tick.write.mode("append").parquet(folder)

    def stream():
        reader = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", STAGED_FILES)
        return reader.parquet(folder)

    return stream, folder


def _staged_arrivals(spark, sf_dir):
    """Every third request stands for a job that ends twenty minutes later, every sixth one well."""
    stream, folder = _staged_requests(spark, sf_dir)
    ended = lookup.valid(stream()).where(c("request_id") % 3 == 0).select(
        "filepath",
        (c("ts") + F.expr("INTERVAL 20 minutes")).alias("outcome_ts"),
        F.when(c("request_id") % 2 == 0, "done").otherwise("failed").alias("outcome"),
    )
    clock = stream().where(c("error") == TICK)
    return in_flight.arrivals(stream(), ended, clock), f"{folder}-run"


_FAST = f"""
  SELECT request_id, filepath, make_timestamp(epoch_us(ts) // {FASTER}) AS ts FROM keyed WHERE error IS NULL"""
_ENDED = f"""
  SELECT filepath, ts + INTERVAL 20 minutes AS outcome_ts,
    CASE WHEN request_id % 2 = 0 THEN 'done' ELSE 'failed' END AS outcome
  FROM ({_FAST}) WHERE request_id % 3 = 0"""


def _clock(column: str, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    """Instant as text in session time: the given times have no zone."""
    return F.date_format(column, pattern).alias(column)


@query(
    "t1_single_flight",
    with_views("SELECT DISTINCT filepath FROM keyed WHERE error IS NULL", "keyed"),
)
def t1_single_flight(spark, sf_dir):
    """Paths admitted. The table is one file, so one batch, in which a path is admitted once."""
    folder = shared_folder(spark, "t1")
    admitted = request_stream.admit_once(_keyed_stream(spark, sf_dir), HORIZON)
    request_stream.run_appending(admitted, folder).awaitTermination()
    rows = request_stream.read_rows(spark, folder, "filepath string, ts timestamp")
    return rows.select("filepath")


@query(
    "t1_admission",
    with_views(
        f"""
SELECT r.request_id, r.filepath, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM (SELECT filepath, ts, min(request_id) AS request_id FROM ({_FAST}) GROUP BY ALL) r
JOIN (
  WITH RECURSIVE asked AS (SELECT DISTINCT filepath, ts FROM ({_FAST})),
  flights AS (
    SELECT a.filepath, a.ts, least(min(e.outcome_ts), a.ts + INTERVAL 1 hour) AS until
    FROM asked a LEFT JOIN ({_ENDED}) e ON e.filepath = a.filepath AND e.outcome_ts >= a.ts
    GROUP BY a.filepath, a.ts
  ), admitted AS (
    SELECT filepath, min(ts) AS ts FROM asked GROUP BY filepath
    UNION ALL
    SELECT m.filepath, min(a.ts)
    FROM admitted m JOIN flights f ON f.filepath = m.filepath AND f.ts = m.ts
    JOIN asked a ON a.filepath = m.filepath AND a.ts > f.until
    GROUP BY m.filepath
  )
  SELECT * FROM admitted) m ON m.filepath = r.filepath AND m.ts = r.ts""",
        "keyed",
    ),
)
def t1_admission(spark, sf_dir):
    """Requests that start a job: their path is not in flight, be it new, ended or given up."""
    arriving, folder = _staged_arrivals(spark, sf_dir)
    in_flight.run_appending(in_flight.admissions(arriving, 3600), folder).awaitTermination()
    rows = request_stream.read_rows(spark, folder, "request_id bigint, filepath string, ts timestamp")
    return rows.select("request_id", "filepath", _clock("ts"))


@query(
    "t1_flight_windows",
    with_views(
        """
SELECT filepath, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  arg_min(request_id, (ts, request_id)) AS first_request,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS arrival, count(*) AS waiters
FROM keyed WHERE error IS NULL GROUP BY filepath, time_bucket(INTERVAL 1 hour, ts)""",
        "keyed",
    ),
)
def t1_flight_windows(spark, sf_dir):
    folder = shared_folder(spark, "t1w")
    flights = request_stream.flight_windows(_keyed_stream(spark, sf_dir), HORIZON)
    request_stream.run_batches(flights, folder, mode="update").awaitTermination()
    schema = (
        "filepath string, window_start timestamp, first_request bigint, arrival timestamp, "
        "waiters bigint, batch bigint"
    )
    changes = request_stream.read_rows(spark, folder, schema)
    return request_stream.latest(changes, "filepath", "window_start").select(
        "filepath", _clock("window_start", "yyyy-MM-dd HH:mm:ss"), "first_request",
        _clock("arrival"), "waiters",
    )


@query(
    "t2_hit_miss",
    with_views(
        """
SELECT k.request_id, k.filepath, s.filepath IS NOT NULL AS hit
FROM keyed k LEFT JOIN cached s ON k.filepath = s.filepath WHERE k.error IS NULL""",
        "keyed", "cached",
    ),
)
def t2_hit_miss(spark, sf_dir):
    """Requests of several batches against a manifest, of which each batch reads its own buckets."""
    folder = shared_folder(spark, "t2")
    stored = f"{folder}/manifest"
    manifest.write_manifest(manifest.manifest_rows(views.cached(spark, sf_dir)), stored, "stored")
    stream, _ = _staged_requests(spark, sf_dir)
    run = request_stream.lookup_stream(
        stream(), lambda: manifest.read_manifest(spark, stored).select("filepath", "bucket"), folder
    )
    run.awaitTermination()
    schema = "request_id bigint, filepath string, hit boolean, batch bigint"
    return request_stream.read_rows(spark, folder, schema).drop("batch")


@query(
    "t3_pair_outcomes",
    with_views(
        """
SELECT r.request_id, r.filepath, strftime(d.outcome_ts, '%Y-%m-%d %H:%M:%S.%f') AS outcome_ts, d.outcome
FROM (SELECT * FROM keyed WHERE error IS NULL) r JOIN (
  SELECT filepath, ts + INTERVAL 20 minutes AS outcome_ts,
    CASE WHEN request_id % 2 = 0 THEN 'done' ELSE 'failed' END AS outcome
  FROM keyed WHERE error IS NULL AND request_id % 3 = 0) d
ON d.filepath = r.filepath AND d.outcome_ts >= r.ts AND d.outcome_ts <= r.ts + INTERVAL 30 minutes""",
        "keyed",
    ),
)
def t3_pair_outcomes(spark, sf_dir):
    """Every third request stands for a job that ends twenty minutes later."""
    folder = shared_folder(spark, "t3")
    jobs = lookup.valid(_keyed_stream(spark, sf_dir)).where(c("request_id") % 3 == 0)
    outcomes = jobs.select(
        "filepath",
        (c("ts") + F.expr("INTERVAL 20 minutes")).alias("outcome_ts"),
        F.when(c("request_id") % 2 == 0, "done").otherwise("failed").alias("outcome"),
    )
    paired = request_stream.pair_outcomes(_keyed_stream(spark, sf_dir), outcomes)
    request_stream.run_appending(paired, folder).awaitTermination()
    schema = "request_id bigint, filepath string, outcome_ts timestamp, outcome string"
    rows = request_stream.read_rows(spark, folder, schema)
    return rows.select("request_id", "filepath", _clock("outcome_ts"), "outcome")


@query(
    "t3_answers",
    with_views(
        f"""
SELECT k.request_id, k.filepath,
  strftime(coalesce(min(e.outcome_ts), k.ts + INTERVAL 30 minutes), '%Y-%m-%d %H:%M:%S.%f') AS answered_ts,
  coalesce(arg_min(e.outcome, (e.outcome_ts, e.outcome)), 'timed out') AS outcome
FROM ({_FAST}) k LEFT JOIN ({_ENDED}) e
  ON e.filepath = k.filepath AND e.outcome_ts >= k.ts AND e.outcome_ts <= k.ts + INTERVAL 30 minutes
GROUP BY k.request_id, k.filepath, k.ts""",
        "keyed",
    ),
)
def t3_answers(spark, sf_dir):
    """Every valid request with the one outcome that its waiter sees."""
    arriving, folder = _staged_arrivals(spark, sf_dir)
    hot = in_flight.hot_paths(views.keyed(spark, sf_dir))
    answered = in_flight.answers(arriving, 1800, hot=hot)
    in_flight.run_appending(answered, folder).awaitTermination()
    schema = "request_id bigint, filepath string, answered_ts timestamp, outcome string"
    rows = request_stream.read_rows(spark, folder, schema)
    return rows.select("request_id", "filepath", _clock("answered_ts"), "outcome")


@query(
    "t4_live_status",
    with_views(
        """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  CASE WHEN type IN ('image', 'document') THEN 'image' WHEN type IN ('video', 'audio') THEN 'video' END AS job_class,
  count(*) AS requests FROM keyed WHERE error IS NULL GROUP BY ALL""",
        "keyed",
    ),
)
def t4_live_status(spark, sf_dir):
    folder = shared_folder(spark, "t4")
    counts = request_stream.class_counts(_keyed_stream(spark, sf_dir), "1 hour")
    request_stream.run_batches(counts, folder, mode="update").awaitTermination()
    schema = "window_start timestamp, job_class string, requests bigint, batch bigint"
    changes = request_stream.read_rows(spark, folder, schema)
    return request_stream.latest(changes, "window_start", "job_class").select(
        _clock("window_start", "yyyy-MM-dd HH:mm:ss"), "job_class", "requests"
    )


@query(
    "t5_metadata_stream",
    with_views(
        f"""
SELECT id, "FileName" AS name, type, maker AS make, {_ANGLE} AS angle, {_date_columns("device_time", "device_")}
FROM (SELECT *, {_DEVICE_TIME} AS device_time FROM {_TYPED_EXIF})""",
        "exif",
    ),
)
def t5_metadata_stream(spark, sf_dir):
    folder = shared_folder(spark, "t5")
    lines = _stream(spark, sf_dir, "lineitem")
    numbered = lines.select((c("l_orderkey") * 7 + c("l_linenumber")).alias("id"))
    tags = views.tag_values(c("id"))
    tags["DateTimeOriginal"] = dates.drop_blank(tags["DateTimeOriginal"])
    rows = numbered.select("id", *[v.alias(k) for k, v in tags.items()])
    records = metadata_stream.metadata_stream(rows, "id")
    parts = [*dates.DATE_PARTS, "timezone"]
    flat = records.select(
        "id", "name", "type", c("deviceinfo.make").alias("make"), "angle",
        *[c(f"when.device.{p}").alias(f"device_{p}") for p in parts],
    )
    request_stream.run_appending(flat, folder).awaitTermination()
    schema = "id bigint, name string, type string, make string, angle int, " + ", ".join(
        f"device_{p} string" for p in parts
    )
    return request_stream.read_rows(spark, folder, schema)


# Hours at which tags, secondary types and the closing ticks of a file's hour arrive.
_TAGS_LATER, _TYPES_LATER, _FIRST_HOUR, _LAST_HOUR = (7, [0, 1, 2]), (5, [0, 1, 0, 2]), 1000, 1100


def _later(n, rule):
    modulus, hours = rule
    rest = n % modulus
    return F.coalesce(*[F.when(rest == k, F.lit(h)) for k, h in enumerate(hours)], F.lit(0))


def _in_time(column, rule):
    """SQL: not later than the hour that a record waits."""
    modulus, hours = rule
    return f"{column} % {modulus} NOT IN ({', '.join(str(k) for k, h in enumerate(hours) if h > 1)})"


_IN_TIME = _TYPED_RECORDS.replace(
    "dumped", f"(SELECT * FROM dumped WHERE {_in_time('id', _TAGS_LATER)})"
).replace(
    "mime_feed",
    f"(SELECT m.* FROM mime_feed m JOIN files f ON f.path = m.path WHERE {_in_time('f.id', _TYPES_LATER)})",
)


@query(
    "t5_file_records",
    with_views(
        f"""
SELECT path, size, sha1(content) AS sha1, md5(content) AS md5, "FileName" AS name, "MIMEType" AS mimetype, type,
  CASE WHEN NOT ok AND fallback IS NULL THEN 'Neither tags nor MIME type could be read' END AS error
FROM {_IN_TIME}""",
        "files", "dumped", "mime_feed",
    ),
)
def t5_file_records(spark, sf_dir):
    """Files, tags and secondary types arrive hour by hour, some of them later than a record waits."""
    folder = shared_folder(spark, "records")
    files = views.files(spark, sf_dir)
    hour = _FIRST_HOUR + c("id") % 2
    sums = [F.sha1("content").alias("sha1"), F.md5("content").alias("md5")]
    media = files.select("path", "length", *sums, F.timestamp_seconds(hour * 3600).alias("ts"), "id")
    tick = spark.range(1).select(F.lit("tick").alias("path"), F.timestamp_seconds(F.lit(_LAST_HOUR * 3600)).alias("ts"))
    hours = range(_FIRST_HOUR, _FIRST_HOUR + 4)
    for n in hours[:2]:
        media.where(hour == n).drop("id").repartition(STAGED_FILES).write.mode("append").parquet(f"{folder}/files")
    last = tick.select(*[c(f) if f in tick.columns else F.lit(None).cast(t).alias(f) for f, t in media.drop("id").dtypes])
    last.write.mode("append").parquet(f"{folder}/files")

    dumped = files.where(c("id") % 10 != 9).select("path", "id")
    typed = views.mime_feed(spark, sf_dir).join(files.select("path", "id"), "path")
    for n in (*hours, _LAST_HOUR):
        if n == _LAST_HOUR:
            lines = tick.select(F.to_json(F.array(F.struct(c("path").alias("SourceFile")))).alias("value"))
            records = tick.select("path", F.lit("x").alias("mimetype"))
        else:
            lines = views.dumps_of(dumped.where(hour + _later(c("id"), _TAGS_LATER) == n), c("id"))
            lines = lines.select(c("dump").alias("value"))
            records = typed.where(hour + _later(c("id"), _TYPES_LATER) == n)
            records = records.select("path", F.trim(F.regexp_replace("mimetype", "\n", "")).alias("mimetype"))
        lines.repartition(STAGED_FILES).write.text(f"{folder}/dumps/h{n}")
        records.repartition(STAGED_FILES).write.csv(f"{folder}/types/h{n}")

    # The hour is the name of the folder that a file arrives in.
    arrived = F.timestamp_seconds(F.regexp_extract("_metadata.file_path", "/h([0-9]+)/", 1).cast("int") * 3600)
    reader = spark.readStream.schema(media.drop("id").schema).option("maxFilesPerTrigger", STAGED_FILES)
    found = metadata_stream.records_stream(
        reader.parquet(f"{folder}/files"),
        metadata_stream.stream_dumps(spark, f"{folder}/dumps/*", STAGED_FILES, arrived),
        metadata_stream.stream_feed(spark, f"{folder}/types/*", STAGED_FILES, arrived),
    )
    flat = found.select("path", "size", "sha1", "md5", "name", "mimetype", "type", "error")
    request_stream.run_appending(flat, f"{folder}/run").awaitTermination()
    rows = request_stream.read_rows(spark, f"{folder}/run", flat.schema).where("path <> 'tick'")
    # Dates are the concern of another query.
    unread = F.when(c("error").startswith("Neither"), c("error"))
    return rows.select("path", "size", "sha1", "md5", "name", "mimetype", "type", unread.alias("error"))
