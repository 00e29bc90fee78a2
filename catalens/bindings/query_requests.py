"""Queries on requests: lookup, collapse, admission, routes, sizes and tool calls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalens.bindings import views
from catalens.bindings.registry import query
from catalens.bindings.sql_views import in_group, media_type, with_views
from catalens.functions import geometry, mime
from catalens.operators import jobs, lookup
from catalens.plans import render, routing, steps

c = F.col
SLOTS = {"image": 64, "video": 1}


# --- lookup -----------------------------------------------------------------------------


@query(
    "j1_hit_miss",
    with_views(
        """
SELECT k.request_id, k.filepath, s.filepath IS NOT NULL AS hit
FROM keyed k LEFT JOIN cached s ON k.filepath = s.filepath WHERE k.error IS NULL""",
        "keyed", "cached",
    ),
)
def j1_hit_miss(spark, sf_dir):
    answered = lookup.hit_or_miss(views.keyed(spark, sf_dir), views.cached(spark, sf_dir))
    return answered.select("request_id", "filepath", "hit")


@query(
    "j1_hits",
    with_views(
        """
SELECT request_id, filepath FROM keyed
WHERE error IS NULL AND filepath IN (SELECT filepath FROM cached)""",
        "keyed", "cached",
    ),
)
def j1_hits(spark, sf_dir):
    found = lookup.hits(views.keyed(spark, sf_dir), views.cached(spark, sf_dir))
    return found.select("request_id", "filepath")


@query(
    "j1_misses",
    with_views(
        """
SELECT request_id, filepath FROM keyed
WHERE error IS NULL AND filepath NOT IN (SELECT filepath FROM cached)""",
        "keyed", "cached",
    ),
)
def j1_misses(spark, sf_dir):
    missed = lookup.misses(views.keyed(spark, sf_dir), views.cached(spark, sf_dir))
    return missed.select("request_id", "filepath")


@query(
    "j2_missing_source",
    with_views(
        """
SELECT request_id, filename FROM keyed WHERE error IS NULL
  AND filepath NOT IN (SELECT filepath FROM cached) AND filename NOT IN (SELECT path FROM media)""",
        "keyed", "cached", "media",
    ),
)
def j2_missing_source(spark, sf_dir):
    missed = lookup.misses(views.keyed(spark, sf_dir), views.cached(spark, sf_dir))
    absent = lookup.missing_sources(missed, views.media(spark, sf_dir))
    return absent.select("request_id", "filename")


@query(
    "cache_get",
    with_views(
        """
SELECT request_id, filepath, status, CASE WHEN status = 'error'
  THEN coalesce(error, 'No such file, ' || filename) END AS error
FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'error'
    WHEN filepath IN (SELECT filepath FROM cached) THEN 'hit'
    WHEN filename NOT IN (SELECT path FROM media) THEN 'error'
    WHEN type = '*' THEN 'unroutable' ELSE 'miss' END AS status FROM keyed)""",
        "keyed", "cached", "media",
    ),
)
def cache_get(spark, sf_dir):
    return lookup.lookup(
        views.requests(spark, sf_dir),
        views.cached(spark, sf_dir),
        views.media(spark, sf_dir),
        views.CACHE,
    )


@query(
    "j4_versions",
    with_views(
        """
SELECT string_split(name, '_')[1] AS id, filepath FROM cached
WHERE string_split(name, '_')[1] IN (SELECT CAST(id AS VARCHAR) FROM asked_ids)
  AND ends_with(name, '.jpg')""",
        "cached", "asked_ids",
    ),
)
def j4_versions(spark, sf_dir):
    return lookup.versions(views.cached(spark, sf_dir), views.asked_ids(spark, sf_dir), "image")


@query(
    "j4_versions_parsed",
    with_views(
        """
SELECT DISTINCT CAST(id AS VARCHAR) AS id, filepath,
  CASE type WHEN 'audio' THEN 'video' WHEN '*' THEN NULL ELSE type END AS type,
  coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(angle, 0) AS angle,
  coalesce(mirror <> '', false) AS mirror, CASE WHEN type = '*' THEN 'Unknown extension, ' END AS error
FROM keyed WHERE error IS NULL AND request_id // 8 % 2 = 0 AND id IN (SELECT id FROM asked_ids)""",
        "keyed", "asked_ids",
    ),
)
def j4_versions_parsed(spark, sf_dir):
    return lookup.versions(
        views.cached(spark, sf_dir), views.asked_ids(spark, sf_dir), parsed=True
    )


@query(
    "j5_remove",
    with_views(
        """
SELECT filepath FROM cached
WHERE string_split(name, '_')[1] IN (SELECT CAST(id AS VARCHAR) FROM asked_ids)""",
        "cached", "asked_ids",
    ),
)
def j5_remove(spark, sf_dir):
    gone, _ = lookup.remove(views.cached(spark, sf_dir), views.asked_ids(spark, sf_dir))
    return gone.select("filepath")


@query(
    "j5_remaining",
    with_views(
        """
SELECT filepath FROM cached
WHERE string_split(name, '_')[1] NOT IN (SELECT CAST(id AS VARCHAR) FROM asked_ids)""",
        "cached", "asked_ids",
    ),
)
def j5_remaining(spark, sf_dir):
    _, kept = lookup.remove(views.cached(spark, sf_dir), views.asked_ids(spark, sf_dir))
    return kept.select("filepath")


@query(
    "a2_removed_count",
    with_views(
        """
SELECT count(*) AS removed FROM cached
WHERE string_split(name, '_')[1] IN (SELECT CAST(id AS VARCHAR) FROM asked_ids)""",
        "cached", "asked_ids",
    ),
)
def a2_removed_count(spark, sf_dir):
    gone, _ = lookup.remove(views.cached(spark, sf_dir), views.asked_ids(spark, sf_dir))
    return lookup.removed_count(gone)


# --- jobs -------------------------------------------------------------------------------


@query(
    "a1_single_flight",
    with_views(
        """
SELECT filepath, request_id, filename, type, width, height, angle, mirror, timeindex, deinterlace,
  strftime(arrival, '%Y-%m-%d %H:%M:%S.%f') AS arrival, waiters FROM flights""",
        "flights",
    ),
)
def a1_single_flight(spark, sf_dir):
    flights = lookup.single_flight(views.keyed(spark, sf_dir))
    return flights.withColumn("arrival", F.date_format("arrival", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "a1_key_conflicts",
    with_views(
        """
SELECT filepath, count(DISTINCT filename) > 1 AS filename,
  count(DISTINCT timeindex) + max(CASE WHEN timeindex IS NULL THEN 1 ELSE 0 END) > 1 AS timeindex,
  count(DISTINCT deinterlace) + max(CASE WHEN deinterlace IS NULL THEN 1 ELSE 0 END) > 1 AS deinterlace
FROM keyed WHERE error IS NULL GROUP BY filepath
HAVING count(DISTINCT (filename, coalesce(timeindex, -1), coalesce(CAST(deinterlace AS VARCHAR), ''))) > 1""",
        "keyed",
    ),
)
def a1_key_conflicts(spark, sf_dir):
    return lookup.key_conflicts(views.keyed(spark, sf_dir))


@query(
    "a3_job_status",
    with_views("SELECT job_class, running, count(*) AS jobs FROM jobs GROUP BY ALL", "jobs"),
)
def a3_job_status(spark, sf_dir):
    return lookup.status(views.jobs(spark, sf_dir))


INSTANTS = ["2024-01-01 00:10:00", "2024-01-02 12:00:00", "2024-01-09 06:30:00", "2024-01-30 00:00:00"]

# The first end of a path at or after a moment.
_NEXT = "(SELECT min(ended_ts) FROM ended e WHERE e.filepath = x.filepath AND e.ended_ts >= x.{at})"


def _records(spark, sf_dir):
    """Every second request has a job start two minutes after it, every third one an end after twenty."""
    keyed, n = views.keyed(spark, sf_dir), c("request_id")
    valid = lookup.valid(keyed)
    started = valid.where(n % 2 == 0).select("filepath", (c("ts") + F.expr("INTERVAL 2 minutes")).alias("started_ts"))
    ended = valid.where(n % 3 == 0).select(
        "filepath", (c("ts") + F.expr("INTERVAL 20 minutes")).alias("ended_ts"),
        F.when(n % 2 == 0, "done").otherwise("failed").alias("outcome"),
    )
    return jobs.job_table(keyed, started, ended)


_JOB_TABLE = f"""
WITH valid AS (SELECT filepath, request_id, type, ts FROM keyed WHERE error IS NULL),
started AS (SELECT filepath, ts + INTERVAL 2 minutes AS started_ts FROM valid WHERE request_id % 2 = 0),
ended AS (
  SELECT filepath, ts + INTERVAL 20 minutes AS ended_ts,
    min(CASE WHEN request_id % 2 = 0 THEN 'done' ELSE 'failed' END) AS outcome
  FROM valid WHERE request_id % 3 = 0 GROUP BY ALL
), asked AS (
  SELECT filepath, ended_ts, min(ts) AS arrival, arg_min((request_id, type), (ts, request_id)) AS first, count(*) AS waiters
  FROM (SELECT *, {_NEXT.format(at='ts')} AS ended_ts FROM valid x) GROUP BY ALL
), begun AS (
  SELECT filepath, ended_ts, min(started_ts) AS started_ts
  FROM (SELECT *, {_NEXT.format(at='started_ts')} AS ended_ts FROM started x) GROUP BY ALL
)
SELECT a.filepath, a.first[1] AS request_id, a.first[2] AS type, a.arrival, a.waiters, a.ended_ts, e.outcome,
  CASE WHEN b.started_ts IS NOT NULL THEN greatest(b.started_ts, a.arrival) END AS started_ts
FROM asked a LEFT JOIN begun b ON b.filepath = a.filepath AND b.ended_ts IS NOT DISTINCT FROM a.ended_ts
LEFT JOIN ended e ON e.filepath = a.filepath AND e.ended_ts = a.ended_ts"""


@query(
    "a3_job_table",
    with_views(
        f"""
SELECT filepath, request_id, waiters, outcome, {', '.join(
    f"strftime({t}, '%Y-%m-%d %H:%M:%S.%f') AS {t}" for t in ("arrival", "started_ts", "ended_ts"))}
FROM ({_JOB_TABLE})""",
        "keyed",
    ),
)
def a3_job_table(spark, sf_dir):
    times = [
        F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(t) for t in ("arrival", "started_ts", "ended_ts")
    ]
    return _records(spark, sf_dir).select("filepath", "request_id", "waiters", "outcome", *times)


@query(
    "a3_status_over_time",
    with_views(
        f"""
SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS "at", job_class, running, count(*) AS jobs FROM (
  SELECT moment, CASE WHEN type IN ('image', 'document') THEN 'image' WHEN type IN ('video', 'audio') THEN 'video' END AS job_class,
    coalesce(started_ts <= moment, false) AS running
  FROM ({_JOB_TABLE}) JOIN (SELECT unnest([{', '.join(f"TIMESTAMP '{t}'" for t in INSTANTS)}]) AS moment)
    ON arrival <= moment AND (ended_ts IS NULL OR ended_ts > moment))
GROUP BY ALL""",
        "keyed",
    ),
)
def a3_status_over_time(spark, sf_dir):
    alive = jobs.jobs_at(_records(spark, sf_dir), [datetime.fromisoformat(t) for t in INSTANTS])
    counts = lookup.status(alive, "at")
    return counts.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "w1_admission",
    with_views(
        f"""
SELECT filepath, request_id, job_class, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY job_class ORDER BY arrival, request_id, filepath) AS position
  FROM jobs WHERE NOT running AND job_class IS NOT NULL) w
WHERE position <= CASE job_class WHEN 'image' THEN {SLOTS['image']} ELSE {SLOTS['video']} END
  - (SELECT count(*) FROM jobs r WHERE r.running AND r.job_class = w.job_class)""",
        "jobs",
    ),
)
def w1_admission(spark, sf_dir):
    return lookup.admit(views.jobs(spark, sf_dir), SLOTS).select(
        "filepath", "request_id", "job_class", "position"
    )


# --- routes -----------------------------------------------------------------------------


def _routed(spark, sf_dir):
    jobs = render.jobs_to_render(
        views.requests(spark, sf_dir),
        views.cached(spark, sf_dir),
        views.media(spark, sf_dir),
        views.CACHE,
    )
    routable = jobs.where(lookup.job_class(c("type")).isNotNull())
    return steps.with_work_dir(routing.route(routable), "/work/render", 8)


_PATH_ERROR = (
    """'Unknown conversion path from source type to destination type "' || type || '", mimetype is "' || """
    "coalesce(mimetype, 'undefined') || ' and filename is ' || filename"
)


@query(
    "j3_route",
    with_views(
        f"""
SELECT filepath, filename, source_type, type, converter,
  CASE WHEN converter IS NULL THEN {_PATH_ERROR} END AS error FROM routed""",
        "routed",
    ),
)
def j3_route(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        "filepath", "filename", "source_type", "type", "converter", "error"
    )


_DEINTERLACE = """CASE converter WHEN 'video2video' THEN coalesce(compression = 'dvsd', false)
  WHEN 'video2image' THEN coalesce(deinterlace, false) END"""


@query(
    "p33_deinterlace",
    with_views(f"SELECT filepath, converter, {_DEINTERLACE} AS deinterlace FROM routed", "routed"),
)
def p33_deinterlace(spark, sf_dir):
    return _routed(spark, sf_dir).select("filepath", "converter", "deinterlace")


# --- geometry ---------------------------------------------------------------------------
# Geometry runs on every valid request whose source exists, whether stored already or not.


def _sized(spark, sf_dir):
    keyed = lookup.valid(views.keyed(spark, sf_dir))
    return routing.with_source(keyed, views.media(spark, sf_dir))


_SIZED = f"""(SELECT k.*, m.mimetype, m.width AS src_w, m.height AS src_h, m.compression,
  {media_type('m.mimetype')} AS source_type,
  CASE WHEN abs(angle) IN (90, 270) THEN m.height ELSE m.width END AS tw,
  CASE WHEN abs(angle) IN (90, 270) THEN m.width ELSE m.height END AS th
FROM keyed k JOIN media m ON m.path = k.filename WHERE k.error IS NULL)"""


@query(
    "g1_rotation_swap",
    with_views(f"SELECT request_id, CAST(-angle AS VARCHAR) AS rotate, tw, th FROM {_SIZED}", "keyed", "media"),
)
def g1_rotation_swap(spark, sf_dir):
    w, h = geometry.turned_size(c("angle"), c("src_w"), c("src_h"))
    return _sized(spark, sf_dir).select(
        "request_id", (-c("angle")).cast("string").alias("rotate"), w.alias("tw"), h.alias("th")
    )


# Sides asked for as numbers; 0 stands for a missing one.
_W, _H = "coalesce(width, 0)", "coalesce(height, 0)"


def _sql_target(tw: str, th: str) -> tuple[str, str]:
    neither = f"({_W} = 0 AND {_H} = 0)"
    return f"CASE WHEN {neither} THEN {tw} ELSE {_W} END", f"CASE WHEN {neither} THEN {th} ELSE {_H} END"


@query(
    "g2_target_size",
    with_views(
        f"SELECT request_id, {_sql_target('tw', 'th')[0]} AS w, {_sql_target('tw', 'th')[1]} AS h FROM {_SIZED}",
        "keyed", "media",
    ),
)
def g2_target_size(spark, sf_dir):
    turned = geometry.turned_size(c("angle"), c("src_w"), c("src_h"))
    w, h = geometry.target_size(c("width"), c("height"), *turned)
    return _sized(spark, sf_dir).select("request_id", w.alias("w"), h.alias("h"))


def _sql_resize(tw: str, th: str) -> str:
    cover = (
        f"CASE WHEN CAST({tw} AS DOUBLE) / nullif(CAST({th} AS DOUBLE), 0) < CAST({_W} AS DOUBLE) / "
        f"CAST({_H} AS DOUBLE) THEN {_W} || 'x' ELSE 'x' || {_H} END"
    )
    w, h = _sql_target(tw, th)
    fit = f"coalesce(CAST(nullif({w}, 0) AS VARCHAR), '') || 'x' || coalesce(CAST(nullif({h}, 0) AS VARCHAR), '')"
    return f"CASE WHEN {_H} <> 0 THEN {cover} ELSE {fit} END"


_CROP = f"CASE WHEN {_H} <> 0 THEN {_W} || 'x' || {_H} || '+0+0' END"


@query(
    "g3_cover_crop",
    with_views(
        f"""
SELECT request_id, {_sql_resize('tw', 'th')} AS resize, {_CROP} AS crop FROM {_SIZED}
WHERE {_H} <> 0""",
        "keyed", "media",
    ),
)
def g3_cover_crop(spark, sf_dir):
    turned = geometry.turned_size(c("angle"), c("src_w"), c("src_h"))
    return _sized(spark, sf_dir).where("height <> 0").select(
        "request_id",
        geometry.resize_spec(c("width"), c("height"), *turned).alias("resize"),
        geometry.crop_spec(c("width"), c("height")).alias("crop"),
    )


@query(
    "g4_fit",
    with_views(
        f"SELECT request_id, {_sql_resize('tw', 'th')} AS resize FROM {_SIZED} WHERE {_H} = 0",
        "keyed", "media",
    ),
)
def g4_fit(spark, sf_dir):
    turned = geometry.turned_size(c("angle"), c("src_w"), c("src_h"))
    fitted = _sized(spark, sf_dir).where(F.coalesce("height", F.lit(0)) == 0)
    return fitted.select(
        "request_id", geometry.resize_spec(c("width"), c("height"), *turned).alias("resize")
    )


@query(
    "g5_mirror",
    with_views(
        """
SELECT request_id, mirror, coalesce(mirror = 'true', false) AS flips,
  coalesce(contains(name, '_m1.'), false) AS in_key FROM keyed WHERE error IS NULL""",
        "keyed",
    ),
)
def g5_mirror(spark, sf_dir):
    return lookup.valid(views.keyed(spark, sf_dir)).select(
        "request_id",
        "mirror",
        geometry.flips(c("mirror")).alias("flips"),
        c("name").contains("_m1.").alias("in_key"),
    )


def _sql_scaled(asked: str, along: str, across: str) -> str:
    return (
        f"CAST(CASE WHEN {along} > 0 AND {across} > 0 THEN greatest(floor(CAST({asked} AS DOUBLE) * CAST({across} AS DOUBLE) / "
        f"CAST({along} AS DOUBLE) + 0.5::DOUBLE), 1) ELSE NULL END AS INTEGER)"
    )


def _sql_image_size(tw: str, th: str) -> tuple[str, str]:
    w = f"CASE WHEN {_W} <> 0 THEN {_W} WHEN {_H} <> 0 THEN {_sql_scaled(_H, th, tw)} ELSE {tw} END"
    h = f"CASE WHEN {_H} <> 0 THEN {_H} WHEN {_W} <> 0 THEN {_sql_scaled(_W, tw, th)} ELSE {th} END"
    return w, h


@query(
    "g6_image_size",
    with_views(
        f"""
SELECT request_id, {_sql_image_size('tw', 'th')[0]} AS out_w, {_sql_image_size('tw', 'th')[1]} AS out_h
FROM {_SIZED} WHERE source_type IN ('image', 'video')""",
        "keyed", "media",
    ),
)
def g6_image_size(spark, sf_dir):
    visual = _sized(spark, sf_dir).where(mime.media_type(c("mimetype")).isin("image", "video"))
    w, h = geometry.image_size(c("width"), c("height"), c("angle"), c("src_w"), c("src_h"))
    return visual.select("request_id", w.alias("out_w"), h.alias("out_h"))


_WAVE_W = "coalesce(nullif(width, 0), 720)"
_WAVE_H = f"coalesce(nullif(height, 0), CAST(floor(CAST({_WAVE_W} AS DOUBLE) / 1.3333::DOUBLE) AS INTEGER))"


@query(
    "g7_waveform_size",
    with_views(
        f"SELECT request_id, {_WAVE_W} AS w, {_WAVE_H} AS h FROM keyed WHERE error IS NULL", "keyed"
    ),
)
def g7_waveform_size(spark, sf_dir):
    w, h = geometry.waveform_size(c("width"), c("height"))
    return lookup.valid(views.keyed(spark, sf_dir)).select("request_id", w.alias("w"), h.alias("h"))


_SCALE = f"""CASE WHEN {_W} <> 0 AND {_H} <> 0 THEN 'scale=' || width || ':' || height
  WHEN {_W} <> 0 THEN 'scale=' || width || ':-1' WHEN {_H} <> 0 THEN 'scale=-1:' || height END"""
_TRANSPOSE = """CASE WHEN angle IN (90, -270) THEN 'transpose=2' WHEN angle IN (270, -90) THEN 'transpose=1'
  WHEN angle IN (180, -180) THEN 'transpose=1,transpose=1' END"""


def _sql_video_size() -> tuple[str, str]:
    w = f"CASE WHEN {_W} <> 0 THEN width WHEN {_H} <> 0 THEN {_sql_scaled('height', 'src_h', 'src_w')} ELSE src_w END"
    h = f"CASE WHEN {_H} <> 0 THEN height WHEN {_W} <> 0 THEN {_sql_scaled('width', 'src_w', 'src_h')} ELSE src_h END"
    return f"CASE WHEN angle IS NOT NULL THEN tw ELSE {w} END", f"CASE WHEN angle IS NOT NULL THEN th ELSE {h} END"


@query(
    "g14_video_scale",
    with_views(f"SELECT request_id, {_SCALE} AS scale FROM keyed WHERE error IS NULL", "keyed"),
)
def g14_video_scale(spark, sf_dir):
    return lookup.valid(views.keyed(spark, sf_dir)).select(
        "request_id", geometry.video_scale(c("width"), c("height")).alias("scale")
    )


@query(
    "g15_video_rotation",
    with_views(
        f"""
SELECT request_id, {_TRANSPOSE} AS rotation,
  coalesce({_TRANSPOSE}, {_SCALE}, CASE WHEN deinterlace THEN 'yadif' END) AS effective_filter,
  {_sql_video_size()[0]} AS out_w, {_sql_video_size()[1]} AS out_h FROM {_SIZED}""",
        "keyed", "media",
    ),
)
def g15_video_rotation(spark, sf_dir):
    filters = geometry.video_filters(c("deinterlace"), c("width"), c("height"), c("angle"))
    w, h = geometry.video_size(c("width"), c("height"), c("angle"), c("src_w"), c("src_h"))
    return _sized(spark, sf_dir).select(
        "request_id",
        geometry.video_rotation(c("angle")).alias("rotation"),
        geometry.effective_filter(filters).alias("effective_filter"),
        w.alias("out_w"),
        h.alias("out_h"),
    )


# --- tool calls -------------------------------------------------------------------------
# In SQL a call is (step, tool, arguments joined by spaces); each converter lists its own.


def _joined(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def _sql_image_call(source: str, tw: str, th: str) -> str:
    return _joined(
        source,
        "'-set optionsion:filter:blur 0.8 -filter Lagrange -strip'",
        "CASE WHEN angle IS NOT NULL THEN '-rotate ' || -angle || ' +repage' END",
        f"'-resize ' || {_sql_resize(tw, th)}",
        f"'-gravity Center -crop ' || {_CROP} || ' +repage'",
        "'-quality 91'",
        "CASE WHEN mirror = 'true' THEN '-flop +repage' END",
        "work_dir || '/image2image.jpg'",
    )


_TW = "CASE WHEN abs(angle) IN (90, 270) THEN src_h ELSE src_w END"
_TH = "CASE WHEN abs(angle) IN (90, 270) THEN src_w ELSE src_h END"
_BASE = "string_split(filename, '/')[-1]"
_STEM = "regexp_replace(string_split(filename, '/')[-1], '(.)\\.[^.]*$', '\\1')"
_IS_RAW = in_group("mimetype", "rawimage")
_WAVE_TW = f"CASE WHEN abs(angle) IN (90, 270) THEN {_WAVE_H} ELSE {_WAVE_W} END"
_WAVE_TH = f"CASE WHEN abs(angle) IN (90, 270) THEN {_WAVE_W} ELSE {_WAVE_H} END"
_IS_PDF = "mimetype = 'application/pdf'"
_SIZE = f"{_WAVE_W} || 'x' || {_WAVE_H}"


def _wave_image_call() -> str:
    """A waveform is drawn in the asked size, so both sides are set when it is resized."""
    call = _sql_image_call("work_dir || '/video2image.png'", "tw", "th")
    inner = f"""(SELECT * REPLACE ({_WAVE_W} AS width, {_WAVE_H} AS height), {_WAVE_TW} AS tw, {_WAVE_TH} AS th
      FROM routed WHERE converter = 'audio2image')"""
    return f"SELECT filepath, converter, 2 AS step, 'convert' AS tool, {call} AS args FROM {inner}"


_VIDEO_SHARED = _joined(
    "'-i ' || filename",
    "CASE WHEN compression = 'dvsd' THEN '-vf yadif' END",
    f"'-vf ' || {_SCALE}",
    f"'-vf ' || {_TRANSPOSE}",
    "'-codec:v libvpx -cpu-used 0 -b:v 500k -qmin 10 -qmax 42 -maxrate 500k -bufsize 1000k"
    " -max_muxing_queue_size 9999 -threads 8'",
)

# The arguments of the tool calls, as in catalens.plans.steps.
_SQL_CALLS: dict[str, list[tuple[str, str, str, str]]] = {
    # converter: (condition, step, tool, arguments)
    "image2image": [
        (_IS_RAW, "1", "ln", f"'-s ' || filename || ' ' || work_dir || '/' || {_BASE}"),
        (_IS_RAW, "2", "dcraw", f"'-dcbe -w -T ' || work_dir || '/' || {_BASE}"),
        (
            "true", f"CASE WHEN {_IS_RAW} THEN 3 ELSE 1 END", "convert",
            _sql_image_call(
                f"CASE WHEN {_IS_RAW} THEN work_dir || '/' || {_STEM} || '.tiff' "
                "WHEN mimetype = 'image/gif' THEN filename || '[0]' ELSE filename END",
                _TW, _TH,
            ),
        ),
    ],
    "audio2audio": [
        (
            "true", "1", "ffmpeg",
            "'-i ' || filename || ' -cpu-used 0 -maxrate 500k -bufsize 1000k -threads 8 -codec:a libvorbis"
            " -b:a 128k -ar 44100 -f webm ' || work_dir || '/audio2audio.webm'",
        ),
    ],
    "audio2image": [
        (
            "true", "1", "ffmpeg",
            f"'-i ' || filename || ' -filter_complex [0:a]aformat=channel_layouts=mono,compand,showwavespic=s=' || {_SIZE} || "
            f"':colors=#2185D0[fg];color=s=' || {_SIZE} || ':color=#E0E0E0,drawgrid=width=iw/10:height=ih/5:color=#CACACA[bg];"
            "[bg][fg]overlay=format=rgb,drawbox=x=(iw-w)/2:y=(ih-h)/2:w=iw:h=1:color=#2185D0 -frames:v 1 ' || "
            "work_dir || '/video2image.png'",
        ),
    ],
    "video2image": [
        (
            "true", "1", "ffmpeg",
            _joined(
                "'-i ' || filename",
                "CASE WHEN deinterlace THEN '-filter:v yadif' END",
                "CASE WHEN timeindex <> 0 THEN '-ss 12.5' END",
                "'-vframes 1 -qscale 0'",
                "work_dir || '/video2image.jpg'",
            ),
        ),
        ("true", "2", "convert", _sql_image_call("work_dir || '/video2image.jpg'", _TW, _TH)),
    ],
    "video2video": [
        (
            "true", "1", "ffmpeg",
            f"{_VIDEO_SHARED} || ' -an -pass 1 -f webm ' || work_dir || '/video2video_pass1.webm'",
        ),
        (
            "true", "2", "ffmpeg",
            f"{_VIDEO_SHARED} || ' -codec:a libvorbis -b:a 128k -ar 44100 -pass 2 -f webm ' || work_dir || "
            "'/video2video_pass2.webm'",
        ),
    ],
    "document2document": [
        (
            f"NOT {_IS_PDF}", "1", "unoconv",
            "'-f pdf -o ' || work_dir || '/document2document.pdf ' || filename",
        ),
    ],
    "document2image": [
        (
            f"NOT {_IS_PDF}", "1", "unoconv",
            "'-f pdf -o ' || work_dir || '/document2document.pdf ' || filename",
        ),
        (
            "true", f"CASE WHEN {_IS_PDF} THEN 1 ELSE 2 END", "convert",
            f"CASE WHEN {_IS_PDF} THEN filename ELSE work_dir || '/document2document.pdf' END || "
            "'[0] -thumbnail x590 -background white -alpha remove -quality 91 ' || work_dir || '/document2image1.jpg'",
        ),
        (
            "true", f"CASE WHEN {_IS_PDF} THEN 2 ELSE 3 END", "convert",
            "work_dir || '/document2image1.jpg -gravity center -background #EFEFEF -extent 600x600 -quality 91 ' || "
            "work_dir || '/document2image2.jpg'",
        ),
        (
            "true", f"CASE WHEN {_IS_PDF} THEN 3 ELSE 4 END", "convert",
            _sql_image_call("work_dir || '/document2image2.jpg'", "NULL::INTEGER", "NULL::INTEGER"),
        ),
    ],
}


def _sql_calls(*converters: str) -> str:
    rows = [
        f"SELECT filepath, converter, {step} AS step, '{tool}' AS tool, {args} AS args "
        f"FROM routed WHERE converter = '{name}' AND {condition}"
        for name in converters
        for condition, step, tool, args in _SQL_CALLS[name]
    ]
    if "audio2image" in converters:
        rows.append(_wave_image_call())
    return with_views("\nUNION ALL\n".join(rows), "routed")


def _calls(spark, sf_dir, *converters):
    wanted = _routed(spark, sf_dir).where(c("converter").isin(*converters))
    rows = steps.step_rows(steps.with_steps(wanted, list(converters)))
    return rows.withColumn("args", F.array_join("args", " "))


_STEP_QUERIES = {
    "g8_image_steps": ["image2image"],
    "g9_audio_steps": ["audio2audio"],
    "g10_waveform_steps": ["audio2image"],
    "g11_frame_steps": ["video2image"],
    "g12_video_steps": ["video2video"],
    "g13_document_steps": ["document2document", "document2image"],
    "g16_step_rows": list(steps.CONVERTERS),
}


def _step_query(converters):
    return lambda spark, sf_dir: _calls(spark, sf_dir, *converters)


for _name, _converters in _STEP_QUERIES.items():
    query(_name, _sql_calls(*_converters))(_step_query(_converters))


@query(
    "w3_first_page",
    with_views(
        f"""
SELECT filepath, mimetype,
  CASE WHEN converter = 'document2image' THEN CASE WHEN {_IS_PDF} THEN filename ELSE work_dir || '/document2document.pdf' END || '[0]'
    WHEN {_IS_RAW} THEN work_dir || '/' || {_STEM} || '.tiff'
    WHEN mimetype = 'image/gif' THEN filename || '[0]' ELSE filename END AS input
FROM routed WHERE converter IN ('document2image', 'image2image')""",
        "routed",
    ),
)
def w3_first_page(spark, sf_dir):
    wanted = ["document2image", "image2image"]
    planned = steps.with_steps(
        _routed(spark, sf_dir).where(c("converter").isin(*wanted)), wanted
    )
    reading = F.filter(
        "steps", lambda s: (s["tool"] == "convert") & ~s["args"][0].endswith("document2image1.jpg")
    )
    return planned.select("filepath", "mimetype", reading[0]["args"][0].alias("input"))


@query(
    "g17_threads",
    with_views(
        """
SELECT filepath, converter, step, 8 AS threads FROM (
  SELECT filepath, converter, unnest([1, 2]) AS step FROM routed WHERE converter = 'video2video'
  UNION ALL SELECT filepath, converter, 1 FROM routed WHERE converter = 'audio2audio')""",
        "routed",
    ),
)
def g17_threads(spark, sf_dir):
    wanted = ["video2video", "audio2audio"]
    planned = steps.with_steps(
        _routed(spark, sf_dir).where(c("converter").isin(*wanted)), wanted
    )
    rows = steps.step_rows(planned)
    position = F.array_position("args", "-threads").cast("int") + 1
    return rows.select(
        "filepath", "converter", "step",
        F.element_at("args", position).cast("int").alias("threads"),
    )


_PAGE = _sql_image_size("600", "600")
_PICTURE = _sql_image_size("tw", "th")
_VIDEO = _sql_video_size()


@query(
    "cache_plan",
    with_views(
        f"""
SELECT filepath, converter, waiters,
  CASE WHEN converter IN ('image2image', 'video2image') THEN {_PICTURE[0]} WHEN converter = 'document2image' THEN {_PAGE[0]}
    WHEN converter = 'audio2image' THEN {_WAVE_W} WHEN converter = 'video2video' THEN {_VIDEO[0]} END AS out_w,
  CASE WHEN converter IN ('image2image', 'video2image') THEN {_PICTURE[1]} WHEN converter = 'document2image' THEN {_PAGE[1]}
    WHEN converter = 'audio2image' THEN {_WAVE_H} WHEN converter = 'video2video' THEN {_VIDEO[1]} END AS out_h,
  CASE converter WHEN 'image2image' THEN CASE WHEN {_IS_RAW} THEN 3 ELSE 1 END WHEN 'audio2audio' THEN 1
    WHEN 'audio2image' THEN 2 WHEN 'video2image' THEN 2 WHEN 'video2video' THEN 2
    WHEN 'document2document' THEN CASE WHEN {_IS_PDF} THEN 0 ELSE 1 END
    WHEN 'document2image' THEN CASE WHEN {_IS_PDF} THEN 3 ELSE 4 END END AS calls,
  CASE WHEN converter = 'document2document' AND {_IS_PDF} THEN filename
    WHEN converter = 'document2document' THEN work_dir || '/document2document.pdf'
    WHEN converter = 'video2video' THEN work_dir || '/video2video_pass2.webm'
    WHEN converter = 'audio2audio' THEN work_dir || '/audio2audio.webm'
    WHEN converter IS NOT NULL THEN work_dir || '/image2image.jpg' END AS result,
  CASE WHEN converter IS NULL THEN {_PATH_ERROR} END AS error
FROM (SELECT *, {_TW} AS tw, {_TH} AS th FROM routed)""",
        "routed",
    ),
)
def cache_plan(spark, sf_dir):
    planned = render.plan(
        views.requests(spark, sf_dir),
        views.cached(spark, sf_dir),
        views.media(spark, sf_dir),
        views.CACHE,
        "/work/render",
    )
    return planned.select(
        "filepath", "converter", "result", "waiters", "out_w", "out_h",
        F.when(c("steps").isNotNull(), F.size("steps")).alias("calls"), "error",
    )


@query(
    "cache_summary",
    with_views(
        """
SELECT type, count(*) AS requests, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits,
  sum(CASE WHEN hit THEN 0 ELSE 1 END) AS misses FROM (
  SELECT k.type, s.filepath IS NOT NULL AS hit FROM keyed k LEFT JOIN cached s ON k.filepath = s.filepath
  WHERE k.error IS NULL) GROUP BY type""",
        "keyed", "cached",
    ),
)
def cache_summary(spark, sf_dir):
    """Hits and misses by type: the flagship query."""
    answered = lookup.hit_or_miss(views.keyed(spark, sf_dir), views.cached(spark, sf_dir))
    hit = c("hit").cast("bigint")
    return answered.groupBy("type").agg(
        F.count("*").alias("requests"), F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses")
    )
