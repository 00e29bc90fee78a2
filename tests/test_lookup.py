"""Lookup, collapse, admission and expiry on small tables and on very uneven ones."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalens.operators import lookup
from catalens.plans import render, routing, steps

c = F.col
SCHEMA = (
    "request_id bigint, ts timestamp_ntz, id string, filename string, type string, width int, "
    "height int, angle string, mirror string, timeindex double, deinterlace boolean"
)


def request(n, type_="image", **more):
    row = dict(
        request_id=n, ts=datetime.datetime(2024, 1, 1, 0, 0, n % 60), id="7", filename="/in/a.jpg",
        type=type_, width=20, height=None, angle=None, mirror=None, timeindex=None, deinterlace=None,
    )
    return {**row, **more}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, *names):
    return spark.createDataFrame([(f"/cache/{n}", n) for n in names], "filepath string, name string")


def media(spark, *rows):
    return spark.createDataFrame(
        rows, "path string, mimetype string, width int, height int, compression string"
    )


def test_lookup_status(spark):
    rows = [
        request(1),
        request(2, width=30),
        request(3, width=30, filename="/in/none"),
        request(4, angle="45"),
        request(5, "sticker"),
        request(6, "*", width=30),
        # Stored already: the missing source does not matter.
        request(7, filename="/in/none"),
        request(8, width=31, filename=None),
    ]
    files = spark.createDataFrame([("/in/a.jpg",)], "path string")
    cached = stored(spark, "7_w20_h0_s0_a0_m0.jpg").union(stored(spark, "7_w20_h0_s0_a0_m0.jpg"))
    found = {
        r.request_id: (r.status, r.error)
        for r in lookup.lookup(table(spark, rows), cached, files, "/cache/").collect()
    }
    assert found == {
        1: ("hit", None),
        2: ("miss", None),
        3: ("error", "No such file, /in/none"),
        4: ("error", "Valid angle values are: -270, -180, -90, 90, 180 and 270"),
        5: ("error", "Unknown format type, sticker"),
        6: ("unroutable", None),
        7: ("hit", None),
        8: ("error", "No such file, undefined"),
    }


def test_first_request_decides(spark):
    rows = [
        request(9, filename="/in/b.jpg", timeindex=2.0),
        request(4, filename="/in/a.jpg", timeindex=1.0),
        request(64, filename="/in/c.jpg"),
        request(5, width=30),
    ]
    keyed = lookup.with_key(table(spark, rows), "/cache")
    jobs = {r.filepath: r for r in lookup.single_flight(keyed).collect()}
    job = jobs["/cache/7_w20_h0_s0_a0_m0.jpg"]
    assert (job.request_id, job.filename, job.timeindex, job.waiters) == (4, "/in/a.jpg", 1.0, 3)
    (conflict,) = lookup.key_conflicts(keyed).collect()
    assert (conflict.filename, conflict.timeindex, conflict.deinterlace) == (True, True, False)


def test_audio_and_video_share_a_path(spark):
    keyed = lookup.with_key(table(spark, [request(1, "audio"), request(2, "video")]), "/cache")
    (job,) = lookup.single_flight(keyed).collect()
    assert (job.type, job.waiters) == ("audio", 2)


def test_collapse_shrinks_before_the_shuffle(spark):
    """A path with half of all requests leaves each map task as one row."""
    rows = spark.range(200_000).select(
        c("id").alias("request_id"),
        F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"),
        F.when(c("id") % 2 == 0, F.lit("hot")).otherwise((c("id") % 1000).cast("string")).alias("id"),
        F.lit("/in/a.jpg").alias("filename"), F.lit("image").alias("type"), F.lit(20).alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("angle"),
        F.lit(None).cast("string").alias("mirror"), F.lit(None).cast("double").alias("timeindex"),
        F.lit(None).cast("boolean").alias("deinterlace"),
    )
    jobs = lookup.single_flight(lookup.with_key(rows, "/cache"))
    sizes = {r.filepath: r.waiters for r in jobs.collect()}
    assert sizes["/cache/hot_w20_h0_s0_a0_m0.jpg"] == 100_000 and sum(sizes.values()) == 200_000
    plan = jobs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") >= 1


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
}


@pytest.fixture
def split_early(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def uneven_requests(spark, rows=6000):
    """A third of all requests is for one path, and a third names one source."""
    return spark.range(rows, numPartitions=16).select(
        c("id").alias("request_id"),
        F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"),
        F.when(c("id") % 3 == 0, "hot").otherwise(c("id").cast("string")).alias("id"),
        F.when(c("id") % 3 == 1, "/in/hot").otherwise(F.concat(F.lit("/in/"), c("id"))).alias("filename"),
        F.lit("image").alias("type"),
        F.lit(20).alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.when(c("id") % 3 == 2, "45").alias("angle"),
        F.lit(None).cast("string").alias("mirror"),
        F.lit(None).cast("double").alias("timeindex"),
        F.lit(None).cast("boolean").alias("deinterlace"),
    )


def test_runtime_splits_a_hot_path(spark, split_early):
    requests = uneven_requests(spark).drop("angle").withColumn("angle", F.lit(None).cast("string"))
    keyed = lookup.with_key(requests, "/cache")
    cached = stored(spark, "hot_w20_h0_s0_a0_m0.jpg", "1_w20_h0_s0_a0_m0.jpg")
    answered = lookup.hit_or_miss(keyed, cached)
    assert answered.where("hit").count() == 2001 and answered.count() == 6000
    for joined in (answered, lookup.hits(keyed, cached), lookup.misses(keyed, cached)):
        assert "skew=true" in final_plan(joined.select("request_id", "filename", "filepath"))


def test_runtime_splits_a_hot_source(spark, split_early):
    keyed = lookup.with_key(uneven_requests(spark), "/cache")
    sources = media(spark, ("/in/hot", "image/jpeg", 350, 150, None))
    joined = routing.with_source(lookup.valid(keyed), sources)
    assert joined.count() == 2000
    assert "skew=true" in final_plan(joined)


def test_invalid_requests_do_not_meet_in_one_task(spark, split_early):
    """A third of the requests is invalid and has no path; none of the joins sees one value."""
    sources = spark.createDataFrame([("/in/hot",)], "path string")
    answered = lookup.lookup(uneven_requests(spark), stored(spark, "x"), sources, "/cache")
    assert answered.where("status = 'error'").count() == 4000
    assert answered.where("filepath IS NULL").count() == 2000


def test_runtime_splits_a_hot_id(spark, split_early):
    names = spark.range(6000, numPartitions=16).select(
        F.concat(
            F.when(c("id") % 3 == 0, "hot").otherwise(c("id").cast("string")),
            F.lit("_w"), c("id"), F.lit("_h0_s0_a0_m0.jpg"),
        ).alias("name")
    )
    cached = names.withColumn("filepath", F.concat(F.lit("/cache/"), c("name")))
    ids = spark.createDataFrame([("hot",), ("hot",), ("1",)], "id string")
    gone, kept = lookup.remove(cached, ids)
    assert gone.count() == 2001 and kept.count() == 3999
    assert "skew=true" in final_plan(gone)


def jobs_table(spark, rows):
    return spark.createDataFrame(
        rows,
        "filepath string, request_id bigint, job_class string, running boolean, arrival timestamp_ntz",
    )


@pytest.mark.parametrize("spread", [1, 7, 64])
def test_admission(spark, spread):
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (f"/c/{n}", n, "video" if n % 5 == 0 else "image", n < 6, start + datetime.timedelta(seconds=n // 3))
        for n in range(500)
    ] + [("/c/none", 1000, None, False, start)]
    admitted = lookup.admit(jobs_table(spark, rows), {"image": 20, "video": 4}, spread).collect()
    by_class = {k: sorted(r.request_id for r in admitted if r.job_class == k) for k in ("image", "video")}
    waiting = [n for n in range(6, 500)]
    # Running: 0 and 5 in video, 1 to 4 in image.
    assert by_class["image"] == [n for n in waiting if n % 5][:16]
    assert by_class["video"] == [n for n in waiting if n % 5 == 0][:2]


def test_full_class_admits_none(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("/c/1", 1, "video", True, start), ("/c/2", 2, "video", False, start)]
    assert lookup.admit(jobs_table(spark, rows), {"image": 4, "video": 1}).count() == 0


def test_versions_and_removal(spark):
    cached = stored(
        spark, "7_w20_h0_s0_a0_m0.jpg", "7_w30_h0_s0_a0_m0.jpg", "7_w0_h0_s1_a0_m0.webm",
        "8_w20_h0_s0_a0_m0.jpg", "a_b_w20_h0_s0_a0_m0.jpg", "notes.txt",
    )
    ids = spark.createDataFrame([(7,), (7,)], "id bigint")
    assert lookup.versions(cached, ids, "image").count() == 2
    assert lookup.versions(cached, ids).count() == 3
    widths = {r.width for r in lookup.versions(cached, ids, "image", parsed=True).collect()}
    assert widths == {20, 30}
    with pytest.raises(ValueError, match="Unknown format type"):
        lookup.versions(cached, ids, "sticker")
    gone, kept = lookup.remove(cached, ids)
    assert lookup.removed_count(gone).first().removed == 3 and kept.count() == 3
    # An id with an underscore is never found.
    odd = spark.createDataFrame([("a_b",)], "id string")
    assert lookup.versions(cached, odd).count() == 0


def test_plan_of_missing_renditions(spark):
    rows = [
        request(1, filename="/in/x.y.CR2", angle="90", width=20, height=30, mirror="true"),
        request(2, filename="/in/v.avi", type_="video", id="8", width=20, height=None, angle="-90"),
        request(3, filename="/in/v.avi", id="9", timeindex=12.0, deinterlace=True, width=None),
        request(4, filename="/in/s.mp3", id="10", width=None),
        request(5, filename="/in/d.odt", id="11"),
        request(6, filename="/in/d.pdf", type_="document", id="12"),
        request(7, filename="/in/s.mp3", type_="document", id="13"),
        request(8, filename="/in/gone", id="14"),
        request(9, filename="/in/x.y.CR2", id="15"),
    ]
    sources = media(
        spark,
        ("/in/x.y.CR2", "image/CR2", 350, 150, None),
        ("/in/v.avi", "video/avi", 560, 320, "dvsd"),
        ("/in/s.mp3", "audio/mpeg", None, None, None),
        ("/in/d.odt", "application/vnd.oasis.opendocument.text", None, None, None),
        ("/in/d.pdf", "application/pdf", None, None, None),
    )
    planned = render.plan(
        table(spark, rows), stored(spark, "15_w20_h0_s0_a0_m0.jpg"), sources, "/cache", "/work", 4
    )
    plans = {r.filepath.split("/")[-1].split("_")[0]: r for r in planned.collect()}
    assert set(plans) == {"7", "8", "9", "10", "11", "12", "13"}
    assert all(a is not None for p in plans.values() for s in p.steps or [] for a in s.args)

    def lines(id_):
        return [f"{s.step} {s.tool} {' '.join(s.args)}" for s in plans[id_].steps]

    w = "/work/7_w20_h30_s0_a90_m1.jpg"
    assert lines("7") == [
        f"1 ln -s /in/x.y.CR2 {w}/x.y.CR2",
        f"2 dcraw -dcbe -w -T {w}/x.y.CR2",
        f"3 convert {w}/x.y.tiff -set optionsion:filter:blur 0.8 -filter Lagrange -strip -rotate -90 +repage"
        f" -resize 20x -gravity Center -crop 20x30+0+0 +repage -quality 91 -flop +repage {w}/image2image.jpg",
    ]
    first, second = lines("8")
    assert "-vf yadif -vf scale=20:-1 -vf transpose=1 -codec:v libvpx" in first and "-threads 4 -an -pass 1" in first
    assert second.endswith("-threads 4 -codec:a libvorbis -b:a 128k -ar 44100 -pass 2 -f webm "
                           "/work/8_w20_h0_s0_a-90_m0.webm/video2video_pass2.webm")
    # Only the last filter is applied, so the video is turned and not scaled.
    assert (plans["8"].out_w, plans["8"].out_h) == (320, 560)
    assert "-filter:v yadif -ss 12 -vframes 1" in lines("9")[0] and "-resize 560x320" in lines("9")[1]
    assert "showwavespic=s=720x540:" in lines("10")[0] and "-resize x540" in lines("10")[1]
    assert [x.split()[1] for x in lines("11")] == ["unoconv", "convert", "convert", "convert"]
    assert "-resize 20x -quality" in lines("11")[3]
    assert lines("12") == [] and plans["12"].error is None
    assert plans["12"].result == "/in/d.pdf" and plans["7"].result == f"{w}/image2image.jpg"
    assert plans["8"].result == "/work/8_w20_h0_s0_a-90_m0.webm/video2video_pass2.webm"
    assert plans["13"].result is None
    assert plans["13"].error == (
        'Unknown conversion path from source type to destination type "document", mimetype is '
        '"audio/mpeg and filename is /in/s.mp3'
    )


def test_position_given_as_text(spark):
    rows = table(spark, [request(1, filename="/in/v.avi")]).withColumn("timeindex", F.lit("00:00:05"))
    sources = media(spark, ("/in/v.avi", "video/avi", 560, 320, None))
    (row,) = render.plan(rows, stored(spark, "x"), sources, "/cache", "/work").collect()
    assert row.steps[0].args[2:4] == ["-ss", "00:00:05"]


def test_expressions_stay_in_the_jvm(spark):
    """No Python in the plans of requests."""
    sources = media(spark, ("/in/a.jpg", "image/jpeg", 350, 150, None))
    planned = render.plan(table(spark, [request(1)]), stored(spark, "x"), sources, "/cache", "/work")
    assert "Python" not in planned._jdf.queryExecution().executedPlan().toString()


def test_routes(spark):
    assert routing.route_table(spark).count() == 7 == len(steps.CONVERTERS)


def test_requests_that_cannot_be_keyed(spark):
    rows = [request(1, id=None), request(2, id=None, type_="video"), request(3)]
    keyed = lookup.with_key(table(spark, rows), "/cache")
    got = {r.request_id: (r.filepath, r.error) for r in keyed.collect()}
    assert got[1] == got[2] == (None, "Missing id") and got[3][1] is None
    jobs = lookup.single_flight(keyed).collect()
    assert [r.waiters for r in jobs] == [1] and jobs[0].filepath is not None
    sized = table(spark, rows).withColumn("size_error", F.when(F.col("request_id") == 3, "bad size"))
    assert {r.error for r in lookup.with_key(sized, "/cache").collect()} == {"Missing id", "bad size"}


def test_only_missing_renditions_meet_sources(spark):
    rows = [request(i, id=str(i % 4), filename=f"/in/{i % 2}") for i in range(40)]
    rows += [request(100, id="9", filename="/gone"), request(101, id="9", filename="/in/1")]
    sources = media(spark, *((f"/in/{i}", "image/jpeg", 350, 150, None) for i in range(2)))
    keyed = lookup.valid(lookup.with_key(table(spark, rows), "/cache"))
    names = {r.name for r in keyed.select("name").distinct().collect()}
    kept = stored(spark, *sorted(n for n in names if n[0] in "012"))
    jobs = {r.filepath: r for r in render.jobs_to_render(table(spark, rows), kept, sources, "/cache").collect()}
    assert {p.split("/")[-1][0] for p in jobs} == {"3", "9"}
    nine = next(r for p, r in jobs.items() if p.split("/")[-1][0] == "9")
    assert (nine.request_id, nine.filename, nine.waiters) == (101, "/in/1", 1)
    three = next(r for p, r in jobs.items() if p.split("/")[-1][0] == "3")
    assert (three.request_id, three.waiters) == (3, 10)
