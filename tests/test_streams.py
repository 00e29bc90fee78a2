"""Streams over several batches against the same operator on the whole table."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalens.operators import lookup
from catalens.streaming import request_stream as rs

c = F.col
SCHEMA = (
    "request_id bigint, ts timestamp, id string, filename string, type string, width int, height int, "
    "angle string, mirror string, timeindex double, deinterlace boolean"
)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Requests of three hours in six files, in order of time; a third is for one path."""
    folder = str(tmp_path_factory.mktemp("requests"))
    start = datetime.datetime(2024, 1, 1)
    for part in range(6):
        rows = [
            (
                n, start + datetime.timedelta(seconds=18 * n), "hot" if n % 3 == 0 else str(n % 20), f"/in/{n % 7}",
                ["image", "video", "audio", "document", "*"][n % 5] if n % 3 else "image",
                20, None, "45" if n % 17 == 0 else None, None, None, None,
            )
            for n in range(part * 100, part * 100 + 100)
        ]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def batch(spark, source):
    return lookup.with_key(spark.read.schema(SCHEMA).parquet(source), "/cache")


def stream(spark, source, files=2):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files)
    return lookup.with_key(reader.parquet(source), "/cache")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_admission_once(spark, source, tmp_path):
    rs.run_appending(rs.admit_once(stream(spark, source), "10 hours"), str(tmp_path)).awaitTermination()
    admitted = rs.read_rows(spark, str(tmp_path), "filepath string, ts timestamp")
    paths = [r.filepath for r in admitted.collect()]
    assert len(paths) == len(set(paths))
    assert set(paths) == {r.filepath for r in lookup.valid(batch(spark, source)).select("filepath").collect()}


def test_admission_again_after_the_horizon(spark, source, tmp_path):
    rs.run_appending(rs.admit_once(stream(spark, source, 1), "10 minutes"), str(tmp_path)).awaitTermination()
    admitted = rs.read_rows(spark, str(tmp_path), "filepath string, ts timestamp")
    assert admitted.where("filepath LIKE '%/hot_%'").count() > 1


def test_flight_windows(spark, source, tmp_path):
    flights = rs.flight_windows(stream(spark, source), "1 hour")
    rs.run_batches(flights, str(tmp_path), mode="update").awaitTermination()
    schema = (
        "filepath string, window_start timestamp, first_request bigint, arrival timestamp, waiters bigint, batch bigint"
    )
    got = rs.latest(rs.read_rows(spark, str(tmp_path), schema), "filepath", "window_start")
    whole = rs.flight_windows(batch(spark, source), "1 hour")
    assert rows(got.select(*whole.columns)) == rows(whole)


def test_hits_see_new_files_between_batches(spark, source, tmp_path):
    cached = spark.createDataFrame([("/cache/hot_w20_h0_s0_a0_m0.jpg",)], "filepath string")
    seen = []

    def read_cached():
        seen.append(spark.conf.get("spark.sql.adaptive.enabled"))
        return cached

    rs.lookup_stream(stream(spark, source), read_cached, str(tmp_path)).awaitTermination()
    got = rs.read_rows(spark, str(tmp_path), "request_id bigint, filepath string, hit boolean, batch bigint")
    expected = lookup.hit_or_miss(batch(spark, source), cached).select("request_id", "filepath", "hit")
    assert len(seen) == 3 and rows(got.drop("batch")) == rows(expected)


def test_batches_are_planned_adaptively(spark, source, tmp_path):
    """A batch is an ordinary query: the runtime may split its joins."""
    seen = []

    def check(frame):
        seen.append(frame.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return frame

    rs.run_batches(stream(spark, source, 6), str(tmp_path), check).awaitTermination()
    assert seen == ["true"]


def test_pairing(spark, source, tmp_path):
    def outcomes(keyed):
        ended = lookup.valid(keyed).where("request_id % 4 = 0")
        return ended.select(
            "filepath", (c("ts") + F.expr("INTERVAL 5 minutes")).alias("outcome_ts"), F.lit("done").alias("outcome")
        )

    paired = rs.pair_outcomes(stream(spark, source), outcomes(stream(spark, source)))
    rs.run_appending(paired, str(tmp_path)).awaitTermination()
    schema = "request_id bigint, filepath string, ts timestamp, outcome_ts timestamp, outcome string"
    got = rs.read_rows(spark, str(tmp_path), schema)
    requests = lookup.valid(batch(spark, source)).select("request_id", "filepath", "ts")
    ended = outcomes(batch(spark, source))
    whole = requests.join(ended, "filepath").where(
        "outcome_ts >= ts AND outcome_ts <= ts + INTERVAL 30 minutes"
    )
    assert rows(got) == rows(whole.select(*got.columns)) and got.count() > 100


def test_live_counts(spark, source, tmp_path):
    counts = rs.class_counts(stream(spark, source), "1 hour")
    rs.run_batches(counts, str(tmp_path), mode="update").awaitTermination()
    schema = "window_start timestamp, job_class string, requests bigint, batch bigint"
    got = rs.latest(rs.read_rows(spark, str(tmp_path), schema), "window_start", "job_class")
    whole = rs.class_counts(batch(spark, source), "1 hour")
    assert rows(got.select(*whole.columns)) == rows(whole)


def test_run_again_adds_nothing(spark, source, tmp_path):
    """The checkpoint remembers what was processed."""
    for _ in range(2):
        rs.lookup_stream(
            stream(spark, source), lambda: spark.createDataFrame([], "filepath string"), str(tmp_path)
        ).awaitTermination()
    got = rs.read_rows(spark, str(tmp_path), "request_id bigint")
    assert got.count() == lookup.valid(batch(spark, source)).count()


def test_state_has_no_more_partitions_than_run_at_once(spark, source, tmp_path, monkeypatch):
    """Each batch pays for every partition of the state; batches without state keep the session's number."""
    key, seen = "spark.sql.shuffle.partitions", []
    answer = lookup.hit_or_miss

    def noted(batch, cached):
        seen.append(batch.sparkSession.conf.get(key))
        return answer(batch, cached)

    monkeypatch.setattr(rs.lookup, "hit_or_miss", noted)
    asked = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        admitted = rs.run_appending(rs.admit_once(stream(spark, source, 6), "10 hours"), str(tmp_path / "a"))
        flights = rs.run_batches(rs.flight_windows(stream(spark, source, 6)), str(tmp_path / "f"), mode="update")
        none = spark.createDataFrame([], "filepath string")
        hits = rs.lookup_stream(stream(spark, source, 6), lambda: none, str(tmp_path / "h"))
        for run in (admitted, flights, hits):
            run.awaitTermination()
        assert spark.conf.get(key) == "40" and seen == ["40"]
    finally:
        spark.conf.set(key, asked)
    for run in (admitted, flights):
        states = [s for progress in run.recentProgress for s in progress.stateOperators]
        at_once = max(8, spark.sparkContext.defaultParallelism)
        assert {s.numShufflePartitions for s in states} == {at_once} and at_once < 40
