"""Admission and answers on streams of several batches against a plain model of jobs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from catalens.streaming import in_flight, request_stream as rs

START = datetime.datetime(2024, 1, 1)
INPUT = "request_id bigint, filepath string, ts timestamp, outcome string, error string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """(seconds, path, request or None, outcome or None) in six files by time; a third is for one path."""
    rng = random.Random(8)
    events = []
    for n in range(600):
        path = "hot" if n % 3 == 0 else f"p{rng.randrange(25)}"
        events.append((rng.randrange(7200), path, n, None))
    for n in range(160):
        path = "hot" if n % 2 else f"p{rng.randrange(25)}"
        events.append((rng.randrange(7200), path, None, rng.choice(["done", "failed"])))
    events += [(3000, "p1", 1000, None), (3000, "p1", None, "failed"), (3000, "p1", None, "done"), (3000, "p1", 1001, None)]
    events.sort(key=lambda e: e[0])
    folder = str(tmp_path_factory.mktemp("arrivals"))
    for low in range(0, 7200, 1200):
        rows = [(r, p, at(s), o, None) for s, p, r, o in events if low <= s < low + 1200]
        rng.shuffle(rows)
        spark.createDataFrame(rows, INPUT).coalesce(1).write.mode("append").parquet(folder)
    tick = [(None, None, at(100_000), None, "tick"), (2000, "bad", at(7200), None, "no id")]
    spark.createDataFrame(tick, INPUT).coalesce(1).write.mode("append").parquet(folder)
    return events, folder


def arriving(spark, folder, files=1):
    def stream():
        return spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files).parquet(folder)

    outcomes = stream().where("outcome IS NOT NULL").select("filepath", F.col("ts").alias("outcome_ts"), "outcome")
    return in_flight.arrivals(stream().where("outcome IS NULL"), outcomes, stream().where("error = 'tick'"))


def expected_answers(events, within):
    ends = {}
    for s, p, _, o in events:
        if o is not None:
            ends.setdefault(p, []).append((s, o))
    out = []
    for s, p, r, o in events:
        if o is None:
            first = min((e for e in ends.get(p, []) if s <= e[0] <= s + within), default=(s + within, "timed out"))
            out.append((r, p, at(s), at(first[0]), first[1]))
    return sorted(out)


@pytest.mark.parametrize("options", [{"files": 1}, {"files": 3}, {"files": 1, "hot": ["hot", "p3"], "parts": 4}])
def test_every_waiter_gets_one_answer(spark, arrived, tmp_path, options):
    events, folder = arrived
    more = {k: v for k, v in options.items() if k != "files"}
    got = in_flight.answers(arriving(spark, folder, options["files"]), 600, "30 minutes", **more)
    rs.run_appending(got, str(tmp_path)).awaitTermination()
    rows = rs.read_rows(
        spark, str(tmp_path), "request_id bigint, filepath string, ts timestamp, answered_ts timestamp, outcome string"
    )
    have = sorted(tuple(r) for r in rows.collect())
    assert have == expected_answers(events, 600)
    assert {r[4] for r in have} == {"done", "failed", "timed out"}


def expected_admissions(events, horizon):
    since, out = {}, []
    for s, p, o, r in sorted((s, p, o is not None, r or 0) for s, p, r, o in events):
        if o:
            if p in since:
                del since[p]
        elif p not in since or s > since[p] + horizon:
            since[p] = s
            out.append((r, p, at(s)))
    return sorted(out)


@pytest.mark.parametrize("files, horizon", [(1, 900), (2, 100_000)])
def test_admission_again_after_the_outcome(spark, arrived, tmp_path, files, horizon):
    events, folder = arrived
    got = in_flight.admissions(arriving(spark, folder, files), horizon, "30 minutes")
    rs.run_appending(got, str(tmp_path)).awaitTermination()
    rows = rs.read_rows(spark, str(tmp_path), "request_id bigint, filepath string, ts timestamp")
    have = sorted(tuple(r) for r in rows.collect())
    assert have == expected_admissions(events, horizon)
    assert sum(p == "hot" for _, p, _ in have) > 10


def test_a_run_repeated_adds_nothing(spark, arrived, tmp_path):
    for _ in range(2):
        got = in_flight.admissions(arriving(spark, arrived[1], 3), 900, "30 minutes")
        rs.run_appending(got, str(tmp_path)).awaitTermination()
    assert rs.read_rows(spark, str(tmp_path), "request_id bigint").count() == len(expected_admissions(arrived[0], 900))


def test_hot_paths(spark):
    rows = [(i, "a" if i % 2 else f"p{i}", None) for i in range(100)] + [(200, None, "bad")] * 300
    keyed = spark.createDataFrame(rows, "request_id bigint, filepath string, error string")
    assert in_flight.hot_paths(keyed, 0.1) == ["a"]
    assert in_flight.hot_paths(keyed.where("false")) == []


@pytest.mark.parametrize("named", [None, "HDFSBackedStateStoreProvider"])
def test_a_session_with_the_default_state_store(spark, arrived, tmp_path, named):
    events, folder = arrived
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key)
    default = f"org.apache.spark.sql.execution.streaming.state.{named}" if named else None
    spark.conf.set(key, default) if named else spark.conf.unset(key)
    try:
        answered = in_flight.answers(arriving(spark, folder, 3), 900)
        in_flight.run_appending(answered, str(tmp_path)).awaitTermination()
        assert spark.conf.getAll.get(key) == default
    finally:
        spark.conf.set(key, own)
    schema = "request_id bigint, filepath string, ts timestamp, answered_ts timestamp, outcome string"
    assert sorted(map(tuple, rs.read_rows(spark, str(tmp_path), schema).collect())) == expected_answers(events, 900)


def write_files(spark, folder, files):
    for rows in files:
        rows = [(r, p, at(s), o, "tick" if p is None else None) for s, p, r, o in rows]
        spark.createDataFrame(rows, INPUT).coalesce(1).write.mode("append").parquet(folder)


def state_rows(run):
    return max(int(s["numRowsTotal"]) for p in run.recentProgress for s in p["stateOperators"])


# Paths of a stream with little else.
PATHS = 4000
ANSWERED = "request_id bigint, filepath string, ts timestamp, answered_ts timestamp, outcome string"


def many_paths(spark, folder):
    """Most paths have one request; some ask again after their outcome, one request has no id."""
    files = [
        [(k % 600, f"p{k}", k, None) for k in range(PATHS)] + [(300, "p1", None, None)],
        [(700 + k % 60, f"p{k}", None, "done") for k in range(0, PATHS, 2)]
        + [(800, f"p{k}", PATHS + k, None) for k in range(0, PATHS, 4)],
        [(100_000, None, None, None)],
    ]
    write_files(spark, folder, files)
    return [e for rows in files for e in rows if e[2] is not None or e[3] is not None]


def late_arrivals(spark, folder):
    """Files of which one holds rows that come after their time is settled; the rows in time."""
    far = 300 * 365 * 86_400
    in_time = [(0, "p", 1, None), (99_000, "p", 2, None), (99_500, "q", 3, None), (100_100, "p", 5, None), (far, "p", 7, None)]
    files = [
        in_time[:1], [(100_000, None, None, None)], in_time[1:3], [(10, "p", 4, None), in_time[3], (11, "p", None, "done")],
        [(far - 100_000, None, None, None)], in_time[4:], [(far + 100_000, None, None, None)],
    ]
    write_files(spark, folder, files)
    return in_time


def answered(spark, folder, stream):
    run = in_flight.run_appending(stream, folder)
    run.awaitTermination()
    return sorted(map(tuple, rs.read_rows(spark, folder, ANSWERED).collect()), key=str), run


def test_answers_do_not_keep_a_state_per_path(spark, tmp_path):
    """A call and a state for each path took nearly all of the time."""
    events = many_paths(spark, f"{tmp_path}/in")
    have, run = answered(spark, f"{tmp_path}/a", in_flight.answers(arriving(spark, f"{tmp_path}/in"), 600, "30 minutes"))
    nameless = (None, "p1", at(300), at(900), "timed out")
    assert have == sorted([*expected_answers(events, 600), nameless], key=str)
    assert state_rows(run) < PATHS


@pytest.mark.parametrize("buckets", [1, 3])
def test_answers_of_paths_that_share_a_bucket(spark, arrived, tmp_path, buckets):
    events, folder = arrived
    stream = in_flight.answers(arriving(spark, folder), 600, "30 minutes", hot=["hot"], parts=4, buckets=buckets)
    assert answered(spark, str(tmp_path), stream)[0] == sorted(expected_answers(events, 600), key=str)


def test_answers_to_late_arrivals_and_far_times(spark, tmp_path):
    """Late rows are lost, also next to rows in time; times need not fit nanoseconds."""
    in_time = late_arrivals(spark, f"{tmp_path}/in")
    have, _ = answered(spark, f"{tmp_path}/a", in_flight.answers(arriving(spark, f"{tmp_path}/in"), 600, "30 minutes"))
    assert have == sorted(expected_answers(in_time, 600), key=str)


def admitted(spark, folder, stream):
    run = in_flight.run_appending(stream, folder)
    run.awaitTermination()
    rows = rs.read_rows(spark, folder, "request_id bigint, filepath string, ts timestamp").collect()
    return sorted(map(tuple, rows)), run


def test_admission_does_not_keep_a_state_per_path(spark, tmp_path):
    events = many_paths(spark, f"{tmp_path}/in")
    have, run = admitted(spark, f"{tmp_path}/a", in_flight.admissions(arriving(spark, f"{tmp_path}/in"), 3600, "30 minutes"))
    assert have == expected_admissions(events, 3600)
    assert state_rows(run) < PATHS


@pytest.mark.parametrize("buckets", [1, 3])
def test_admission_of_paths_that_share_a_bucket(spark, arrived, tmp_path, buckets):
    events, folder = arrived
    stream = in_flight.admissions(arriving(spark, folder), 900, "30 minutes", buckets=buckets)
    assert admitted(spark, str(tmp_path), stream)[0] == expected_admissions(events, 900)


def test_admission_of_late_arrivals_and_far_times(spark, tmp_path):
    in_time = late_arrivals(spark, f"{tmp_path}/in")
    have, _ = admitted(spark, f"{tmp_path}/a", in_flight.admissions(arriving(spark, f"{tmp_path}/in"), 600, "30 minutes"))
    assert have == expected_admissions(in_time, 600)
