"""The job table against a plain model of jobs, and what status and admission make of it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from catalens.operators import jobs, lookup

START = datetime.datetime(2024, 1, 1)
REQUEST = (
    "request_id bigint, ts timestamp_ntz, filename string, type string, width int, height int, angle int, "
    "mirror string, timeindex double, deinterlace boolean, filepath string, error string"
)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(12)
    path = lambda: rng.choice(["hot"] * 8 + [f"p{i}" for i in range(16)])
    requests = [(n, rng.randrange(9000), path()) for n in range(400)]
    starts = [(rng.randrange(9000), path()) for _ in range(150)] + [(5, "nobody")]
    ends = [(rng.randrange(9000), path(), rng.choice(["done", "failed"])) for _ in range(120)] + [(7, "nobody", "done")]
    ends += [(requests[0][1], requests[0][2], "failed"), (requests[0][1], requests[0][2], "done")]
    return requests, starts, ends


def model(requests, starts, ends):
    """(path, first request, arrival, waiters, start, end, outcome) per job."""
    def next_end(path, s):
        return min((e for e, p, _ in ends if p == path and e >= s), default=None)

    found = {}
    for n, s, p in requests:
        found.setdefault((p, next_end(p, s)), []).append((s, n))
    out = []
    for (p, end), asked in found.items():
        first = min(asked)
        begun = min((s for s, q in starts if q == p and next_end(p, s) == end), default=None)
        outcome = min((o for e, q, o in ends if q == p and e == end), default=None)
        begun = None if begun is None else max(begun, first[0])
        out.append((p, first[1], first[0], len(asked), begun, end, outcome))
    return sorted(out, key=str)


def table(spark, case, stretch):
    requests, starts, ends = case
    rows = [
        (n, at(s), "/in", ["image", "video"][p != "hot"], None, None, None, None, None, None, p, None) for n, s, p in requests
    ] + [(9999, at(1), "/in", "image", *[None] * 6, "hot", "bad"), (9998, at(1), "/in", "image", *[None] * 7, None)]
    keyed = spark.createDataFrame(rows, REQUEST)
    started = spark.createDataFrame([(p, at(s)) for s, p in starts] + [(None, at(3))], "filepath string, started_ts timestamp_ntz")
    ended = spark.createDataFrame([(p, at(s), o) for s, p, o in ends], "filepath string, ended_ts timestamp_ntz, outcome string")
    return jobs.job_table(keyed, started, ended, stretch)


@pytest.mark.parametrize("stretch", [60, 3600, 10**6])
def test_job_table(spark, case, stretch):
    got = table(spark, case, stretch)
    columns = ["filepath", "request_id", "arrival", "waiters", "started_ts", "ended_ts", "outcome"]
    seconds = lambda t: None if t is None else int((t - START).total_seconds())
    have = [
        (r.filepath, r.request_id, seconds(r.arrival), r.waiters, seconds(r.started_ts), seconds(r.ended_ts), r.outcome)
        for r in got.select(*columns).collect()
    ]
    assert sorted(have, key=str) == model(*case)


def test_status_and_admission_at_an_instant(spark, case):
    whole = model(*case)
    instants = [at(0), at(4000), at(8999), at(10**7)]
    got = lookup.status(jobs.jobs_at(table(spark, case, 600), instants), "at").collect()
    want = {}
    for t in (0, 4000, 8999, 10**7):
        for p, _, arrival, _, begun, end, _ in whole:
            if arrival <= t and (end is None or end > t):
                key = (at(t), "image" if p == "hot" else "video", begun is not None and begun <= t)
                want[key] = want.get(key, 0) + 1
    assert {(r["at"], r.job_class, r.running): r.jobs for r in got} == want

    alive = jobs.jobs_at(table(spark, case, 600), [at(4000)])
    admitted = lookup.admit(alive, {"image": 5, "video": 12}).select("filepath", "job_class", "position").collect()
    living = [j for j in whole if j[2] <= 4000 and (j[5] is None or j[5] > 4000)]
    busy = sum(j[0] != "hot" and j[4] is not None and j[4] <= 4000 for j in living)
    waiting = sorted((j[2], j[1], j[0]) for j in living if j[0] != "hot" and (j[4] is None or j[4] > 4000))
    assert [r.filepath for r in sorted(admitted, key=lambda r: r.position) if r.job_class == "video"] == [
        w[2] for w in waiting[: max(12 - busy, 0)]
    ]


def test_a_hot_path_is_taken_in_stretches(spark, case):
    plan = table(spark, case, 60)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "min(end" in line]
    assert windows and all("_part" in line for line in windows)


def test_no_records(spark, case):
    none = table(spark, ([], [], []), 60)
    assert none.count() == 0
    open_ = table(spark, (case[0], [], []), 60)
    assert open_.where("started_ts IS NOT NULL OR ended_ts IS NOT NULL").count() == 0
    assert open_.agg(F.sum("waiters")).first()[0] == len(case[0])
