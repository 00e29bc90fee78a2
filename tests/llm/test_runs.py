"""Periodic runs against all pairs of places."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import periodic_runs, query_runs


def every_run(words, least=6, exponent=4):
    """(start, length, period) by start, then period, from all places and periods."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, exponent * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a = rng.randrange(n)
        p = rng.randrange(1, 2 + (n - a) // rng.choice([3, 4, 5, 9]))
        for i in range(a, rng.randrange(a, n + 1)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (4, 3), (12, 5)])
def test_runs(least, exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [
            periodic(rng, rng.choice([0, 1, 5, 6, 30, 200]), rng.choice([1, 2, 3, 50]))
            for _ in range(rng.randrange(1, 8))
        ]
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts], least, exponent)
        for text, runs in zip(texts, got):
            assert [tuple(r) for r in runs.tolist()] == every_run(text, least, exponent), text


def test_candidates_in_parts(monkeypatch):
    text = np.array(periodic(random.Random(3), 900, 2), np.int64)
    whole = periodic_runs.find_runs([text])[0].tolist()
    monkeypatch.setattr(periodic_runs, "_CHUNK", 50)
    assert whole and periodic_runs.find_runs([text])[0].tolist() == whole


def test_extensions():
    """What the grammar says two places share, against word by word."""
    rng = random.Random(9)
    words = [1000, *periodic(rng, 400, 2), 1001]
    grammar = periodic_runs.recompress(np.array(words))
    x = np.array([rng.randrange(1, 400) for _ in range(300)])
    y = np.array([rng.randrange(1, 400) for _ in range(300)])
    x, y = x[x != y], y[x != y]
    ahead, behind = (periodic_runs.agree(grammar, x, y, f) for f in (True, False))
    for a, b, n, m in zip(x.tolist(), y.tolist(), ahead, behind):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        j = 0
        while min(a, b) - j >= 0 and words[a - j] == words[b - j]:
            j += 1
        assert (k, j) == (n, m)


def test_long_texts():
    rng = random.Random(1)
    same = periodic_runs.find_runs([np.zeros(60_000, np.int64)])[0].tolist()
    assert same == [[0, 60_000, 1]]
    unit = [rng.randrange(10_000) for _ in range(20_000)]
    runs = periodic_runs.find_runs([np.array(unit * 5 + [-1 % 10_001] + unit[:100])])[0].tolist()
    assert [0, 100_000, 20_000] in runs


def test_operator(spark):
    rng = random.Random(4)
    rows = [(i, " \n".join(f"w{k}é" for k in periodic(rng, rng.choice([3, 40, 120]), 3))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "a " * 9), (None, None), rows[3], (503, "  a b " * 8)]
    docs = spark.createDataFrame([(1, i, t, t) for i, t in rows], "Runs int, doc_id long, text string, Collapsed string")
    got = periodic_runs.periodic_runs(docs, batch_words=200).collect()
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = every_run(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((i, runs, best, kept))
    have = [(r[0], [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


def test_query_changes_a_tenth(spark, tmp_path):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 70))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in query_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, text in rows:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = every_run(words)
        changed += bool(runs)
        assert got[i].n_runs == len(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert got[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        if runs:
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (got[i].start, got[i].length, got[i].period) == best
            assert got[i].exponent_milli == 1000 * best[1] // best[2]
    assert changed > 5


def test_bounds_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs.select("doc_id", F.col("text")), exponent=2)
