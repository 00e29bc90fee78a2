"""Neighbours against all products, the ranking on held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import neighbours, quality_classifier


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vector = lambda n=8: [float(x) for x in np.float32(rng.normal(size=n))]
    rows = [(i, vector()) for i in range(200)]
    rows += [
        (200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7),
        (None, [1.0] * 8), (204, [1.0] * 5), (220, [1.0] * 5), (5, rows[5][1]), (240, [float("inf")] * 8),
        (260, []), (280, [1.0] * 3),
    ]
    rows += [(1000 + i, rows[20][1]) for i in range(100)]  # ties
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            held[i] = max(held.get(i, v), v)
    want = []
    for q, v in held.items():
        if q % 20 == 0:
            found = []
            for j, u in held.items():
                if j != q and len(u) == len(v):
                    score = 0.0
                    for x, y in zip(v, u):
                        score += x * y
                    found.append((-score, j))
            want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:7])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, Vector int")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=7, query_rows=4, candidate_rows=16)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert neighbours.nearest(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_copies_of_query_blocks_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5)
    assert len(got.collect()) == 20 * 5
    # The plan that ran: the runtime would broadcast copies whose number it does not know.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("dim", [3, 64, 2000])
def test_error_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(40, dim)) * rng.lognormal(size=(40, 1)), rng.normal(size=(50, dim))
    near, error = neighbours.bounds(neighbours.quantised(a), neighbours.quantised(b), a, b)
    assert (np.abs(a @ b.T - near) <= error).all()


def _ranked(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Features int")
    return quality_classifier.rank_quality(
        docs, spark.createDataFrame(labels, "doc_id long, quality int"), learn=F.col("doc_id") % 3 != 0
    ).collect()


def test_held_out_ranking(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        good = i % 4 > 0
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 8 else [w + "###" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "x y z"), (5, rows[5][1])]
    got = _ranked(spark, rows, labels + [(5, 1), (7, None), (9, 4), (None, 1)])
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 3 == 0]
    right = sum(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    assert right >= 0.95 * len(held)


def _labelled(spark, n, rare=3):
    rng = np.random.default_rng(4)
    y = (np.arange(n) % rare > 0).astype(int)
    x = rng.normal(size=(n, quality_classifier.N_FEATURES)) + y[:, None] * 0.4 * rng.normal(size=quality_classifier.N_FEATURES)
    rows = [(i, f, int(v)) for i, (f, v) in enumerate(zip(x.tolist(), y))]
    return x, y, spark.createDataFrame(rows, "doc_id long, features array<double>, label int")


@pytest.mark.parametrize("block_rows, rare", [(10_000, 3), (100, 3), (100, 250)])
def test_all_labelled_rows_are_learned(spark, block_rows, rare):
    """Mean, scale, threshold and spread are those of all rows, however many blocks they are dealt to."""
    x, y, labelled = _labelled(spark, 1500, rare)
    model = quality_classifier.fit(labelled, block_rows=block_rows)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    raw = np.clip((x - x.mean(0)) / x.std(0), -4, 4) @ np.array(model.weights)
    ranked, bad = np.sort(raw), int((y == 0).sum())
    assert np.isclose(model.threshold, (ranked[bad - 1] + ranked[bad]) / 2) and np.isclose(model.spread, raw.std() / 2)
    whole = quality_classifier.fit(labelled, block_rows=10_000)
    assert np.corrcoef(model.weights, whole.weights)[0, 1] > 0.95
    assert raw[y == 1].mean() > raw[y == 0].mean()


def test_one_document_fills_each_class(spark):
    """Blocks of one class only: the classes meet all the same."""
    width = quality_classifier.N_FEATURES
    for other in (2, 3):
        rows = [(1, [0.0] * width, 0)] * 600 + [(other, [1.0] * width, 1)] * 600
        labelled = spark.createDataFrame(rows, "doc_id long, features array<double>, label int")
        model = quality_classifier.fit(labelled, block_rows=100, rounds=3)
        assert min(model.weights) > 0 and abs(model.threshold) < 1e-9


def test_labels_of_one_class_or_none(spark):
    assert {r.score for r in _ranked(spark, [(1, "a b"), (2, None)], [(1, 1), (2, 1)])} == {0.5}
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.rank_quality(docs, labels, learn=F.lit(True)).count() == 0
