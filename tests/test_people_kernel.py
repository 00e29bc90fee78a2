"""Kernel machines on random features against exact ones."""

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from catalens.operators import people_kernel as pk

FACE = "image_id bigint, face_no int, person string, encoding array<double>"


def rings(rng, n):
    """Points of three people on rings around each other: no plane parts them."""
    who = rng.integers(3, size=n)
    angle = rng.uniform(0, 2 * np.pi, n)
    radius = 1.0 + who + rng.normal(scale=0.12, size=n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle), rng.normal(scale=0.1, size=n)], 1), who


def exact_machines(x, who, gamma, penalty, rounds=400):
    """Dual weights of one machine per person, by coordinate ascent on the kernel matrix."""
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)) + 1  # the one is a free shift
    weights = []
    for person in range(who.max() + 1):
        y = np.where(who == person, 1.0, -1.0)
        a, at = np.zeros(len(x)), np.zeros(len(x))
        for _ in range(rounds):
            for i in range(len(x)):
                new = np.clip(a[i] + (1 - y[i] * at[i]) / kernel[i, i], 0, penalty)
                at += (new - a[i]) * y[i] * kernel[i]
                a[i] = new
        weights.append(a * y)
    return np.array(weights)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    x, who = rings(rng, 150)
    unseen, truth = rings(rng, 200)
    rows = [(i, 0, "xyz"[w], list(map(float, v))) for i, (v, w) in enumerate(zip(x, who))]
    # Two faces in an image, none known, no encoding: no examples.
    rows += [(900, k, "liar", [0.0, 0.0, 0.0]) for k in range(2)] + [(901, 0, None, [0.0] * 3), (902, 0, "x", None)]
    new = [(i, 0, None, list(map(float, v))) for i, v in enumerate(unseen)] + [(950, 0, None, None), (951, 0, None, [1.0])]
    return spark.createDataFrame(rows, FACE), x, who, spark.createDataFrame(new, FACE), unseen, truth


def test_gamma(case):
    faces, x, *_ = case
    assert np.isclose(pk.gamma_scale(pk.training_rows(faces)), 1 / (3 * x.var()))


def test_features_give_the_kernel():
    rng = np.random.default_rng(1)
    x, gamma = rng.normal(size=(30, 8)), 0.1
    directions, phases = pk.random_directions(8, gamma, 20_000, 5)
    z = np.sqrt(2 / 20_000) * np.cos(x @ directions + phases)
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_agreement_with_exact_machines(case):
    faces, x, who, new, unseen, truth = case
    model = pk.train_people_kernel(faces, features=300)
    assert model.names == ["x", "y", "z"]
    got = {r.image_id: r.predicted for r in pk.predict_people_kernel(model, new).collect()}
    assert got[950] is None and got[951] is None and len(got) == 202
    gamma = 1 / (3 * x.var())
    weights = exact_machines(x, who, gamma, 1.0)
    kernel = np.exp(-gamma * ((unseen[:, None] - x[None]) ** 2).sum(-1)) + 1
    exact = (kernel @ weights.T).argmax(1)
    same = np.mean([got[i] == "xyz"[exact[i]] for i in range(200)])
    right = np.mean([got[i] == "xyz"[truth[i]] for i in range(200)])
    assert same >= 0.9 and right >= 0.9 and (exact == truth).mean() >= 0.9


def test_one_person_and_none(spark, case):
    faces, *_, new, _, _ = case
    model = pk.train_people_kernel(faces.where("person = 'x'"))
    assert {r.predicted for r in pk.predict_people_kernel(model, new).collect()} == {"x", None}
    with pytest.raises(ValueError, match="No image"):
        pk.train_people_kernel(faces.where("person = 'liar'"))
    mixed = faces.unionByName(spark.createDataFrame([(990, 0, "y", [1.0])], FACE))
    with pytest.raises(ValueError, match="1 to 3"):
        pk.train_people_kernel(mixed)


def test_an_observation_that_waits(spark, case):
    """The session holds it, so a task that took the session along could not be sent."""
    faces, *_, new, _, _ = case
    waiting = faces.observe(Observation("waits"), F.count("*").alias("n"))
    model = pk.train_people_kernel(faces, features=16, iterations=2)
    assert pk.predict_people_kernel(model, new).count() == 202
    assert {r.predicted for r in pk.predict_people_kernel(model, new).collect()} <= {"x", "y", "z", None}
    assert waiting.count()
