"""People told apart by support vector machines with a radial kernel, approximated for many rows.

Random Fourier features turn the kernel exp(-gamma * |x - y|^2) into a plain inner product: a face
becomes cosines along random directions, and a linear machine on them is a kernel machine on faces, up
to an error that falls with the number of features. One machine per person against all others, trained
by Spark ML in passes over the distributed rows; the driver holds people times features coefficients.

Only these numbers go to the tasks that predict. A Spark ML machine would take its training summary along,
and with it the session and every observation that waits in it, which cannot be sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from catalens.operators.recognition import single_face_images
from catalens.shipping import ship_by_value

ship_by_value(__name__)
c = F.col

FEATURES = 256


@dataclass(frozen=True)
class KernelModel:
    directions: np.ndarray
    """Dimensions x features."""
    phases: np.ndarray
    names: list[str]
    weights: np.ndarray | None
    """People x features; None if there is one person only."""
    shifts: np.ndarray | None


def training_rows(faces: DataFrame, label: str = "person") -> DataFrame:
    """``name, encoding`` of the images that show exactly one face, of whom a name is known."""
    single = single_face_images(faces, label, "encoding")
    return single.select(c(label).cast("string").alias("name"), "encoding").where(
        "name IS NOT NULL AND encoding IS NOT NULL"
    )


def gamma_scale(examples: DataFrame) -> float:
    """One over dimensions times the variance of all numbers in the encodings."""
    def total(f) -> Column:
        return F.sum(F.aggregate("encoding", F.lit(0.0), lambda a, x: a + f(x.cast("double"))))

    n, once, twice, size = examples.agg(
        F.sum(F.size("encoding")), total(lambda x: x), total(lambda x: x * x), F.max(F.size("encoding"))
    ).first()
    spread = twice / n - (once / n) ** 2
    return 1 / (size * spread) if spread > 0 else 1.0


def kernel_features(directions: np.ndarray, phases: np.ndarray):
    """Column function: encoding -> cosines whose inner products are near the kernel."""
    scale = np.sqrt(2 / len(phases))

    @F.pandas_udf("array<double>")
    def cosines(encodings: pd.Series) -> pd.Series:
        if not len(encodings):
            return pd.Series([], dtype=object)
        x = np.stack(encodings.to_list()).astype(float)
        return pd.Series(list(scale * np.cos(x @ directions + phases)))

    return cosines


def random_directions(dimensions: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.normal(scale=np.sqrt(2 * gamma), size=(dimensions, features)), random.uniform(0, 2 * np.pi, features)


def train_people_kernel(
    faces: DataFrame,
    label: str = "person",
    features: int = FEATURES,
    penalty: float = 1.0,
    iterations: int = 50,
    gamma: float | None = None,
    seed: int = 7,
) -> KernelModel:
    """A model from images that show exactly one face.

    ``gamma``: width of the kernel, by default from the spread of the encodings. ``penalty``: cost of a
    face on the wrong side. Encodings must be of one length.
    """
    examples = training_rows(faces, label)
    n, least, most = examples.agg(F.count("*"), F.min(F.size("encoding")), F.max(F.size("encoding"))).first()
    if not n:
        raise ValueError("No image shows exactly one face of a known person")
    if least != most:
        raise ValueError(f"Encodings have {least} to {most} dimensions")
    directions, phases = random_directions(most, gamma or gamma_scale(examples), features, seed)
    index = StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc").fit(examples)
    names = list(index.labels)
    weights = shifts = None
    if len(names) > 1:
        cosines = kernel_features(directions, phases)
        rows = index.transform(examples).select("label", array_to_vector(cosines("encoding")).alias("features"))
        # A sum of costs with a weight is a mean of costs with a ridge.
        machine = LinearSVC(maxIter=iterations, regParam=1 / (penalty * n), standardization=False)
        machines = OneVsRest(classifier=machine, parallelism=4).fit(rows).models
        weights = np.stack([m.coefficients.toArray() for m in machines])
        shifts = np.array([m.intercept for m in machines])
    return KernelModel(directions, phases, names, weights, shifts)


def _best_name(model: KernelModel):
    """Column function: encoding -> person whose machine answers most, the first of equal ones."""
    scale = np.sqrt(2 / len(model.phases))
    directions, phases, weights, shifts = model.directions, model.phases, model.weights, model.shifts
    names = np.array(model.names, dtype=object)

    @F.pandas_udf("string")
    def best(encodings: pd.Series) -> pd.Series:
        if not len(encodings):
            return pd.Series([], dtype=object)
        x = np.stack(encodings.to_list()).astype(float)
        return pd.Series(names[(scale * np.cos(x @ directions + phases) @ weights.T + shifts).argmax(1)])

    return best


def predict_people_kernel(model: KernelModel, faces: DataFrame) -> DataFrame:
    """``image_id, face_no, predicted`` for every face; null where the encoding does not fit."""
    fits = F.coalesce(F.size("encoding") == len(model.directions), F.lit(False))
    odd = faces.where(~fits).select("image_id", "face_no", F.lit(None).cast("string").alias("predicted"))
    usable = faces.where(fits)
    who = F.lit(model.names[0]) if model.weights is None else _best_name(model)(c("encoding"))
    return usable.select("image_id", "face_no", who.alias("predicted")).unionByName(odd)
