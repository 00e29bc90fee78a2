"""Document quality learned from pairs: a Bradley-Terry model on text features.

A document's score is a weighted sum of features of its text. The chance that one document is better
than another is the logistic function of the difference of their scores, so the weights are learned by
logistic loss on feature differences of pairs (better, worse). A quantile of the labelled scores, the
share of the worse class, becomes the threshold.

Features are column expressions, computed once for all documents and written below
``spark.checkpoint.dir``. All labelled rows are fitted: they are dealt to blocks by hash, in which they
meet rows of the other class, and every round of Newton's method sums the blocks' gradients and curves;
the driver only sees these sums. Of a class too rare for all blocks, rows belong to several. Mean, scale
and threshold are those of all labelled rows. Null text counts as empty and has features and a score like any other. Labels other
than 0 and 1 are left out; without rows of both classes every score is 0.5. Null or repeated document
ids: a row for each row of the input; labels belong to all rows with their id. Columns but id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.columns import NOT_SPACE, let, split_words, text_or_empty
from catalens.shipping import ship_by_value
from catalens.sources.shared import shared_folder

ship_by_value(__name__)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def text_features(text: Column) -> Column:
    """Array of doubles: what prose and junk differ in, whatever the language."""

    def of(words: Column) -> Column:
        n = F.size(words).cast("double")
        size = F.length(text).cast("double")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))

        def share(part: Column, whole: Column) -> Column:
            return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

        return F.array(
            F.log1p(n),
            share(size, n + 1),
            share(_without(text, r"[^#$%&*<>{}~^]+"), size),
            share(_without(text, r"[^|]+"), size),
            share(_without(text, r"[^!?]+"), size),
            share(_without(text, r"[^A-ZÀ-ÖØ-Þ]+"), size),
            share(_without(text, r"[^0-9]+"), size),
            share(_without(text, r"[^.,;:]+"), size),
            share(F.size(F.array_distinct(words)).cast("double"), F.sqrt(n + 1)),
            share(F.size(F.array_distinct(words)).cast("double"), n),
            let(lines, lambda x: share(F.size(F.array_distinct(x)).cast("double"), F.size(x))),
            let(lines, lambda x: F.log1p(share(n, F.size(x).cast("double")))),
            (n == 0).cast("double"),
        )

    return let(split_words(text), of)


N_FEATURES = 13
# Rows of either class that a block should hold, in the mean.
_LEAST = 50
_FOLDED = pa.schema([("gradient", pa.list_(pa.float64())), ("curve", pa.list_(pa.float64())), ("pairs", pa.int64())])


@dataclass(frozen=True)
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    """Raw score from which on a document counts as good."""
    spread: float
    """Raw scores are divided by this before the logistic function."""


def _pairs(good: int, bad: int, per_row: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row meets ``per_row`` rows of the other class."""
    random = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(np.arange(good), per_row), random.integers(good, size=bad * per_row)])
    worse = np.concatenate([random.integers(bad, size=good * per_row), np.repeat(np.arange(bad), per_row)])
    return better, worse


def _packed(mean: np.ndarray, scale: np.ndarray):
    """Rows of a block -> one row: number, scaled features of the good and of the bad ones, in order of a hash."""

    def pack(key, table):
        features = np.array(table["features"].to_pylist(), float)
        labels = table["label"].to_numpy()
        order = np.lexsort((*features.T[::-1], labels, table["doc_id"].to_numpy(), table["hash"].to_numpy()))
        x, labels = np.clip((features[order] - mean) / scale, -4, 4), labels[order]
        return pa.table({"block": [key[0].as_py()], "good": [x[labels == 1].tobytes()], "bad": [x[labels == 0].tobytes()]})

    return pack


def _sums(weights: np.ndarray, per_row: int, seed: int):
    """Blocks -> sums over their pairs of the loss's gradient and curve at ``weights``, a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(weights)
        gradient, curve, pairs = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            for block, *classes in zip(*(batch.column(n).to_pylist() for n in ("block", "good", "bad"))):
                good, bad = (np.frombuffer(x).reshape(-1, size) for x in classes)
                if not len(good) or not len(bad):
                    continue
                better, worse = _pairs(len(good), len(bad), per_row, seed + block)
                diff = good[better] - bad[worse]
                p = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))  # chance of the wrong order
                gradient -= diff.T @ p
                curve += (diff * (p * (1 - p))[:, None]).T @ diff
                pairs += len(diff)
        yield pa.RecordBatch.from_arrays(
            [pa.array([gradient], _FOLDED.field(0).type), pa.array([curve.ravel()], _FOLDED.field(1).type), pa.array([pairs])],
            schema=_FOLDED,
        )

    return run


def _middle(raw: DataFrame, cut: int, n: int) -> float:
    """Mean of the ``cut``-th smallest value of column raw and the next one, if any. Exact."""
    margin = 3e-5
    while True:
        ends = [min(max((cut + k + side * margin * n) / n, 0.0), 1.0) for k, side in ((-2, -1), (3, 1))]
        low, high = raw.agg(F.percentile_approx("raw", ends, 100_000)).first()[0]
        below = raw.where(F.col("raw") < low).count()
        near = raw.where(F.col("raw").between(low, high)).groupBy("raw").count().orderBy("raw").collect()
        reach = below + np.cumsum([r["count"] for r in near])
        last = min(cut + 1, n)
        if below < cut and reach[-1] >= last:
            first, second = (near[int(np.searchsorted(reach, k))]["raw"] for k in (cut, last))
            return (first + second) / 2
        margin *= 4  # the bounds are approximate


def fit(
    labelled: DataFrame, *, per_row: int = 8, ridge: float = 1e-3, rounds: int = 30, seed: int = 17,
    block_rows: int = 20_000,
) -> Model | None:
    """Weights by Newton's method on the logistic loss of differences; None without both classes.

    ``labelled``: doc_id, features, label of all rows to learn from, read several times.
    """
    spark = labelled.sparkSession
    each = [F.get("features", F.lit(k)) for k in range(N_FEATURES)]
    n, good, *moments = labelled.agg(
        F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *[f(x) for f in (F.avg, F.stddev_pop) for x in each]
    ).first()
    bad = n - good
    if not good or not bad:
        return None
    mean, scale = np.array(moments[:N_FEATURES]), np.array(moments[N_FEATURES:])
    scale[scale < 1e-9] = 1.0

    count = -(-n // block_rows)
    copies = [min(count, -(-_LEAST * count // rows)) for rows in (bad, good)]
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1))
    dealt = labelled.select("*", F.xxhash64("doc_id").alias("hash"), turn.alias("turn"))
    place = F.pmod(F.xxhash64("doc_id", "features") % count + F.col("turn"), F.lit(count)).alias("block")
    folder = shared_folder(spark, "quality-blocks")
    schema = "block long, good binary, bad binary"
    (
        dealt.select(place, "hash", "doc_id", "label", "features")
        .groupBy("block").applyInArrow(_packed(mean, scale), schema).write.parquet(folder)
    )
    blocks = spark.read.schema(schema).parquet(folder)

    w = np.zeros(N_FEATURES)
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(w, per_row, seed), "gradient array<double>, curve array<double>, pairs long").collect()
        pairs = sum(r["pairs"] for r in parts)
        if not pairs:  # one document fills each class
            return fit(labelled, per_row=per_row, ridge=ridge, rounds=rounds, seed=seed, block_rows=n)
        gradient = ridge * w + np.sum([r["gradient"] for r in parts], axis=0) / pairs
        curve = np.sum([r["curve"] for r in parts], axis=0).reshape(len(w), -1) / pairs
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model = Model(mean.tolist(), scale.tolist(), w.tolist(), 0.0, 1.0)
    raw = labelled.select(_raw(F.col("features"), model).alias("raw"))
    # The threshold is the quantile at the share of the worse class.
    spread = raw.agg(F.stddev_pop("raw")).first()[0]
    return replace(model, threshold=_middle(raw, bad, n), spread=max(spread / 2, 1e-9))


def _raw(features: Column, model: Model) -> Column:
    raw = F.lit(0.0)
    for k, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights)):
        z = (F.get(features, F.lit(k)) - m) / s
        raw = raw + F.greatest(F.least(z, F.lit(4.0)), F.lit(-4.0)) * w
    return raw


def score(features: Column, model: Model | None, at_threshold: float) -> Column:
    """From 0 to 1; ``at_threshold`` where the raw score is the model's threshold."""
    if model is None:
        return F.lit(0.5)
    shifted = (_raw(features, model) - model.threshold) / model.spread + math.log(at_threshold / (1 - at_threshold))
    return 1 / (1 + F.exp(-shifted))


def rank_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    block_rows: int = 20_000,
    at_threshold: float = 0.3,
) -> DataFrame:
    """doc_id, score and predicted (1 from ``at_threshold`` on) per document.

    ``learn``: condition on column ``doc_id`` of the rows whose labels may be used.
    ``block_rows``: about so many labelled rows meet in a block.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "quality-features")
    (
        docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
        .select("doc_id", text_features(F.col("text")).alias("features"))
        .write.mode("overwrite").parquet(folder)
    )
    rows = spark.read.schema("doc_id long, features array<double>").parquet(folder)
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & learn)
        .dropDuplicates()
    )
    labelled = shared_folder(spark, "quality-labelled")
    rows.join(known, "doc_id").select("doc_id", "features", "label").write.parquet(labelled)
    model = fit(
        spark.read.schema("doc_id long, features array<double>, label int").parquet(labelled), block_rows=block_rows
    )
    scored = rows.select("doc_id", score(F.col("features"), model, at_threshold).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at_threshold).cast("int"))
