"""Training of category weights and confidence calibration by gradient descent, per group on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, RATE = 500, 0.1
WEIGHT_ROUNDS, LEAST_PAIRS, LEAST_SAMPLES = 200, 5, 20


def fit_platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and accuracy of a logistic curve; one class alone gives (0, 0, 0)."""
    n, pos = weight.sum(), (weight * label).sum()
    if n == 0 or pos == 0 or pos == n:
        return 0.0, 0.0, 0.0
    a, b = 0.0, float(np.log((n - pos + 1) / (pos + 1)))
    for _ in range(ROUNDS):
        error = weight * (1 / (1 + np.exp(-(a * score + b))) - label)
        a, b = a - RATE * float((error * score).sum() / n), b - RATE * float(error.sum() / n)
    hit = ((a * score + b >= 0) == (label > 0.5)) * weight
    return a, b, float(hit.sum() / n)


def platt_calibration(rows: DataFrame, category: str, score: str, label: str, digits: int | None = 4) -> DataFrame:
    """``(scope, key, a, b, n_samples, accuracy)``: one curve for all and one per category of at least 20 samples.

    Scores are counted per value (rounded to ``digits``) and label first, so a task gets at most 2 x 10^digits + 2 rows
    for scores in [0, 1], however many samples there are; ``digits`` None counts them as they are. Null scores, labels and categories are left out.
    """
    binned = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(category).alias("key"), (F.col(score) if digits is None else F.round(score, digits)).alias("score"), F.col(label).cast("double").alias("label")).agg(F.count("*").alias("n"))
    every = binned.groupBy("score", "label").agg(F.sum("n").alias("n")).withColumn("scope", F.lit("global")).withColumn("key", F.lit("_global"))
    each = binned.where("key is not null").withColumn("scope", F.lit("category"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.sum())
        if pdf.scope.iloc[0] == "category" and n < LEAST_SAMPLES:
            return pd.DataFrame(columns=["scope", "key", "a", "b", "n_samples", "accuracy"])
        a, b, acc = fit_platt(pdf.score.to_numpy(), pdf.label.to_numpy(), pdf.n.to_numpy(float))
        return pd.DataFrame([(pdf.scope.iloc[0], pdf.key.iloc[0], a, b, n, acc)], columns=["scope", "key", "a", "b", "n_samples", "accuracy"])

    both = every.select("scope", "key", "score", "label", "n").unionByName(each.select("scope", "key", "score", "label", "n"))
    return both.groupBy("scope", "key").applyInPandas(fit, "scope string, key string, a double, b double, n_samples long, accuracy double")


def pattern_calibration(samples: DataFrame, least: int = 10) -> DataFrame:
    """``(pattern_id, a, b, n_samples)`` from ``(pattern_id, score, label)``: a logistic curve per pattern of at least ``least`` samples.

    Descent starts at slope 1 and offset 0. The samples of a pattern are its own examples and fit a task.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, score, label = 1.0, 0.0, pdf.score.to_numpy(float), pdf.label.to_numpy(float)
        if len(pdf) < least:
            return pd.DataFrame(columns=["pattern_id", "a", "b", "n_samples"])
        for _ in range(ROUNDS):
            error = 1 / (1 + np.exp(-(a * score + b))) - label
            a, b = a - RATE * float((error * score).mean()), b - RATE * float(error.mean())
        return pd.DataFrame([(pdf.pattern_id.iloc[0], a, b, len(pdf))], columns=["pattern_id", "a", "b", "n_samples"])

    return samples.groupBy("pattern_id").applyInPandas(fit, "pattern_id string, a double, b double, n_samples long")


def fit_weights(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Balanced logistic regression without offset, weights held in [0, 1] and scaled to sum 1."""
    w = np.full(features.shape[1], 0.5)
    share = np.where(label > 0.5, 0.5 / max((label > 0.5).sum(), 1), 0.5 / max((label <= 0.5).sum(), 1))
    for _ in range(WEIGHT_ROUNDS):
        error = share * (1 / (1 + np.exp(-features @ w)) - label)
        w = np.clip(w - RATE * (error @ features), 0.0, 1.0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def category_weights(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``(category, *names)`` from labelled pairs ``(category, label, *names)``; ``_global`` from all of them.

    Categories of fewer than five pairs get no row and fall back to ``_global``. Pairs come from the example library, two
    examples of one pattern each, so their number is bounded by the library.
    """
    every = pairs.withColumn("category", F.lit("_global"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < LEAST_PAIRS and pdf.category.iloc[0] != "_global":
            return pd.DataFrame(columns=["category", *names])
        return pd.DataFrame([[pdf.category.iloc[0], *fit_weights(pdf[names].to_numpy(float), pdf.label.to_numpy(float))]], columns=["category", *names])

    schema = ", ".join(["category string", *[f"{n} double" for n in names]])
    return pairs.unionByName(every).groupBy("category").applyInPandas(fit, schema)
