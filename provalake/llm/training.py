"""Bounded labelled samples and one-dimensional calibration, shared by the two text classifiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import held_out, stored, texts


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may be learnt from; a document labelled twice takes the smaller label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` (distinct doc_id and what else) with one text for each id: of rows that share an id the one whose text has the least
    hash, found by partial aggregates. So the rows are no more than those of `chosen`, which are broadcast. Written once."""
    found = texts(docs).join(F.broadcast(chosen), "doc_id")
    return stored(found.groupBy(*chosen.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to `per_class` documents of either label, chosen by a hash of the id, with a whole text each, and the number of all
    usable labelled rows by label.

    `part` is 0 or 1: the two halves of the sample, one to learn from and one to calibrate on.
    """
    ids = labelled_ids(labels, label)
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64("doc_id")
    chosen = [ids.where(F.col("label") == value).orderBy(key, "doc_id").limit(per_class) for value in (0, 1)]
    sample = chosen_texts(docs, chosen[0].unionByName(chosen[1]))
    return sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)).cast("int")), counts


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: dict[int, int], rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(label 1 | x): Newton steps on a lightly regularised logistic loss, both labels weighed alike,
    then the intercept is moved to the label shares of the whole labelled table. Without both labels: the share alone."""
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) if total else 0.0
    if not len(x) or y.min() == y.max():
        return 0.0, prior
    scale = float(np.abs(x).max()) or 1.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    features = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-6, 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (p - y)) + ridge @ w
        hessian = (features * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ features + ridge
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] + prior)


def logistic(x: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
