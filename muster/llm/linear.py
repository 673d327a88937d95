"""What the trained scorers share: bounded labelled samples, and logistic regression in numpy."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int
) -> tuple[DataFrame, dict[int, float]]:
    """At most ``most`` labelled documents per class with their text, and the weight that restores each class's share.

    The rows with the smallest hash of the id are taken, so the sample does not depend on how the table is stored.
    The list of ids has ``2 * most`` rows, which is what bounds its broadcast.
    """
    named = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    named = named.where("doc_id is not null and label in (0, 1)").dropDuplicates(["doc_id"])
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [named.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = reduce(DataFrame.unionByName, parts)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id"), {c: n / min(n, most) for c, n in sizes.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 150
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on the L2-penalised weighted log loss."""
    x, y = np.ascontiguousarray(x, np.float32), np.asarray(y, np.float32)
    share = (weight / weight.sum()).astype(np.float32)
    # the loss curves by at most a quarter of the weighted squared length, estimated with a few power rounds
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        probe = x.T @ (share * (x @ probe))
        probe /= max(np.linalg.norm(probe), 1e-12)
    step = float(1 / (0.25 * 1.2 * (np.linalg.norm(x.T @ (share * (x @ probe))) + 1) + penalty))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        error = share * (sigmoid(x @ ahead_w + ahead_b) - y)
        new_w = ahead_w - step * (x.T @ error + penalty * ahead_w)
        new_b = ahead_b - step * float(error.sum())
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / following * (new_w - w)
        ahead_b = new_b + (t - 1) / following * (new_b - b)
        w, b, t = new_w, new_b, following
    return w, float(b)
