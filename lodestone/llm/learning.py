"""What the two trained operators share: labelled rows, sampling with a bound, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """docs (doc_id, text) with their label y (0 or 1); ids that are labelled twice take the larger label."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    return docs.join(common.small_side(labels, labels.count()), "doc_id")


def sample(rows: DataFrame, there: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """All rows, or about `most` of them where there are more, chosen by a hash of the id."""
    return rows if there <= most else rows.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1_000_000)) < int(1e6 * most / there))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
        for _ in range(25):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w += step / max(1, np.abs(step).max() / 3)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.w[0] + (x - self.mean) / self.scale @ self.w[1:])
