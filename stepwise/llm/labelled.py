"""Held-out folds and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0))


def sample_ids(labels: DataFrame, label_col: str, keep: Column, max_docs: int) -> DataFrame:
    """At most ``max_docs`` ids with their label, lowest id hash first.

    An id whose labels disagree takes the larger one.  The order is a hash,
    so the sample is the same however the table is split.
    """
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & keep)
            .groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(max_docs))


def sample_texts(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column,
                 max_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label_id, label, text) of the sample; its ids are few enough to broadcast."""
    ids = sample_ids(labels, label_col, keep, max_docs)
    return (docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(ids), "label_id"))


def logistic_fit(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit of labels to margins."""
    slope, shift = 1.0, 0.0
    for _ in range(200):
        q = 1.0 / (1.0 + np.exp(-np.clip(slope * x + shift, -40, 40)))
        r, h = label - q, np.maximum(q * (1 - q), 1e-6)
        hess = np.array([[(h * x * x).mean() + 1e-3, (h * x).mean()], [(h * x).mean(), h.mean() + 1e-3]])
        d = np.linalg.solve(hess, [(r * x).mean() - 1e-3 * slope, r.mean()])
        slope, shift = max(1e-3, slope + 0.5 * d[0]), shift + 0.5 * d[1]
    return float(slope), float(shift)
