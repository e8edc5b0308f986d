"""Bounded samples of labelled rows, which are all that a classifier may learn labels from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_crc, text_or_empty
from tesserae.storage import hash_sample, materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): about ``max_rows`` ids of each class at most, out of the rows that are not held out.

    Held out is every id whose crc32 as text is 0 modulo ``folds``.  Null labels are no labels; of several labels of one id
    the largest holds, and of several texts the smallest; the ids with the smallest hashes are taken.  The sampled ids,
    bounded by ``2 * max_rows``, are broadcast, so only their texts are shuffled.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(id_crc() % folds != 0)
    by_hash = materialise(known.withColumn("h", F.xxhash64("doc_id")))
    taken = [hash_sample(by_hash.where(F.col("label") == c), "h", max_rows).select("doc_id", "label") for c in (0, 1)]
    ids = materialise(taken[0].unionByName(taken[1]))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def logistic(x, y, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic regression on one feature, by Newton's method; classes weigh the same."""
    import numpy as np

    if len(x) == 0 or len(set(y.tolist())) < 2:
        rate = (float(np.sum(y)) + 1) / (len(y) + 2)
        return 0.0, float(np.log(rate / (1 - rate)))
    sd = float(np.std(x)) or 1.0
    X = np.stack([x / sd, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        gradient = X.T @ (weight * (p - y)) + ridge * len(y) * np.array([beta[0], 0]) / 10
        hessian = (X * (weight * p * (1 - p))[:, None]).T @ X + np.diag([ridge * len(y) / 10, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / sd), float(beta[1])
