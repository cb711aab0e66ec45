"""Bounded samples of labelled rows, and the logistic fits that share them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import train_fold, written


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label (0 or 1) of at most per_class labelled rows of each class that may be learned from.

    The rows are the first by hash of the id, so reruns agree and the order of files doesn't matter. At most
    2 * per_class ids are broadcast, so no text is shuffled. Null ids and labels are left out; of an id that is labelled
    twice, the larger label counts.
    """
    _, usable = train_fold(F.col("doc_id"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("label = 0").orderBy(*order).limit(per_class).union(marks.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), f"sample-{label}")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


#: Rows of a fit's matrix that are widened to doubles at a time.
BLOCK = 1024


def blocks(x: np.ndarray | tuple[np.ndarray, ...]) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a matrix, or of several that stand side by side, as doubles with a last column of ones: a few at a time, so that votes
    and terms may stay bytes and the whole matrix is never copied."""
    parts = x if isinstance(x, tuple) else (x,)
    for at in range(0, len(parts[0]), BLOCK):
        rows = slice(at, at + BLOCK)
        cut = [np.asarray(p[rows], float) for p in parts]
        yield rows, np.hstack([*cut, np.ones((len(cut[0]), 1))])


def linear(x: np.ndarray | tuple[np.ndarray, ...], w: np.ndarray) -> np.ndarray:
    """The linear form of each row; the last coefficient is the intercept."""
    return np.concatenate([b @ w for _, b in blocks(x)])


def logistic(x: np.ndarray | tuple[np.ndarray, ...], y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept, which isn't penalised. y may be soft; x as in blocks."""
    weight = np.ones(len(y)) if weight is None else weight
    width = sum(p.shape[1] for p in (x if isinstance(x, tuple) else (x,))) + 1
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(width)
    for _ in range(rounds):
        gradient, hessian = penalty * w, np.diag(penalty)
        for rows, b in blocks(x):
            p = sigmoid(b @ w)
            gradient += b.T @ (weight[rows] * (p - y[rows]))
            hessian += (b * (weight[rows] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ b
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
