"""Model operators: ONNX prediction behind Arrow, output normalisation, label bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Rows that are no distribution become one by softmax."""
    raw = np.atleast_2d(np.asarray(raw, float))
    fine = (raw >= 0).all(axis=1) & (np.abs(raw.sum(axis=1) - 1) < 1e-3)
    return np.where(fine[:, None], raw, probabilities_of(raw))


def onnx_predict(df: DataFrame, key: str, vector: str, model: bytes, labels: list[str], shape: tuple[int, ...] | None = None) -> DataFrame:
    """key, label, confidence. The model's bytes go out once per task; a session is made per worker, on the CPU."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a model file, of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, np.float32) for v in pdf[vector]])
            p = probabilities(session.run(None, {name: x.reshape(-1, *shape) if shape else x})[-1])
            best = p.argmax(axis=1)
            yield pd.DataFrame({key: pdf[key], "label": [labels[k] for k in best], "confidence": p.max(axis=1)})

    return df.select(key, vector).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, label string, confidence double")


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Multinomial logistic regression with an L2 penalty: weights (features + 1) x classes, the last row being intercepts, which
    aren't penalised. Accelerated gradient steps of the length that the curvature's bound allows."""
    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    target = np.eye(classes)[y]
    penalty = np.full((x.shape[1], 1), ridge)
    penalty[-1] = 0.0
    step = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge)
    w = ahead = np.zeros((x.shape[1], classes))
    for k in range(rounds):
        gradient = x.T @ (probabilities_of(x @ ahead) - target) + penalty * ahead
        new = ahead - step * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
        if np.abs(gradient).max() < 1e-6 * len(x):
            break
    return w


def probabilities_of(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def field(number: int, value: int | bytes) -> bytes:
    """One field of the wire format that model files use: a number, or bytes."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def linear_onnx(weights: np.ndarray) -> bytes:
    """An ONNX model file of a softmax classifier, probabilities = softmax(x w + b); weights: (features + 1) x classes, b last."""
    w, b = np.asarray(weights[:-1], "<f4"), np.asarray(weights[-1], "<f4")
    # Field numbers of the format: tensors (dims 1, type 2, name 8, bytes 9), nodes (inputs 1, outputs 2, kind 4), values (name 1, type 2).
    tensor = lambda name, x: b"".join(field(1, n) for n in x.shape) + field(2, 1) + field(8, name) + field(9, x.tobytes())
    value = lambda name, n: field(1, name) + field(2, field(1, field(1, 1) + field(2, field(1, field(2, b"rows")) + field(1, field(1, n)))))
    node = lambda kind, ins, out: b"".join(field(1, x) for x in ins) + field(2, out) + field(4, kind)
    nodes = field(1, node(b"Gemm", (b"x", b"w", b"b"), b"z")) + field(1, node(b"Softmax", (b"z",), b"p"))
    graph = nodes + field(2, b"linear") + field(5, tensor(b"w", w)) + field(5, tensor(b"b", b)) + field(11, value(b"x", w.shape[0])) + field(12, value(b"p", w.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def fitted_onnx(df: DataFrame, vector: str, label: str, per_class: int = 2000) -> tuple[bytes, list[str]]:
    """(model file, labels) of a logistic regression fitted on at most per_class rows of each label, the first by hash of the vector."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).alias("v"), F.col(label).cast("string").alias("y"))
    order = W.partitionBy("y").orderBy(F.xxhash64("v"), "v")
    found = sorted((r.y, list(r.v)) for r in rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_class).collect())
    names = sorted({r[0] for r in found})
    if len(names) < 2:
        raise ValueError("fewer than two labels to fit")
    return linear_onnx(softmax_regression(np.array([r[1] for r in found], float), np.array([names.index(r[0]) for r in found]), len(names))), names


#: Trusted rows of a class that a round of the bootstrap fits on, at most.
PER_CLASS = 2000


def bootstrap_labels(df: DataFrame, key: str, vector: str, label: str, seeds: float = 0.3, sure: float = 0.9, per_class: int = PER_CLASS) -> DataFrame:
    """key, label, status. A logistic regression is fitted on trusted rows; rows that it predicts surely and that agree with their
    label join them for good, until none does. Rest: 'conflict' if it surely predicts otherwise, else 'unresolved'.

    Trusted at first: a share of rows by hash. A round fits on at most per_class trusted rows of each class, the first by hash,
    and predicts all rows. Rows without a vector or label are unresolved; keys are integers and distinct.
    """
    from mosaiq.sources.scratch import written

    everything = df.select(key, vector, label)
    usable = F.col(vector).isNotNull() & F.col(label).isNotNull()
    rows = written(everything.where(usable), "bootstrap")
    kind = rows.schema[label].dataType.simpleString()
    hashed = F.pmod(F.xxhash64(key), F.lit(1000)) < int(seeds * 1000)
    state = written(rows.select(key, label, hashed.alias("trusted"), F.lit(None).cast(kind).alias("predicted"), F.lit(0.0).alias("confidence")), "bootstrap-round")
    known = state.where("trusted").count()
    while known:
        order = W.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(1)), key)
        chosen = state.where("trusted").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_class).select(key)
        fitted = sorted(((r[label], list(r[vector])) for r in rows.join(F.broadcast(chosen), key).select(label, vector).collect()), key=str)
        names = sorted({r[0] for r in fitted}, key=str)
        data = np.array([r[1] for r in fitted], float)
        mean, scale = data.mean(axis=0), np.maximum(data.std(axis=0), 1e-6)
        weights = softmax_regression((data - mean) / scale, np.array([names.index(r[0]) for r in fitted]), len(names))

        def run(batches: Iterator[pd.DataFrame], mean=mean, scale=scale, weights=weights, names=names) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = (np.stack([np.asarray(v, float) for v in pdf[vector]]) - mean) / scale
                    p = probabilities_of(x @ weights[:-1] + weights[-1])
                    yield pd.DataFrame({key: pdf[key], "predicted": [names[k] for k in p.argmax(axis=1)], "confidence": p.max(axis=1)})

        told = rows.select(key, vector).mapInPandas(run, f"{key} long, predicted {kind}, confidence double")
        joins = F.col("trusted") | ((F.col("confidence") >= sure) & (F.col("predicted") == F.col(label)))
        state = written(told.join(state.select(key, label, "trusted"), key).select(key, label, joins.alias("trusted"), "predicted", "confidence"), "bootstrap-round")
        now = state.where("trusted").count()
        if now == known:
            break
        known = now
    status = F.when(F.col("trusted"), "trusted").when((F.col("confidence") >= sure) & (F.col("predicted") != F.col(label)), "conflict").otherwise("unresolved")
    return state.select(key, label, status.alias("status")).union(everything.where(~usable).select(key, label, F.lit("unresolved")))
