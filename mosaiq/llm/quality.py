"""Quality by compression: a text that the dictionary of good texts packs better than that of bad ones is good.

Two zstandard dictionaries are built from bounded samples of good and bad labelled texts. A text is cut into pieces, all
of which are compressed with either dictionary; (bad size - good size) / raw size over the whole text is its normalised
difference. A logistic fit on labelled rows that went into no dictionary turns it into a probability.
Only rows that may be learned from are used, and ids, languages and sources are never inputs.

Defined results: ids are integers; null and empty texts have difference 0 and the score of that; without labelled rows of both classes
every score is the share of good labels (0.5 without any); repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import arrow_map, held, spread, train_fold, utf8
from mosaiq.llm.labelled import logistic, sample, sigmoid

#: Bytes of a piece; of the samples, at most so many evenly spaced pieces of a text go into a dictionary.
PIECE, PIECES = 1024, 16
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Labelled rows of a class that are learned from, at most.
PER_CLASS = 2000


class Packer:
    def __init__(self, good: bytes, bad: bytes):
        self.codecs = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(text[k : k + PIECE])) for k in range(0, len(text), PIECE)) for c in self.codecs)
        return (bad - good) / len(text)


def packer_of(model: dict) -> Packer:
    return held("packer", (model["good"], model["bad"]), lambda: Packer(model["good"], model["bad"]))


def pieces(text: bytes) -> list[bytes]:
    cut = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
    return cut if len(cut) <= PIECES else [cut[i * (len(cut) - 1) // (PIECES - 1)] for i in range(PIECES)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of distinct pieces, in an order that depends on them alone; too little text serves as its own."""
    short = sorted(set(samples), key=lambda x: hashlib.sha1(x).digest())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, short, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(short)[-DICTIONARY_BYTES:] or b"\0" * 8


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The two dictionaries and the two coefficients."""
    rows = sample(docs, labels, "quality", per_class)
    # Of the four folds that may be learned from, one calibrates and three build dictionaries.
    calibrates = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4

    def cut(batch: pa.RecordBatch):
        out = [(label, x) for text, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) for x in pieces(text)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["label", "piece"])

    found = arrow_map(rows.where(~calibrates).select("text", "label"), cut, "label int, piece binary").collect()
    by = {k: [bytes(r.piece) for r in found if r.label == k] for k in (0, 1)}
    _, usable = train_fold(F.col("doc_id"))
    marks = labels.where(usable & F.col("quality").isin(0, 1)).agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")).first()
    good_share = (1 + marks.good) / (2 + marks.n)
    if not by[0] or not by[1]:
        return {"good": b"\0" * 8, "bad": b"\0" * 8, "slope": 0.0, "base": float(np.log(good_share / (1 - good_share)))}
    model = {"good": dictionary(by[1]), "bad": dictionary(by[0])}

    def measure(batch: pa.RecordBatch):
        packer = packer_of(model)
        yield pa.RecordBatch.from_arrays([pa.array([packer.difference(x) for x in utf8(batch.column(0))]), batch.column(1)], names=["d", "label"])

    seen = arrow_map(rows.where(calibrates).select("text", "label"), measure, "d double, label int").collect()
    d, y = np.array(sorted((r.d, r.label) for r in seen), float).reshape(-1, 2).T
    if len(set(y)) < 2:
        return model | {"slope": 50.0, "base": float(np.log(good_share / (1 - good_share)))}
    # The classes are sampled alike; weights give them back their shares.
    weight = np.where(y == 1, good_share / max(y.mean(), 1e-9), (1 - good_share) / max(1 - y.mean(), 1e-9))
    slope, base = logistic(d[:, None], y, weight, ridge=1e-4)
    return model | {"slope": max(float(slope), 0.0), "base": float(base)}


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted and difference of each row."""
    model = fit(docs, labels, per_class)

    def run(batch: pa.RecordBatch):
        packer = packer_of(model)
        d = np.array([packer.difference(x) for x in utf8(batch.column(2))])
        score = sigmoid(model["slope"] * d + model["base"])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(d)], names=["doc_id", "held_out", "score", "predicted", "difference"])

    rows = docs.select(F.col(id_col).alias("doc_id"), train_fold(F.col(id_col))[0].alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(spread(rows), run, "doc_id long, held_out boolean, score double, predicted int, difference double")
