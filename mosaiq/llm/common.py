"""Shared plumbing of the corpus operators: tables, scratch storage, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.sources.scratch import discard, shared_dir, written  # noqa: F401 (the operators take them from here)

#: Rows and bytes of whole texts that a worker takes at a time; Spark bounds the bytes of the batches that it sends.
PART_ROWS, PART_BYTES = 512, 8 << 20
#: A key with more than one PARTS-th of all rows is dealt into copies; there are fewer than PARTS such keys.
PARTS = 4096
#: Estimated bytes below which a table counts as small for `spread`.
SMALL_BYTES = 16 << 20
#: Java form of a word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files goes to all cores before Python works on it; larger ones have partitions enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def salted(rows: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `salt`, hot keys with their copies), for a join that no frequent key overloads. rows: a written table."""
    most = rows.count() // PARTS + 1
    hot = written(rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("copies")).where("copies > 1"), "hot")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("copies", F.lit(1))).cast("int"))
    return dealt.drop("copies"), hot


def copied(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The other side of that join: a row per copy of its key."""
    both = table.join(F.broadcast(hot), key, "left")
    return both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to few rows; a single row may be longer than the bound."""
    for batch in batches:
        n = batch.num_rows
        rows = max(1, min(PART_ROWS, n * PART_BYTES // max(batch.nbytes, 1)))
        for start in range(0, n, rows):
            yield batch.slice(start, rows)


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch, which gets few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield from per_batch(part)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to about most_bytes; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most_bytes:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Words of which a worker remembers what it found out.
MOST_WORDS = 400_000
#: What this process keeps from task to task: kind -> (version, object). One object of a kind, so memory stays bounded.
HELD: dict[str, tuple] = {}


def held(kind: str, version, make: Callable):
    """The object that this process made for a version, made on first use and again if the version differs. It must be a pure
    function of the version, so that it doesn't matter which tasks share it."""
    if kind not in HELD or HELD[kind][0] != version:
        HELD[kind] = (version, make())
    return HELD[kind][1]


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS and len(word) <= 64:
            self[word] = h
        return h


def word_ids(words: list[bytes], hashes: dict) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` ids; of a shorter sequence, one hash of the whole."""
    n = len(ids)
    if not n:
        return np.empty(0, dtype=np.uint64)
    width = min(width, n)
    acc = np.full(n - width + 1, np.uint64(width * 0x9E3779B97F4A7C15 % 2**64), dtype=np.uint64)
    for k in range(width):
        acc = mixed(acc ^ ids[k : n - width + 1 + k])
    return acc


def train_fold(doc_id: Column) -> tuple[Column, Column]:
    """(held out, may be learned from): by crc32 of the id as text, modulo 5; a null id is in neither."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False)), F.coalesce(rest != 0, F.lit(False))
