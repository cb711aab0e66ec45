"""Continuous capture: file streams, event-time windows, late duplicates, and a filter that remembers the last kept row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mosaiq.sources.scratch import shared_dir


def read_stream(spark: SparkSession, path: str, time: str = "ts", per_trigger: int | None = 1) -> DataFrame:
    """A file stream of a Parquet table, per_trigger files a batch; None: all files there in one. Watermarks need a timestamp with time zone, so a plain one is read as UTC."""
    schema = spark.read.parquet(path).schema
    # A pattern that only this path fits: file streams take a single file by pattern alone.
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    out = (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(pattern)
    return out.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, keys: list[str], time: str, width: str, late: str) -> DataFrame:
    """Counts and sums per key and window of event time; rows later than the watermark are dropped by Spark."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Append-if-absent on a stream: a key counts once while its watermark lasts."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def kept_scenes(stream: DataFrame, key: str, order: str, value: str, least: float, most: int | None = None) -> DataFrame:
    """Rows that differ by at least `least` from the last row kept of their clip, at most `most` per clip. State: last kept, count.

    Rows of a batch are taken in order; from batch to batch they must arrive in order. A clip's rows of one batch are held at once,
    16 bytes each, as they come unsorted and in several pieces where an Arrow batch ends.
    """

    def run(clip, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        pieces = [(pdf[order].to_numpy(), pdf[value].to_numpy(float)) for pdf in batches]
        orders, values = (np.concatenate(x) for x in zip(*pieces, strict=True))
        keep = []
        for k in np.argsort(orders, kind="stable").tolist():
            v = values[k]
            if (last is None or abs(v - last) >= least) and (most is None or n < most):
                keep.append(k)
                last, n = float(v), n + 1
        if keep:
            yield pd.DataFrame({key: clip[0], order: orders[keep], value: values[keep]})
        state.update((last, n))

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, {value} double", "last double, n long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, name: str, run: str | None = None) -> DataFrame:
    """Run over what is there, then read the result as a table.

    Batches and the stream's progress lie in one folder of the shared folder, by name and run. With the same `run`, a run that
    was cut short goes on where it stopped: a batch's folder is overwritten if the batch is tried again, so none counts
    twice. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/mosaiq-stream-{name}-{run or uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{epoch:09d}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = sorted(str(s.getPath()) for s in found or [])
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))
