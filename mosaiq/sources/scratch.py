"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that were made because none was set, by application.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without and gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting can't be changed in a running session; the folder is kept for the application.
        app = spark.sparkContext.applicationId
        base = OWN.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='mosaiq-')}"
        OWN[app] = base
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosaiq-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned and that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete all intermediate tables of the shared folder, and tell how many. Results that still read them must be written first."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mosaiq-*")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.globStatus(pattern) or []]
    for path in found:
        store.delete(path, True)
    return len(found)
