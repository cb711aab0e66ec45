"""Gives the package to executors whose Python can't find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent


def ship_code(spark: SparkSession) -> None:
    """Send the package as a zip to all executors, once per context, unless the workers' path or folder holds it already."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if ROOT in [*paths, Path.cwd()] or getattr(context, "_mosaiq_shipped", False):
        return
    with tempfile.TemporaryDirectory(prefix="mosaiq-code-") as folder:
        base = f"{folder}/copy"
        shutil.copytree(ROOT / "mosaiq", f"{base}/mosaiq", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(f"{folder}/mosaiq_code", "zip", base)
        # The context copies the file to its own folder, from which executors fetch it.
        kept = Path(tempfile.mkdtemp(prefix="mosaiq-code-")) / "mosaiq_code.zip"
        shutil.copy(made, kept)
    context.addPyFile(str(kept))
    context._mosaiq_shipped = True


#: Bytes of the batches in which rows go to Python; Spark's own bound is far higher.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """What an application does once with its session: executors get the package, and rows go to Python in small batches.

    Operators leave the session's settings alone, and are right under any.
    """
    ship_code(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, preparing the session first."""

    def run(spark: SparkSession, *args) -> DataFrame:
        prepare(spark)
        return query(spark, *args)

    run.__name__, run.__doc__ = getattr(query, "__name__", "query"), query.__doc__
    return run
