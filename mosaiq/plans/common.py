"""Tables of the driver by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded_text(c: Column) -> Column:
    """A double rounded to two decimals, as plain text below 1e15. Rounded as DuckDB does it: times 100, half away from zero, over
    100; Spark's own rounding takes the shortest decimal of the double, which may lie on the other side of the half."""
    x = F.round(F.abs(c) * 100) / 100
    x = F.when(c < 0, -x).otherwise(x)
    plain = F.regexp_replace(x.cast("decimal(20,2)").cast("string"), "0$", "")
    return F.when(F.abs(x).between(1e7, 999_999_999_999_999.0), plain).otherwise(x.cast("string"))
