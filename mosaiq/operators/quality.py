"""Model quality as aggregations: calibration error, macro scores, percentiles, class weights, nearest templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.ranks import beside


def exact(c: Column) -> Column:
    """Decimal of nine places, so that sums don't depend on the order of rows."""
    return c.cast("decimal(28,9)")


def calibration_error(df: DataFrame, confidence: Column, correct: Column, bins: int = 15) -> DataFrame:
    """One row: ece and n. Bins are open on the left, so a confidence of 0 falls in none but counts in n."""
    rows = df.select(F.ceil(confidence * bins).alias("bin"), exact(confidence).alias("conf"), correct.cast("int").alias("ok"))
    per_bin = rows.groupBy("bin").agg(F.sum("conf").alias("conf"), F.sum("ok").alias("ok"), F.count("*").alias("n"))
    gap = F.when(F.col("bin") >= 1, F.abs(F.col("ok") - F.col("conf"))).otherwise(0)
    return per_bin.agg((F.sum(gap).cast("double") / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def macro_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro precision, recall, F1 over the union of labels; an undefined ratio counts as 0."""
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit("t").alias("side")), F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side")))).alias("e"), "n", (F.col(truth) == F.col(predicted)).alias("hit"))
    per = sides.groupBy("e.label").agg(
        F.sum(F.when((F.col("e.side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("e.side") == "t", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("e.side") == "p", F.col("n")).otherwise(0)).alias("said"),
    )
    tp, actual, said = F.col("tp"), F.col("actual"), F.col("said")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    mean = lambda c, name: F.round(F.avg(exact(c)).cast("double"), 6).alias(name)
    return per.agg(F.round(F.sum("tp") / F.sum("actual"), 6).alias("accuracy"), mean(ratio(tp, said), "precision"), mean(ratio(tp, actual), "recall"), mean(ratio(2 * tp, actual + said), "f1"))


#: Value ranges per key into which the search for ranks cuts the rows.
RANGES = 32


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key a row per share: name, at (q (n - 1)), low and high, the elements at its floor and ceiling in the sorted values.

    Approximate quantiles cut each key's values into ranges, whose counts tell in which range a rank lies; only those ranges are
    sorted. The result is exact, and no task gets all rows of a key, unless they are equal.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("_cuts"))
    # Equal cuts are one; a row's range is the number of cuts below its value.
    placed = beside(rows, cuts.withColumn("_cuts", F.array_distinct("_cuts")), keys).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    # Equal values are one row with a count, so a frequent value stays small.
    counts = placed.groupBy(*keys, "_r", "_v").agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*keys, "_r").agg(F.sum("_c").alias("_m"))
    over = W.partitionBy(*keys)
    sizes = sizes.withColumn("_before", F.sum("_m").over(over.orderBy("_r")) - F.col("_m")).withColumn("_n", F.sum("_m").over(over))
    names, qs = F.array(*[F.lit(n) for n in shares]), F.array(*[F.lit(float(q)) for q in shares.values()])
    at = F.transform(F.arrays_zip(names.alias("name"), qs.alias("q")), lambda x: F.struct(x["name"].alias("name"), (x["q"] * (F.col("_n") - 1)).alias("at")))
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m"))
    wanted = F.filter(at, lambda x: inside(F.floor(x["at"])) | inside(F.ceil(x["at"])))
    asked = sizes.withColumn("_asked", wanted).where(F.size("_asked") > 0).drop("_m", "_n")
    ranked = beside(counts, asked, [*keys, "_r"]).withColumn("_last", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_r").orderBy("_v")))
    held = lambda r: (r < F.col("_last")) & (r >= F.col("_last") - F.col("_c"))
    told = ranked.select(*keys, "_v", "_c", "_last", F.inline("_asked"))
    return told.groupBy(*keys, "name", "at").agg(F.max(F.when(held(F.floor("at")), F.col("_v"))).alias("low"), F.max(F.when(held(F.ceil("at")), F.col("_v"))).alias("high"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], found: Column) -> DataFrame:
    stats = order_statistics(df, keys, value, shares).withColumn("_v", found)
    return stats.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in shares])


def floor_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the element at index int(q (n - 1)) of the sorted values."""
    return percentiles(df, keys, value, shares, F.col("low"))


def linear_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the value at q (n - 1), between two elements in proportion."""
    part = F.col("at") - F.floor("at")
    return percentiles(df, keys, value, shares, F.col("low") + part * (F.col("high") - F.col("low")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: total over count, scaled to mean 1 over the labels. A window over labels, of which a head has a few."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    raw = F.sum("n").over(everything) / F.greatest(F.col("n"), F.lit(1))
    return counts.withColumn("_w", raw).withColumn("weight", F.round(F.col("_w") / F.avg("_w").over(everything), 6)).drop("_w")


def nearest_templates(df: DataFrame, key: str, vector: str, templates: DataFrame, label: str, template: str, most: int = 10_000) -> DataFrame:
    """key, label of the nearest template by mean squared error, its error, and the margin to the second label.

    Templates are a table of at most `most` rows, which each task holds as one matrix; rows only pass through. Vectors that are
    null or of another length have no answer and are left out.
    """
    rows = sorted((r[0], list(r[1])) for r in templates.select(label, template).limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    names = sorted({r[0] for r in rows})
    matrix = np.array([r[1] for r in rows], float)
    owner = np.array([names.index(r[0]) for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == matrix.shape[1] for v in pdf[vector]]] if len(rows) else pdf[:0]
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, float) for v in pdf[vector]])
            best = np.full((len(x), len(names)), np.inf)
            for k, t in enumerate(matrix):
                best[:, owner[k]] = np.minimum(best[:, owner[k]], ((x - t) ** 2).mean(axis=1))
            order = best.argsort(axis=1, kind="stable")
            first = best[np.arange(len(x)), order[:, 0]]
            margin = best[np.arange(len(x)), order[:, 1]] - first if len(names) > 1 else np.full(len(x), np.nan)
            yield pd.DataFrame({key: pdf[key].to_numpy(), label: [names[k] for k in order[:, 0]], "error": first, "margin": margin})

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    return df.select(key, vector).mapInPandas(run, f"{key} {kind(df, key)}, {label} {kind(templates, label)}, error double, margin double")


# Fixed values of the template confidence: base, its two shares, and where error and margin saturate.
BASE, ERROR_SHARE, MARGIN_SHARE, ERROR_FULL, MARGIN_FULL, MOST = 0.72, 0.18, 0.10, 0.25, 0.12, 0.999


def template_confidence(error: Column, margin: Column) -> Column:
    """Surer for a small error and a wide margin."""
    near = 1 - F.least(error, F.lit(ERROR_FULL)) / ERROR_FULL
    apart = F.least(F.greatest(F.coalesce(margin, F.lit(1.0)), F.lit(0.0)), F.lit(MARGIN_FULL)) / MARGIN_FULL
    return F.least(F.lit(MOST), BASE + ERROR_SHARE * near + MARGIN_SHARE * apart)
