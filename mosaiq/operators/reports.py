"""Report aggregations over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of the review queue.
STATUS_POINTS = {"needs_review": 18, "unlabeled": 8}
HEAD_POINTS = {"uid_digit": 42, "agent_icon": 26, "equipment": 12}
FOCUS, SUGGESTED, NO_SUGGESTION, VERY_LOW, LOW = 60, 50, 25, 22, 12


def priority(status: Column, head: Column, has_suggestion: Column, focus_missing: Column, suggestion_missing: Column, confidence: Column, low: tuple[float, float] = (0.45, 0.60)) -> tuple[Column, Column]:
    """(score, reasons joined by ';'). A missing confidence counts as 0, so it is very low."""
    confidence = F.coalesce(confidence, F.lit(0.0))
    rules: list[tuple[Column, int, str]] = [(status == k, n, k) for k, n in STATUS_POINTS.items()]
    rules += [(head == k, n, k) for k, n in HEAD_POINTS.items()]
    rules += [
        (focus_missing, FOCUS, "missing_reviewed_focus"),
        (suggestion_missing, SUGGESTED, "missing_reviewed_suggestion"),
        ((head == "agent_icon") & ~has_suggestion, NO_SUGGESTION, "missing_agent_suggestion"),
        (confidence < low[0], VERY_LOW, "very_low_conf"),
        ((confidence >= low[0]) & (confidence < low[1]), LOW, "low_conf"),
    ]
    score = F.lit(0)
    for rule, points, _ in rules:
        score = score + F.when(rule, points).otherwise(0)
    return score, F.concat_ws(";", *[F.when(rule, F.lit(name)) for rule, _, name in rules])


def deficits(counts: DataFrame, n: str, target: int) -> DataFrame:
    return counts.withColumn("deficit", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col(n)))


def zero_filled(dimension: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """Counts for every row of a dimension, 0 where there are none."""
    return dimension.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))


def roster_array(dimension: DataFrame, ident: str, order: str, most: int = 100_000) -> Column:
    """The ids of a dimension as one literal list, in order; a dimension of more than `most` rows is refused."""
    rows = dimension.select(ident, order).orderBy(order, ident).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a roster of more than {most} rows is no dimension")
    return F.lit([r[0] for r in rows]).cast(f"array<{dimension.schema[ident].dataType.simpleString()}>")


def complement(owned: DataFrame, key: str, ident: str, roster: Column) -> DataFrame:
    """(key, ident) of what each key lacks of a roster (see roster_array). Lists are compared, so nothing is joined."""
    mine = owned.groupBy(key).agg(F.collect_set(ident).alias("mine"))
    return mine.select(key, F.explode(F.array_except(roster, "mine")).alias(ident))


def completeness(df: DataFrame, key: str, split: str, fields: dict[str, Column]) -> DataFrame:
    """Per key: how many rows of each split have each field, unsplit rows included."""
    out = []
    for s in ("train", "val", "test", "unsplit"):
        here = F.coalesce(F.col(split), F.lit("unsplit")) == s
        out += [F.count_if(here & F.coalesce(rule, F.lit(False))).alias(f"{name}_{s}") for name, rule in fields.items()]
    return df.groupBy(key).agg(*out)


def coverage_by_page(df: DataFrame, key: str, page: str, slot: str) -> DataFrame:
    """Whether the last page of a key holds fewer rows than a page can: key, full."""
    pages = df.where(F.col(page) >= 0).groupBy(key, page).agg(F.count("*").alias("n"), F.max(F.coalesce(slot, F.lit(0))).alias("slots"))
    capacity = F.when(F.max("slots") > 0, F.max("slots")).otherwise(F.max("n"))
    out = pages.groupBy(key).agg(F.max_by("n", page).alias("last"), capacity.alias("capacity"))
    return out.select(key, (F.col("last") < F.col("capacity")).alias("full"))
