"""Order-dependent operators that keep their exact meaning on many partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first in order. Spark keeps only the first rows before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet null keys."""
    renamed = right.withColumnsRenamed({k: f"_right{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_right{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, same).drop(*[f"_right{i}" for i in range(len(keys))])


def ranked_by_hash(df: DataFrame, key: str, seed: str, rank: str, digits: int = 3, within: list[str] | None = None) -> DataFrame:
    """Rank from 1 of rows by md5(seed || key), and `{rank}_of`, their number: of all rows, or of those with equal `within` columns.

    Rows are cut into 16**digits buckets by the hash's first digits; the table of bucket sizes has that many rows at most, for
    each value of `within`, and tells each bucket where it begins, so no window spans all rows.
    """
    groups = within or []
    h = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, digits))
    sizes = h.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(*groups, "_b", (F.sum("_n").over(W.partitionBy(*groups).orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*groups)).alias(f"{rank}_of"))
    out = beside(h, before if groups else F.broadcast(before), [*groups, "_b"])
    return out.withColumn(rank, F.col("_before") + F.row_number().over(W.partitionBy(*groups, "_b").orderBy("_h", key))).drop("_h", "_b", "_before")


def group_splits(df: DataFrame, group: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(group, split): groups in hash order are cut at int(G * ratio); the rest is test. Ratios cut groups, not rows."""
    ranks = ranked_by_hash(df.select(group).distinct(), group, seed, "_r")
    cut = F.floor(F.col("_r_of") * train)
    split = F.when(F.col("_r") <= cut, "train").when(F.col("_r") <= cut + F.floor(F.col("_r_of") * val), "val").otherwise("test")
    return ranks.select(group, split.alias("split"))


def hash_sample(df: DataFrame, key: str, seed: str, ratio: float) -> DataFrame:
    """The first max(1, int(n * ratio)) rows in hash order."""
    ranks = ranked_by_hash(df, key, seed, "_r")
    return ranks.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_r_of") * ratio))).drop("_r", "_r_of")


def even_sample(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """k evenly spaced rows per group, ends included; one row if k is 1, all if the group is smaller."""
    w = W.partitionBy(*keys)
    out = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if k == 1:
        keep = F.col("_r") == 0
    else:
        # rank r is floor(i (n - 1) / (k - 1)) for some i: the least i that reaches r must hit it.
        i = F.floor((F.col("_r") * (k - 1) + F.col("_n") - 2) / (F.col("_n") - 1))
        keep = (F.col("_n") <= k) | (F.floor(i * (F.col("_n") - 1) / (k - 1)) == F.col("_r"))
    return out.where(keep).drop("_r", "_n")


def stratified_splits(df: DataFrame, label: str, key: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds `split`, cut per label in hash order at int(n * ratio)."""
    out = ranked_by_hash(df, key, seed, "_r", within=[label])
    cut = F.floor(F.col("_r_of") * train)
    return out.withColumn("split", F.when(F.col("_r") <= cut, "train").when(F.col("_r") <= cut + F.floor(F.col("_r_of") * val), "val").otherwise("test")).drop("_r", "_r_of")


def merge_splits(existing: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """New assignments replace old ones of the same rows; other old ones stay."""
    return existing.join(assigned, key, "left_anti").unionByName(assigned)


def round_robin(df: DataFrame, group: str, score: str, key: str, batch: int, batches: int, prefix: str = "batch-") -> DataFrame:
    """Review queue: the best of each group in turn, then the second of each. The queue is a report of at most batch * batches
    rows; adds `position` from 1 and `batch_id`. Order by (turn, score of the row, group) equals the loop over groups."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), F.asc(key)))
    # Of no group more rows than the queue holds, which Spark applies before it shuffles.
    top = df.withColumn("turn", turn).where(F.col("turn") <= batch * batches).orderBy("turn", F.desc(score), group).limit(batch * batches)
    out = top.withColumn("position", F.row_number().over(W.orderBy("turn", F.desc(score), group)))
    number = F.floor((F.col("position") - 1) / batch) + 1
    return out.withColumn("batch_id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), 3, "0")))


def islands(df: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Number of the pack a row is in: each row where `starts` holds opens one; rows before the first form pack 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def gap_bands(df: DataFrame, keys: list[str], at: Column, order: list[Column], gap: float, name: str) -> DataFrame:
    """Bands of rows, split where the step from the row before exceeds the gap."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("_step", at - F.lag(at).over(w))
    return islands(step, keys, order, F.col("_step") > gap, name).drop("_step")


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key become one: keys, start, end, n."""
    order = [F.col(start), F.col(end)]
    past = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    marked = df.withColumn("_top", F.max(end).over(past))
    packs = islands(marked, keys, order, F.col("_top").isNull() | (F.col(start) > F.col("_top")), "_island")
    return packs.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").cast("long").alias("n")).drop("_island")


def best_window(df: DataFrame, keys: list[str], order: list[Column], value: Column, width: int) -> DataFrame:
    """Start of the run of exactly `width` rows with the least spread of a value, first on ties: keys, ordinal, spread."""
    w = W.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(W.currentRow, width - 1)
    rows = df.withColumn("ordinal", F.row_number().over(w)).withColumn("spread", F.round(F.stddev_pop(value).over(run), 6)).withColumn("_n", F.count("*").over(run))
    return first_per_key(rows.where(F.col("_n") == width), keys, [F.asc("spread"), F.asc("ordinal")]).select(*keys, "ordinal", "spread")


def winners_and_losers(df: DataFrame, alias: str, ident: str, quality: Column, samples: str) -> tuple[DataFrame, DataFrame]:
    """Per alias the best identity by (quality, samples, id), and each other one beside the winner."""
    w = W.partitionBy(alias).orderBy(F.desc(quality), F.desc(samples), F.asc(ident))
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("winner", F.first(ident).over(w))
    return ranked.where("_rn = 1").drop("_rn", "winner"), ranked.where("_rn > 1").drop("_rn")
