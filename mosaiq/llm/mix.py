"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target of words and a schedule, a piecewise-linear relative rate over training time 0 to 1. Its
integral, scaled to the target, is the words wanted by time t. The source's documents lie end to end in an order drawn
by hash, three times over; a copy whose middle is at word u is wanted when the integral reaches u, which inverts to its
training position in closed form. Copies past the target are not taken. The mix is range-sorted by position.

Plan: running sums are made in two levels, so no source is ever in one task. A source of n documents is cut into
n / PER_BUCKET buckets by hash; sums of buckets are added up per source, documents within a bucket. Targets are found
from one small table with a row per source; only scalars of it come to the driver.

Defined results: null texts have size 0; null sources count as one source, last in order; null ids are ordinary
values, as draws and ties go by a hash of id and text; rows repeated in both are documents of their own that stand next to each other; other columns are carried only if asked for. An empty table, or one
without words, takes nothing and has targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm.common import WORD, written

PER_BUCKET = 2_000
#: Size up to which the table of sources is broadcast.
BROADCAST_BYTES = 4 << 20
MOST_COPIES = 3
#: Relative rates at knots (time, rate), dealt to the sources in turn: rising, even, falling, and a bump in the middle.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.6), (0.5, 1.4), (1.0, 0.6)))


def integral(knots: tuple[tuple[float, float], ...], t: float) -> float:
    """Share of a source's words that its schedule wants by time t."""
    def area(until: float) -> float:
        total = 0.0
        for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
            if until > t0:
                x = min(until, t1) - t0
                total += r0 * x + (r1 - r0) / (t1 - t0) * x * x / 2
        return total

    return area(t) / area(knots[-1][0])


def inverse(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """Time at which the integral reaches a share of the words, as a column expression."""
    whole = sum((r0 + r1) * (t1 - t0) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False))
    out, done = None, 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        area = share * whole - F.lit(done)
        slope = (r1 - r0) / (t1 - t0)
        # r0 x + slope x^2 / 2 = area
        x = area / r0 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(r0 * r0 + 2 * slope * area, F.lit(0.0))) - r0) / slope
        t = F.least(F.lit(t1), F.greatest(F.lit(t0), t0 + x))
        done += (r0 + r1) * (t1 - t0) / 2
        out = F.when(share * whole <= F.lit(done), t) if out is None else out.when(share * whole <= F.lit(done), t)
    return out.otherwise(F.lit(knots[-1][0]))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `ordinal` from 0 by code point, null last: counts of range partitions give each its offset."""
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(8, F.col("no_source"), F.col("source")).sortWithinPartitions("no_source", "source")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # eight rows at most
    offset, so_far = F.lit(0), 0
    for part in sorted(counts):
        offset = F.when(F.col("part") == part, F.lit(so_far)).otherwise(offset)
        so_far += counts[part]
    return ranged.withColumn("ordinal", F.col("seq") + offset).drop("part", "seq")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int = MOST_COPIES) -> DataFrame:
    """Adds weight and target: share of all words by weight, none above `most` times its source, the excess reshared.

    A target is min(cap, level * weight). The level starts as if nothing were capped and rises as sources drop out; each
    round is one aggregate over the table of sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = out.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        row = out.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row.n == capped or not row.w:
            break
        capped, level = row.n, (share * total - row.taken) / row.w
    return out.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def assign(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, schedules: tuple = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, mark (hash of id and text), positions (one per copy, ascending by copy); with carry, also the struct
    `carried` of all columns of docs, whatever their names."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        words(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))).cast("binary")).alias("mark"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] if carry else []),
    )
    # The draw: the first 40 bits of a hash of id and text as a number from 0 to 1; the whole hash orders what draws alike.
    base = base.withColumn("draw", F.conv(F.substring("mark", 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))).withColumn("mark", F.unhex("mark"))
    slim = written(base.select("doc_id", "source", "no_source", "size", "draw", "mark"), "sizes")
    per_source = slim.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = written(targets(numbered(per_source), weights, share).withColumn("buckets", F.ceil(F.col("n") / PER_BUCKET).cast("long")), "targets")
    key = ["no_source", "source"]
    # The table of sources goes to every task only if it is small; else Spark may split its hot keys.
    held = table.agg(F.coalesce(F.sum(F.octet_length("source") + 64), F.lit(0))).first()[0]
    table = F.broadcast(table) if held <= BROADCAST_BYTES else table
    bucket = F.floor(F.col("draw") * F.col("buckets"))
    sums = slim.join(table.select(*key, "buckets"), key).withColumn("bucket", bucket).groupBy(*key, "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*key, "bucket", before.alias("before"))
    rows = (base if carry else slim).join(table, key).withColumn("bucket", bucket).join(starts, [*key, "bucket"])
    own = W.partitionBy(*key, "bucket").orderBy("draw", "mark").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("middle", F.col("before") + F.sum("size").over(own) - F.col("size") / 2)
    copies = F.ceil((F.col("target") - F.col("middle")) / F.col("source_size")).cast("int")
    copies = F.when((F.col("source_size") > 0) & (F.col("target") > F.col("middle")), F.least(copies, F.lit(MOST_COPIES))).otherwise(0)
    rows = rows.withColumn("copies", copies)

    def position(epoch: int) -> Column:
        share_done = (F.col("middle") + F.lit(epoch) * F.col("source_size")) / F.col("target")
        out = inverse(schedules[-1], share_done)
        for k, s in enumerate(schedules[:-1]):
            out = F.when(F.col("ordinal") % len(schedules) == k, inverse(s, share_done)).otherwise(out)
        return F.when(F.col("copies") > epoch, out)

    positions = F.array_compact(F.array(*[position(e) for e in range(MOST_COPIES)]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "mark", positions.alias("positions"), *(["carried"] if carry else []))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy; documents that aren't taken come last."""
    rows = assign(docs, **how).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return rows.orderBy(F.col("position").asc_nulls_last(), "mark").select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The training order: all columns of docs, copy (from 0) and position, one row per copy taken, range-sorted by position.
    Columns of docs that are named copy or position give way to these."""
    rows = assign(docs, carry=True, **how).select("mark", "carried", F.posexplode("positions").alias("copy", "position"))
    rows = rows.orderBy("position", "mark", "copy")
    return rows.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c not in ("copy", "position")], "copy", "position")
