"""Curation of a record table: joins to dimensions, upserts, duplicates, votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.ranks import first_per_key


def last_per_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of repeated keys the last row wins; blank keys go."""
    return first_per_key(df.where(F.coalesce(F.trim(key), F.lit("")) != ""), [key], [F.desc(ordinal)])


def with_source(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Left join to the provenance rows (one per key); Spark broadcasts them if they are small."""
    return records.join(sources, key, "left")


def pruned(records: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`, the first rule that drops a row; null rows stay."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(reasons):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return records.withColumn("reason", out)


def exact_dedup(df: DataFrame, content: Column, key: str, existing: DataFrame | None = None) -> DataFrame:
    """First row (least key) of each content hash, without hashes that exist already. Only keys and hashes are shuffled."""
    hashed = df.select(F.col(key), F.sha2(content.cast("binary"), 256).alias("sha256"))
    first = hashed.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min(key).alias(key), F.count("*").cast("long").alias("copies"))
    return first.join(existing, "sha256", "left_anti") if existing is not None else first


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(new.join(existing, key, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise update: filled new fields win, others stay; unknown keys are added. Adds `changed`."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    merged = [F.coalesce(f"n.{f}", f"o.{f}").alias(f) for f in fields]
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(f"n.{f}", f"o.{f}").eqNullSafe(F.col(f"o.{f}"))
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *merged, (~same).alias("changed"))


def replaced_children(derived: DataFrame, new: DataFrame, touched: DataFrame, parent: str) -> DataFrame:
    """Derived rows of touched parents go, whether or not they yield new ones; the new ones are added."""
    return derived.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(new)


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """key, resolved, resolution. Blank votes don't count. One value alone wins; else it needs three votes against one at most."""
    counts = votes.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    top = counts.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    both = top.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col(value))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("n"))), F.lit(0)).alias("n2"))
    all_keys = votes.select(key).distinct().join(both, key, "left")
    resolution = F.when(F.col("best").isNull(), "no_ocr").when(F.col("n2") == 0, "single_unique").when((F.col("n1") >= 3) & (F.col("n2") <= 1), "strong_majority").otherwise("conflicting_ocr")
    return all_keys.select(key, F.when(resolution.isin("single_unique", "strong_majority"), F.col("best")).otherwise("").alias("resolved"), resolution.alias("resolution"))


def clusters_applied(clusters: DataFrame, members: str, wanted: str, records: DataFrame, key: str, current: str) -> DataFrame:
    """One row per cluster member that exists: `applied` or `conflict` if it holds another value already."""
    rows = clusters.select(F.explode(members).alias(key), F.col(wanted).alias("wanted")).join(records.select(key, F.col(current).alias("current")), key)
    status = F.when(F.coalesce("current", F.lit("")).isin("") | (F.col("current") == F.col("wanted")), "applied").otherwise("conflict")
    return rows.withColumn("status", status)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(df: DataFrame, key: str, bits: str, most: int = 6, shift: int = 48) -> DataFrame:
    """Pairs (a < b) whose 64-bit hashes agree in the top bits and differ in at most `most`. Equal hashes are one class first,
    so copies aren't expanded into pairs: each class is represented by its least key."""
    reps = df.groupBy(bits).agg(F.min(key).alias(key)).withColumn("bucket", F.shiftrightunsigned(F.col(bits), shift))
    a = reps.select(F.col(key).alias("a"), F.col(bits).alias("bits_a"), "bucket")
    b = reps.select(F.col(key).alias("b"), F.col(bits).alias("bits_b"), "bucket")
    return a.join(b, "bucket").where(F.col("a") < F.col("b")).withColumn("distance", hamming(F.col("bits_a"), F.col("bits_b"))).where(F.col("distance") <= most).select("a", "b", "distance")


def greedy_survivors(df: DataFrame, key: str, bits: str, content: str | None = None, similar: Callable | None = None, least: float = 0.97, most: int = 6, shift: int = 48) -> DataFrame:
    """Rows in key order are accepted unless an accepted row of their bucket lies within the distance and, with content, is also
    similar by at least `least`; adds `accepted`. similar: function of two contents.

    The outcome depends on the order by definition. Rows of equal hash and content collapse first (only their least key can be
    accepted), so a bucket holds at most the distinct ones that share the top bits.
    """
    same = [bits, *([content] if content else [])]
    reps = df.groupBy(*same).agg(F.min(key).alias("rep")).withColumn("bucket", F.shiftrightunsigned(F.col(bits), shift))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        values = pdf[bits].to_numpy().astype(np.int64).view(np.uint64)
        held = pdf[content].to_list() if content else None
        kept, at, flags = np.empty(len(values), np.uint64), [], []
        for i, value in enumerate(values):
            (near,) = (np.bitwise_count(kept[: len(at)] ^ value) <= most).nonzero()
            ok = not (any(similar(held[at[j]], held[i]) >= least for j in near) if content else len(near))
            flags.append(ok)
            if ok:
                kept[len(at)] = value
                at.append(i)
        return pdf.assign(accepted=flags)[["rep", "accepted"]]

    verdicts = reps.groupBy("bucket").applyInPandas(run, "rep long, accepted boolean")
    return df.select(key).join(verdicts.withColumnRenamed("rep", key), key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def scene_keepers(df: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """Rows whose value differs by at least `least` from the last row that was kept; the first is kept. Streams one clip at a time
    in sorted partitions, so a clip may be longer than memory."""
    sorted_rows = df.select(key, order, value).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, last = object(), 0.0
        for pdf in batches:
            keep = []
            for k, v in zip(pdf[key], pdf[value], strict=True):
                if k != clip:
                    clip, last, ok = k, v, True
                else:
                    ok = abs(v - last) >= least
                    last = v if ok else last
                keep.append(ok)
            yield pdf[keep]

    return sorted_rows.mapInPandas(run, df.select(key, order, value).schema)


def fixpoint(seeds: DataFrame, step) -> DataFrame:
    """Adds step(trusted) rows until none is new. step gets all trusted rows and returns rows of the same columns. Each
    round is written to the shared checkpoint folder, so lineage stays short and survives lost executors."""
    from mosaiq.sources.scratch import written

    trusted = written(seeds, "fixpoint")
    while True:
        new = written(step(trusted).join(trusted, trusted.columns[0], "left_anti"), "fixpoint")
        if new.isEmpty():
            return trusted
        trusted = written(trusted.unionByName(new), "fixpoint")


def backfilled(df: DataFrame, fields: dict[str, Column], only_missing: bool = True) -> DataFrame:
    """Fields set to derived values, missing ones only or all; adds `changed`, null-safe, for the count of changed rows."""
    new = {f: F.coalesce(F.col(f), c) if only_missing else c for f, c in fields.items()}
    same = F.lit(True)
    for f, c in new.items():
        same = same & c.eqNullSafe(F.col(f))
    return df.withColumn("changed", ~same).withColumns(new)


def pack_plan(files: DataFrame, roles: DataFrame, order: str) -> DataFrame:
    """Files in order against the planned (ordinal, agent, role) list: file, agent, role, target; `error` if counts differ.

    Positions come from a window over one batch of files, which a person sorted by hand."""
    listed = files.withColumn("ordinal", F.row_number().over(W.orderBy(order)).cast("long"))
    both = listed.join(roles, "ordinal", "full_outer")
    error = F.when(F.col("path").isNull(), "file_missing").when(F.col("role").isNull(), "role_missing")
    return both.select("ordinal", "path", "agent", "role", F.concat_ws("/", "agent", F.concat_ws("_", F.lpad(F.col("ordinal").cast("string"), 4, "0"), "role")).alias("target"), error.alias("error"))


def sheet_layout(df: DataFrame, group: str, order: list[Column], columns: int = 3) -> DataFrame:
    """Row and column of each thumbnail on its group's contact sheet."""
    at = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("sheet_row", F.floor(at / columns).cast("int")).withColumn("sheet_col", (at % columns).cast("int"))


def sampled_frames(frames: DataFrame, clip: str, index: str, fps: Column, wanted: float, most: int) -> DataFrame:
    """Every round(fps / wanted)-th frame of a clip, at most `most` of them; both are features of the sampling."""
    step = F.greatest(F.lit(1), F.round(fps / wanted).cast("int"))
    kept = frames.where(F.col(index) % step == 0).withColumn("_rn", F.row_number().over(W.partitionBy(clip).orderBy(index)))
    return kept.where(F.col("_rn") <= most).drop("_rn")


def pack_reviews(packs: DataFrame, key: list[str], role: str, slot: str) -> DataFrame:
    """Per capture pack: its counts by role, whether it is ambiguous (not exactly one overview, more than one amplifier, or a slot
    twice), and the occupancy its discs prove."""
    one = packs.groupBy(*key).agg(
        F.count_if(F.col(role) == "equipment").alias("overviews"), F.count_if(F.col(role) == "amplifier_detail").alias("amplifiers"),
        F.count_if(F.col(role) == "disk_detail").alias("discs"), F.array_sort(F.collect_set(F.when(F.col(role) == "disk_detail", F.col(slot)))).alias("slots"),
    )
    ambiguous = (F.col("overviews") != 1) | (F.col("amplifiers") > 1) | (F.size("slots") < F.col("discs"))
    return one.withColumn("ambiguous", ambiguous)


def typed_tokens(df: DataFrame, keys: list[str], order: str, value: str, height: str, share: float = 0.72) -> DataFrame:
    """Tokens of a recognised field: small ones are marks, a last mark is a percent sign; the rest are digits, joined in order."""
    w = W.partitionBy(*keys)
    middle = F.percentile(height, F.lit(0.5)).over(w)
    last = F.lead(order).over(w.orderBy(order)).isNull()
    rows = df.withColumn("kind", F.when(F.col(height) >= share * middle, "digit").when(last, "percent").otherwise("mark"))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "digit", F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias("digits"), F.bool_or(F.col("kind") == "percent").alias("percent"), F.count_if(F.col("kind") == "mark").alias("marks"))


def catalogue_entries(rows: DataFrame, catalogue: DataFrame, key: str, name: str, pos: str) -> DataFrame:
    """Reviewed rows against a catalogue: an id keeps its catalogue name, else the first filled name seen; aliases are the distinct
    other names in order of appearance. Entries of either side stay."""
    seen = rows.where(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(key).agg(
        F.min_by(F.trim(name), F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.col(pos))).alias("seen_name"),
        F.array_sort(F.collect_list(F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.struct(F.col(pos).alias("p"), F.trim(name).alias("n"))))).alias("names"),
        F.count("*").alias("samples"),
    )
    both = seen.join(catalogue.select(key, F.col("display").alias("known")), key, "full_outer")
    shown = F.coalesce("known", "seen_name")
    aliases = F.array_distinct(F.transform(F.coalesce("names", F.array().cast("array<struct<p:long,n:string>>")), lambda x: x["n"]))
    return both.select(key, shown.alias("display"), F.filter(aliases, lambda a: a != shown).alias("aliases"), F.coalesce("samples", F.lit(0).cast("long")).alias("samples"))
