"""Record fusion: partial observations of one entity merged under precedence, confidence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.ranks import first_per_key

# Thresholds of the fusion rules.
GATES = {"uid_low_confidence": ("uid", 0.9), "agents_low_confidence": ("agents", 0.9), "equipment_low_confidence": ("equipment", 0.85)}
EXPLICIT, SLOT, OVERRIDE, AGREED = 0.99, 0.97, 0.88, 0.97
LEVEL_LEAST, MINDSCAPE_LEAST = 0.78, 0.50
OCCUPIED, EMPTY = 0.58, 0.34
#: Identities by equipment evidence: the flags that must hold, in order of precedence.
EQUIPMENT_SOURCES = [("payload+model", ["payload", "model"]), ("model+ocr", ["model", "ocr"]), ("model", ["model"]), ("ocr", ["ocr"]), ("overview", ["overview"]), ("payload", ["payload"])]


def slot_lookup(asks: DataFrame, known: DataFrame, session: list[str], keys: list[str]) -> DataFrame:
    """Cascading join of (page, slot) to an id within a session: the exact page first, then an entry without page, then any entry of
    the slot where one page is unknown, if those name one id only. asks: session, keys, page, slot; known: session, page,
    slot, id. Adds `id` ('' if none).

    One equi-join on session and slot, ranked, so a row meets the few entries of its own session; null pages never meet by equality.
    """
    met = asks.withColumnRenamed("page", "want").join(known, [*session, "slot"], "left")
    exact = F.col("page").eqNullSafe(F.col("want"))
    loose = F.col("want").isNull() | F.col("page").isNull()
    rank = F.when(exact, 1).when(F.col("page").isNull() & F.col("id").isNotNull(), 2).when(loose, 3)
    met = met.withColumn("rank", F.when(F.coalesce("id", F.lit("")) != "", rank))
    by = [*session, *keys, "want", "slot"]
    best = met.groupBy(*by).agg(
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second"),
        F.when(F.count_distinct(F.when(F.col("rank").isNotNull(), F.col("id"))) == 1, F.max(F.when(F.col("rank").isNotNull(), F.col("id")))).alias("third"),
    )
    return best.select(*session, *keys, F.col("want").alias("page"), "slot", F.coalesce("first", "second", "third", F.lit("")).alias("id"))


def merged_lists(payload: DataFrame, icons: DataFrame, key: str, ident: str, pos: str, payload_name: str, icon_name: str) -> tuple[DataFrame, DataFrame]:
    """Two ordered lists of identities per key become one: icons in their order, then entries only the payload has.

    Returns (merged, reasons). merged: key, ident, icon_pos, payload_pos, ordinal. Repeated identities keep the first and give
    a reason; so does an identity that only one side has, if the other side isn't empty.
    """
    def one(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(key, ident).orderBy(pos)))
        again = ranked.where("_rn > 1").select(key, F.concat(F.lit(f"duplicate_agent_id_from_{name}:"), ident).alias("reason"))
        return ranked.where("_rn = 1").drop("_rn"), again

    p, p_again = one(payload, payload_name)
    i, i_again = one(icons, icon_name)
    both = i.select(key, ident, F.col(pos).alias("icon_pos")).join(p.select(key, ident, F.col(pos).alias("payload_pos")), [key, ident], "full_outer")
    w = W.partitionBy(key)
    both = both.withColumn("_icons", F.count("icon_pos").over(w)).withColumn("_payload", F.count("payload_pos").over(w))
    reason = F.when(F.col("payload_pos").isNull() & (F.col("_payload") > 0), F.concat(F.lit("agent_icon_without_payload:"), ident)).when(F.col("icon_pos").isNull() & (F.col("_icons") > 0), F.concat(F.lit("agent_payload_not_visible_in_roster:"), ident))
    reasons = both.select(key, reason.alias("reason")).where("reason is not null")
    order = W.partitionBy(key).orderBy(F.asc_nulls_last("icon_pos"), F.asc_nulls_last("payload_pos"))
    merged = both.withColumn("ordinal", F.row_number().over(order)).select(key, ident, "icon_pos", "payload_pos", "ordinal")
    return merged, p_again.union(i_again).union(reasons)


def enriched(agents: DataFrame, seen: DataFrame, keys: list[str], ident: str, fields: list[str], overwrite: bool = False) -> DataFrame:
    """Fields of observations fill a record: nulls only, or all if overwrite. If `ident` differs between both, nothing changes.
    Entities that were only observed are appended. Adds `<field>_source`: 'own', 'seen', or null."""
    a, s = agents.alias("a"), seen.alias("s")
    on = [F.col(f"a.{k}") == F.col(f"s.{k}") for k in keys]
    both = a.join(s, on, "full_outer")
    clash = F.col(f"a.{ident}").isNotNull() & F.col(f"s.{ident}").isNotNull() & (F.col(f"a.{ident}") != F.col(f"s.{ident}"))
    out = [F.coalesce(f"a.{k}", f"s.{k}").alias(k) for k in keys] + [F.when(clash, F.col(f"a.{ident}")).otherwise(F.coalesce(f"a.{ident}", f"s.{ident}")).alias(ident)]
    for f in fields:
        new = F.coalesce(f"s.{f}", f"a.{f}") if overwrite else F.coalesce(f"a.{f}", f"s.{f}")
        from_seen = F.col(f"s.{f}").isNotNull() if overwrite else F.col(f"a.{f}").isNull() & F.col(f"s.{f}").isNotNull()
        out += [F.when(clash, F.col(f"a.{f}")).otherwise(new).alias(f), F.when(~clash & from_seen, "seen").when(F.col(f"a.{f}").isNotNull(), "own").alias(f"{f}_source")]
    return both.select(*out)


def accepted_details(by_slot: Column, by_id: Column, least: float) -> Column:
    """A reading from the slot, else from the identity, if its confidence reaches the threshold. struct<value, conf> columns."""
    ok = lambda s: F.when(s["conf"] >= least, s["value"])
    return F.coalesce(ok(by_slot), ok(by_id))


def capture_identity(explicit: Column, slot_id: Column, model_id: Column, model_conf: Column) -> tuple[Column, Column]:
    """(id, confidence) of a capture: stated; slot and model agree; a sure model overrides the slot, an unsure one is rejected; the
    slot alone; the model alone."""
    e, s, m = (F.nullif(F.trim(c), F.lit("")) for c in (explicit, slot_id, model_id))
    differ = s.isNotNull() & m.isNotNull() & (s != m)
    ident = F.when(e.isNotNull(), e).when(differ, F.when(model_conf >= OVERRIDE, m)).otherwise(F.coalesce(s, m))
    conf = (
        F.when(e.isNotNull(), F.lit(EXPLICIT))
        .when(differ, F.when(model_conf >= OVERRIDE, model_conf).otherwise(0.0))
        .when(s.isNotNull() & m.isNotNull(), F.greatest(F.lit(AGREED), model_conf))
        .when(s.isNotNull(), F.lit(SLOT))
        .otherwise(F.coalesce(F.when(m.isNotNull(), model_conf), F.lit(0.0)))
    )
    return ident, conf


def consensus_of(readings: Column, slots: int = 6) -> Column:
    """Confidence that six slots make up known sets. readings: array of struct<slot, ident> in order of appearance; the last filled
    identity of a slot counts, fewer slots give 0."""
    known = F.filter(readings, lambda r: r["slot"].between(1, slots) & (F.trim(F.coalesce(r["ident"], F.lit(""))) != ""))
    last = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda k: F.try_element_at(F.filter(known, lambda r: r["slot"] == k), F.lit(-1))["ident"])
    counts = F.transform(F.array_distinct(F.array_compact(last)), lambda x: F.size(F.filter(last, lambda y: y == x)))
    top, unique = F.array_max(counts), F.size(counts)
    even = ((unique == 3) | (unique == 2)) & (top == F.array_min(counts))
    whole = F.size(F.array_compact(last)) == slots
    return F.when(~F.coalesce(whole, F.lit(False)), 0.0).when(top == 6, 0.92).when(top >= 5, 0.88).when((top == 4) & (unique <= 2), 0.86).when((top == 4) & (unique == 3), 0.80).when(even, 0.80).otherwise(0.0)


def consensus(df: DataFrame, key: str, slot: str, ident: str, pos: str) -> DataFrame:
    """Confidence that the readings of a key, in order of pos, make up known sets: key, confidence. One aggregate, in which a slot's
    last identity is all that a task keeps."""
    filled = F.col(slot).between(1, 6) & (F.trim(F.coalesce(ident, F.lit(""))) != "")
    last = [F.max_by(ident, F.when(filled & (F.col(slot) == k), F.col(pos))).alias(f"_{k}") for k in range(1, 7)]
    readings = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"_{k}").alias("ident")) for k in range(1, 7)])
    return df.groupBy(key).agg(*last).select(key, consensus_of(readings).alias("confidence"))


def agreement(df: DataFrame, keys: list[str], label: str, conf: str, least: float, crops: int = 2) -> DataFrame:
    """Keys whose observations all name one label, are at least `crops`, and are all sure enough: key, label, confidence."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.min(conf).alias("confidence"), F.min(label).alias("label"))
    return out.where((F.col("n") >= crops) & (F.col("labels") == 1) & (F.col("confidence") >= least)).select(*keys, "label", "confidence")


def presence(score: Column) -> Column:
    """True, false, or null where the evidence is ambiguous."""
    return F.when(score >= OCCUPIED, True).when(score <= EMPTY, False)


def open_reasons(reasons: DataFrame, agents: DataFrame, key: str) -> DataFrame:
    """Reasons `agent.suffix` that the agent's state hasn't settled. agents: key, agent, weapon, weapon_present, n_discs,
    slots_empty, level, mindscape (null where unknown)."""
    parts = reasons.withColumn("agent", F.regexp_extract("reason", r"^(.*)\.[a-z]+_missing$", 1)).withColumn("what", F.regexp_extract("reason", r"\.([a-z]+)_missing$", 1))
    met = parts.join(agents, [key, "agent"], "left")
    settled = (
        ((F.col("what") == "weapon") & (F.col("weapon").isNotNull() | ~F.coalesce("weapon_present", F.lit(True))))
        | ((F.col("what") == "discs") & ((F.col("n_discs") > 0) | F.coalesce("slots_empty", F.lit(False))))
        | ((F.col("what") == "level") & F.col("level").isNotNull())
        | ((F.col("what") == "mindscape") & F.col("mindscape").isNotNull())
    )
    return met.where(~F.coalesce(settled, F.lit(False))).select(key, "reason").distinct()


def fresh_gates(reasons: DataFrame, key: str, metrics: DataFrame) -> DataFrame:
    """Top-level low-confidence reasons go once the metric reaches its threshold; metrics has one column per metric."""
    met = reasons.join(metrics, key, "left")
    stale = F.lit(False)
    for name, (metric, least) in GATES.items():
        stale = stale | ((F.col("reason") == name) & (F.coalesce(metric, F.lit(0.0)) >= least))
    return met.where(~stale).select(key, "reason")


def best_observation(df: DataFrame, keys: list[str], confidence: Column, pos: str) -> DataFrame:
    """The surest observation per key, first on ties."""
    return first_per_key(df.withColumn("_c", confidence), keys, [F.desc_nulls_last("_c"), F.asc(pos)]).drop("_c")


def equipment_source(flags: dict[str, Column]) -> Column:
    """Top-level provenance by precedence of the evidence flags, else 'missing'."""
    out = F.lit("missing")
    for name, needed in reversed(EQUIPMENT_SOURCES):
        rule = F.lit(True)
        for f in needed:
            rule = rule & F.coalesce(flags[f], F.lit(False))
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def scan_status(lock_active: Column, layout_ok: Column, anchors_ok: Column, reasons: Column) -> tuple[Column, Column]:
    """(status, code): gates in order fail a session; open reasons degrade it but keep its result."""
    code = F.when(~lock_active, F.lit("INPUT_LOCK_NOT_ACTIVE")).when(~layout_ok, "UNSUPPORTED_LAYOUT").when(~anchors_ok, "ANCHOR_MISMATCH").when(F.size(reasons) > 0, "LOW_CONFIDENCE")
    return F.when(code.isNull(), "ok").when(code == "LOW_CONFIDENCE", "degraded").otherwise("error"), code
