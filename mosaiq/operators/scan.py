"""The strict scan as one plan over many sessions: payload agents, icons and pixel observations fused into one record each.

Each observation table is keyed by sessionId, so nothing crosses sessions and all joins share that partitioning. Gates
and low confidence are columns (`status`, `code`, `lowConfReasons`); a degraded session keeps its partial result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions.policy import text
from mosaiq.functions.texts import all_empty, fraction
from mosaiq.operators import fusion

# Confidences of payload fields.
MISSING_LEVEL, LEVEL_BASE, LEVEL_SPAN, MINDSCAPE_SPAN = 0.24, 0.88, 0.12, 0.10
PRESENT, ABSENT, OVERRIDDEN, DERIVED, UNKNOWN = 0.9, 0.22, 0.92, 0.76, 0.18
EMPTY_LOW, EMPTY_HIGH, KNOWN_REGION, OTHER_REGION, STATED = 0.90, 0.94, 0.97, 0.83, 0.99
ICON_LEAST = 0.72
ANCHORS = ("profile", "agents", "equipment")


def occupancy(weapon: Column, discs: Column, stated_weapon: Column, stated_slots: Column) -> tuple[Column, Column]:
    """(weaponPresent, discSlotOccupancy): stated values first; a filled weapon and filled slots are present whatever is stated."""
    slots = F.transform(F.coalesce(discs, F.array().cast(discs_type())), lambda d: d["slot"])
    keys = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: k.cast("string"))
    filled = F.transform(keys, lambda k: F.coalesce(F.array_contains(slots, k.cast("int")), F.lit(False)) | F.coalesce(stated_slots[k], F.lit(False)))
    any_value = (F.coalesce(weapon["weaponId"], F.lit("")) != "") | (F.coalesce(weapon["displayName"], F.lit("")) != "") | weapon["level"].isNotNull()
    present = F.coalesce(stated_weapon, any_value, F.lit(False))
    return present, F.map_from_arrays(keys, filled)


def discs_type() -> str:
    return "array<struct<slot:int,setId:string,displayName:string,level:double,levelCap:double>>"


def meaningful_discs(discs: Column) -> Column:
    return F.coalesce(F.exists(discs, lambda d: (text(d["setId"]) != "") | (text(d["displayName"]) != "")), F.lit(False))


def payload_agents(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents, reasons) of the payload lists: one row per agent with values, a confidence and a source per field."""
    rows = sessions.select("sessionId", F.posexplode("agents").alias("pos", "a"))
    ident = text(F.col("a.agentId"))
    nameless = rows.where(ident == "").select("sessionId", F.format_string("agent[%d].agentId_missing", "pos").alias("reason"))
    rows = rows.where(ident != "").withColumn("agentId", ident)
    level_ok = F.col("a.level").isNotNull() & F.col("a.levelCap").isNotNull()
    mind_ok = F.col("a.mindscape").isNotNull() & F.col("a.mindscapeCap").isNotNull()
    has_weapon = (text(F.col("a.weapon.weaponId")) != "") | (text(F.col("a.weapon.displayName")) != "")
    has_discs = meaningful_discs(F.col("a.discs"))
    present, slots = occupancy(F.col("a.weapon"), F.col("a.discs"), F.col("a.weaponPresent"), F.col("a.discSlotOccupancy"))
    rows = rows.withColumns({"level_ok": level_ok, "mind_ok": mind_ok, "has_weapon": F.coalesce(has_weapon, F.lit(False)), "has_discs": has_discs, "weaponPresent": present, "slots": slots})
    occ = F.when(F.col("has_weapon") | F.col("has_discs"), DERIVED).otherwise(UNKNOWN)
    empty = F.least(F.lit(EMPTY_HIGH), F.greatest(occ, F.lit(EMPTY_LOW)))
    no_weapon = ~F.col("has_weapon") & F.col("a.weaponPresent").isNotNull() & ~F.col("weaponPresent")
    no_discs = ~F.col("has_discs") & F.col("a.discSlotOccupancy").isNotNull() & all_empty(F.col("slots"))
    payload = lambda ok: F.when(ok, "session_payload").otherwise("missing")
    agents = rows.select(
        "sessionId", "agentId", F.col("pos"), F.col("a.pageIndex").alias("pageIndex"), F.col("a.agentSlotIndex").alias("agentSlotIndex"),
        F.col("a.level").alias("level"), F.col("a.levelCap").alias("levelCap"), F.col("a.mindscape").alias("mindscape"), F.col("a.mindscapeCap").alias("mindscapeCap"), F.col("a.stats").alias("stats"),
        F.when(F.col("has_weapon"), F.col("a.weapon")).alias("weapon"), F.when(F.col("has_discs"), F.col("a.discs")).alias("discs"), "weaponPresent", F.col("slots").alias("discSlotOccupancy"),
        F.create_map(
            F.lit("agentId"), F.coalesce("a.agentConfidence", F.lit(STATED)),
            F.lit("level"), F.round(F.when(F.col("level_ok"), LEVEL_BASE + LEVEL_SPAN * fraction(F.col("a.level"), 1, 60)).otherwise(MISSING_LEVEL), 4),
            F.lit("mindscape"), F.round(F.when(F.col("mind_ok"), LEVEL_BASE + MINDSCAPE_SPAN * fraction(F.col("a.mindscape"), 0, 6)).otherwise(MISSING_LEVEL), 4),
            F.lit("weapon"), F.round(F.when(no_weapon, empty).when(F.col("has_weapon"), PRESENT).otherwise(ABSENT), 4),
            F.lit("discs"), F.round(F.when(no_discs, empty).when(F.col("has_discs"), PRESENT).otherwise(ABSENT), 4),
            F.lit("occupancy"), F.round(occ, 4),
        ).alias("confidenceByField"),
        F.create_map(
            F.lit("agentId"), F.lit("session_payload"), F.lit("level"), payload(F.col("a.level").isNotNull()), F.lit("levelCap"), payload(F.col("a.levelCap").isNotNull()),
            F.lit("mindscape"), payload(F.col("a.mindscape").isNotNull()), F.lit("mindscapeCap"), payload(F.col("a.mindscapeCap").isNotNull()), F.lit("stats"), payload(F.coalesce(F.size("a.stats") > 0, F.lit(False))),
            F.lit("weapon"), F.when(no_weapon, "known_empty_from_equipment_occupancy").otherwise(payload(F.col("has_weapon"))),
            F.lit("discs"), F.when(no_discs, "known_empty_from_equipment_occupancy").otherwise(payload(F.col("has_discs"))),
            F.lit("weaponPresent"), F.when(F.col("a.weaponPresent").isNotNull(), "equipment_occupancy_payload").when(F.col("has_weapon"), "derived_from_weapon_payload").otherwise("missing"),
            F.lit("discSlotOccupancy"), F.when(F.col("a.discSlotOccupancy").isNotNull(), "equipment_occupancy_payload").when(F.col("has_discs"), "derived_from_discs_payload").otherwise("missing"),
        ).alias("fieldSources"),
    )
    flags = [("weapon_missing", ~F.col("has_weapon")), ("discs_missing", ~F.col("has_discs")), ("level_missing", ~F.col("level_ok")), ("mindscape_missing", ~F.col("mind_ok"))]
    missing = F.array_compact(F.array(*[F.when(rule, F.concat_ws(".", "agentId", F.lit(name))) for name, rule in flags]))
    reasons = rows.select("sessionId", F.explode(missing).alias("reason"))
    none = sessions.select("sessionId").join(agents.select("sessionId").distinct(), "sessionId", "left_anti").select("sessionId", F.lit("agents_empty_after_parse").alias("reason"))
    return agents, nameless.union(reasons).union(none)


def filled_from(agents: DataFrame, seen: DataFrame, fields: list[str], confidence: str, source: str, guard: str | None = None, overwrite: bool = False) -> DataFrame:
    """Observed fields of (session, agent) over a record: nulls only, or all if overwrite; a differing guard field keeps the record.
    The map entry `confidence` and the sources of changed fields follow. Agents that were only seen are appended."""
    keys = ["sessionId", "agentId"]
    s = seen.select(*keys, *[F.col(f).alias(f"s_{f}") for f in fields], F.col("confidence").alias("s_conf"), F.lit(True).alias("seen"))
    both = agents.join(s, keys, "full_outer")
    clash = F.coalesce(F.col(guard) != F.col(f"s_{guard}"), F.lit(False)) if guard else F.lit(False)
    use = F.coalesce("seen", F.lit(False)) & ~clash
    changed = {}
    for f in fields:
        new = F.col(f"s_{f}").isNotNull() if overwrite else F.col(f).isNull() & F.col(f"s_{f}").isNotNull()
        changed[f] = use & new
    any_change = F.lit(False)
    for c in changed.values():
        any_change = any_change | c
    conf = F.coalesce("confidenceByField", F.create_map().cast("map<string,double>"))
    sources = F.coalesce("fieldSources", F.create_map().cast("map<string,string>"))
    patch = F.create_map(F.lit(confidence), F.round("s_conf", 4))
    told = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.when(c, F.lit(source)) for c in changed.values()])), lambda k, v: v.isNotNull())
    out = both.withColumns({f: F.when(c, F.col(f"s_{f}")).otherwise(F.col(f)) for f, c in changed.items()} | {
        "confidenceByField": F.when(any_change, F.map_zip_with(conf, patch, lambda k, a, b: F.coalesce(b, a))).otherwise(conf),
        "fieldSources": F.map_zip_with(sources, told, lambda k, a, b: F.coalesce(b, a)),
        "appended": F.coalesce("appended", F.lit(False)) | F.col("pos").isNull() if "appended" in agents.columns else F.col("pos").isNull(),
    })
    return out.drop("seen", "s_conf", *[f"s_{f}" for f in fields])


def icon_agents(icons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents in icon order, reasons) of classified icons: sessionId, pos, label, confidence, pageIndex, agentSlotIndex."""
    found = icons.where(text(F.col("label")) != "").select("sessionId", F.col("label").alias("agentId"), "pos", "confidence", "pageIndex", "agentSlotIndex")
    unsure = found.where(F.col("confidence") < ICON_LEAST).select("sessionId", F.concat(F.lit("agent_icon_low_conf:"), "agentId").alias("reason"))
    return found, unsure


#: What identifies a capture, beside what it shows.
CAPTURE = "sessionId string, pos int, agentId string, pageIndex int, agentSlotIndex int, modelId string, modelConfidence double"


def visible_slots(payload: DataFrame, icons: DataFrame) -> DataFrame:
    """sessionId, page, slot, id: who stands where on the roster. Icons overrule the payload, later entries earlier ones."""
    sides = [df.select("sessionId", F.col("pageIndex").alias("page"), F.col("agentSlotIndex").alias("slot"), F.col("agentId").alias("id"), F.struct(F.lit(k).alias("side"), "pos").alias("at")) for k, df in enumerate((payload, icons))]
    rows = sides[0].union(sides[1]).where(F.col("slot").isNotNull())
    return rows.groupBy("sessionId", "page", "slot").agg(F.max_by("id", "at").alias("id"))


def identified(captures: DataFrame, slots: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(captures with `agentId` and `identity`, its confidence; reasons): by statement, slot and model. Captures of nobody known are
    left out with a reason."""
    asks = captures.select("sessionId", "pos", F.col("pageIndex").alias("page"), F.col("agentSlotIndex").alias("slot")).where(F.col("slot").isNotNull())
    looked = fusion.slot_lookup(asks, slots, ["sessionId"], ["pos"]).select("sessionId", "pos", F.col("id").alias("slotId"))
    ident, conf = fusion.capture_identity(F.col("agentId"), F.col("slotId"), F.col("modelId"), F.col("modelConfidence"))
    named = captures.join(looked, ["sessionId", "pos"], "left").withColumn("identity", conf).withColumn("agentId", ident).drop("slotId")
    nobody = named.where(F.col("agentId").isNull()).select("sessionId", F.concat(F.lit(f"{kind}_agent_unresolved:"), F.col("pos").cast("string")).alias("reason"))
    return named.where(F.col("agentId").isNotNull()), nobody


def best_details(details: DataFrame) -> DataFrame:
    """Level and mindscape of each agent, each from the surest capture that reaches its threshold: that of the agent's slot first,
    else one that names the agent."""
    keys = ["sessionId", "agentId"]
    parts = []
    for least, fields in ((fusion.LEVEL_LEAST, ("level", "levelCap")), (fusion.MINDSCAPE_LEAST, ("mindscape", "mindscapeCap"))):
        conf = f"{fields[0]}Confidence"
        value = F.struct(F.struct(*fields).alias("value"), F.col(conf).alias("conf"))
        held = details.where(F.col(fields[0]).isNotNull())
        one = lambda df, name: fusion.best_observation(df, keys, F.col(conf), "pos").select(*keys, value.alias(name))  # noqa: B023, E731
        both = one(held.where(F.col("agentSlotIndex").isNotNull()), "by_slot").join(one(held.where(F.col("agentSlotIndex").isNull()), "by_id"), keys, "full_outer")
        taken = fusion.accepted_details(F.col("by_slot"), F.col("by_id"), least)
        sure = F.coalesce(*[F.when(F.col(f"{s}.conf") >= least, F.col(f"{s}.conf")) for s in ("by_slot", "by_id")])
        parts.append(both.select(*keys, taken.alias("t"), sure.alias(f"{fields[0]}Sure")).where(F.col("t").isNotNull()).select(*keys, "t.*", f"{fields[0]}Sure"))
    return parts[0].join(parts[1], keys, "full_outer")


def with_discs(agents: DataFrame, seen: DataFrame) -> DataFrame:
    """Discs read from pixels join the payload's in slots that these leave open, the surest reading of a slot first. The confidence is the
    greater of the readings' mean and the consensus of all sets."""
    keys = ["sessionId", "agentId"]
    filled = seen.withColumn("slot", F.col("disc.slot")).where(F.col("slot").between(1, 6))
    one = fusion.best_observation(filled, [*keys, "slot"], F.col("confidence"), "pos")
    lists = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "disc"))).alias("read"), F.avg(F.col("confidence").cast("decimal(12,6)")).cast("double").alias("read_conf"))
    both = agents.join(lists, keys, "full_outer")
    own = F.coalesce("discs", F.array().cast(discs_type()))
    new = F.filter(F.transform(F.coalesce("read", F.array().cast(f"array<struct<slot:int,disc:{discs_type()[6:-1]}>>")), lambda r: r["disc"]), lambda d: ~F.coalesce(F.array_contains(F.transform(own, lambda x: x["slot"]), d["slot"]), F.lit(False)))
    both = both.withColumn("new", new).withColumn("added", F.size("new") > 0)
    merged = F.array_sort(F.concat(own, "new"), lambda a, b: F.when(F.coalesce(a["slot"], F.lit(0)) < F.coalesce(b["slot"], F.lit(0)), -1).when(F.coalesce(a["slot"], F.lit(0)) > F.coalesce(b["slot"], F.lit(0)), 1).otherwise(0))
    both = both.withColumn("merged", F.when(F.col("added"), merged).otherwise(F.col("discs")))
    sure = F.greatest(F.col("read_conf"), fusion.consensus_of(F.transform("merged", lambda d: F.struct(d["slot"].alias("slot"), d["setId"].alias("ident")))))
    conf = F.coalesce("confidenceByField", F.create_map().cast("map<string,double>"))
    sources = F.coalesce("fieldSources", F.create_map().cast("map<string,string>"))
    patch = F.create_map(*[x for f in ("discs", "occupancy") for x in (F.lit(f), F.round(F.greatest(F.coalesce(conf[f], F.lit(0.0)), sure), 4))])
    before = F.coalesce(sources["discs"], F.lit(""))
    fresh = before.isin("", "missing")
    told = F.create_map(F.lit("discs"), F.when(fresh, "pixel_discs").otherwise("merged_session_payload_and_pixel_discs"), F.lit("discSlotOccupancy"), F.when(fresh, "derived_from_pixel_discs").otherwise("merged_session_payload_and_pixel_discs"))
    present, slots = occupancy(F.col("weapon"), F.col("merged"), F.col("weaponPresent"), F.col("discSlotOccupancy"))
    out = both.withColumns({
        "weaponPresent": F.when(F.col("added"), present).otherwise(F.col("weaponPresent")),
        "discSlotOccupancy": F.when(F.col("added"), slots).otherwise(F.col("discSlotOccupancy")),
        "confidenceByField": F.when(F.col("added"), F.map_zip_with(conf, patch, lambda k, a, b: F.coalesce(b, a))).otherwise(conf),
        "fieldSources": F.when(F.col("added"), F.map_zip_with(sources, told, lambda k, a, b: F.coalesce(b, a))).otherwise(sources),
        "appended": F.coalesce("appended", F.lit(False)) | F.col("pos").isNull(),
    })
    return out.withColumn("discs", F.col("merged")).drop("read", "read_conf", "new", "added", "merged")


def scan(sessions: DataFrame, uid: DataFrame, icons: DataFrame, details: DataFrame, weapons: DataFrame, discs: DataFrame) -> DataFrame:
    """One row per session: status, code, uid, region, confidences, agents (ordered), lowConfReasons.

    uid: sessionId, uid, confidence. icons: see icon_agents. details, weapons and discs are captures: the columns of CAPTURE,
    of which agentId is null unless it is stated, and what they show: details level, levelCap, levelConfidence, mindscape,
    mindscapeCap, mindscapeConfidence; weapons weapon, confidence; discs disc (one), confidence. Captures get their agents by
    statement, by the slot where a roster shows them, and by a model. If sessions have `lowConfReasons` of an earlier scan, they
    stay unless this one settles them.
    """
    parsed, reasons = payload_agents(sessions)
    seen, unsure = icon_agents(icons)
    merged, merge_reasons = fusion.merged_lists(parsed.select("sessionId", "agentId", "pos"), seen.select("sessionId", "agentId", "pos"), "sessionId", "agentId", "pos", "session_payload", "onnx_agent_icon")
    first = W.partitionBy("sessionId", "agentId").orderBy("pos")
    one = lambda df: df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    icon = one(seen).select("sessionId", "agentId", F.col("confidence").alias("icon_conf"), F.lit("onnx_agent_icon").alias("icon_source"))
    agents = merged.select("sessionId", "agentId", "ordinal").join(one(parsed), ["sessionId", "agentId"], "left").join(icon, ["sessionId", "agentId"], "left")
    stated = F.map_zip_with(F.coalesce("confidenceByField", F.create_map().cast("map<string,double>")), F.create_map(F.lit("agentId"), F.round("icon_conf", 4)), lambda k, a, b: F.coalesce(b, a))
    origin = F.map_zip_with(F.coalesce("fieldSources", F.create_map().cast("map<string,string>")), F.create_map(F.lit("agentId"), F.col("icon_source")), lambda k, a, b: F.coalesce(b, a))
    agents = agents.withColumns({"confidenceByField": stated, "fieldSources": origin}).drop("icon_conf", "icon_source")
    slots = visible_slots(parsed, seen)
    (details, no_detail), (weapons, no_weapon), (discs, no_disc) = (identified(c, slots, kind) for c, kind in ((details, "detail"), (weapons, "weapon"), (discs, "disc")))
    # Order of the enrichments matters: details, weapons, discs.
    read = best_details(details)
    for field, fields in (("level", ["level", "levelCap"]), ("mindscape", ["mindscape", "mindscapeCap"])):
        held = read.where(F.col(fields[0]).isNotNull()).withColumn("confidence", F.col(f"{field}Sure"))
        agents = filled_from(agents, held, fields, field, "agent_detail_pixels")
    agents = filled_from(agents, fusion.best_observation(weapons, ["sessionId", "agentId"], F.col("confidence"), "pos"), ["weapon"], "weapon", "pixel_weapon")
    agents = with_discs(agents, discs)
    state = agents.select("sessionId", F.col("agentId").alias("agent"), F.col("weapon.weaponId").alias("weapon"), F.col("weaponPresent").alias("weapon_present"), F.coalesce(F.size("discs"), F.lit(0)).alias("n_discs"), all_empty(F.col("discSlotOccupancy")).alias("slots_empty"), F.when(F.col("levelCap").isNotNull(), F.col("level")).alias("level"), F.when(F.col("mindscapeCap").isNotNull(), F.col("mindscape")).alias("mindscape"))
    raised = reasons.union(unsure).union(merge_reasons).union(no_detail).union(no_weapon).union(no_disc)
    if "lowConfReasons" in sessions.columns:
        raised = raised.union(sessions.select("sessionId", F.explode("lowConfReasons")))
    raised = raised.distinct()
    has_agents = agents.select("sessionId").distinct().withColumn("any", F.lit(True))
    raised = raised.join(has_agents, "sessionId", "left").where(~((F.col("reason") == "agents_empty_after_parse") & F.coalesce("any", F.lit(False)))).drop("any")
    still = fusion.open_reasons(raised, state, "sessionId")
    conf = lambda k: F.coalesce(F.col("confidenceByField")[k], F.lit(0.0))
    body = [c for c in agents.columns if c not in ("sessionId", "ordinal", "pos", "appended")]
    lists = agents.groupBy("sessionId").agg(
        F.round(F.avg(conf("agentId").cast("decimal(12,6)")).cast("double"), 4).alias("agents_conf"),
        F.round(F.avg(((conf("weapon") + conf("discs")) / 2).cast("decimal(12,6)")).cast("double"), 4).alias("equipment_conf"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(1 << 30)).alias("o"), F.col("agentId").alias("k"), F.to_json(F.struct(*body)).alias("agent")))).alias("agents"),
    )
    region = F.upper(F.coalesce(F.nullif(text(F.col("region")), F.lit("")), F.nullif(text(F.col("regionHint")), F.lit("")), F.lit("OTHER")))
    out = sessions.select("sessionId", "inputLockActive", "anchors", region.alias("region")).join(uid.select("sessionId", "uid", F.col("confidence").alias("uid_conf")), "sessionId", "left").join(lists, "sessionId", "left")
    metrics = out.select("sessionId", F.col("uid_conf").alias("uid"), F.col("agents_conf").alias("agents"), F.col("equipment_conf").alias("equipment"))
    still = fusion.fresh_gates(still, "sessionId", metrics)
    out = out.join(still.groupBy("sessionId").agg(F.collect_set("reason").alias("raised")), "sessionId", "left")
    gates = [F.when(text(F.col("uid")) == "", F.lit("uid_missing")), F.when(F.col("agents").isNull(), F.lit("agents_missing"))]
    gates += [F.when(F.coalesce(c, F.lit(0.0)) < least, F.lit(name)) for (name, (_, least)), c in zip(fusion.GATES.items(), ("uid_conf", "agents_conf", "equipment_conf"), strict=True)]
    low = F.array_sort(F.array_distinct(F.concat(F.coalesce("raised", F.array().cast("array<string>")), F.array_compact(F.array(*gates)))))
    anchors_ok = F.lit(True)
    for a in ANCHORS:
        anchors_ok = anchors_ok & F.coalesce(F.col("anchors")[a], F.lit(False))
    out = out.withColumn("lowConfReasons", low)
    status, code = fusion.scan_status(F.coalesce("inputLockActive", F.lit(False)), F.lit(True), anchors_ok, F.col("lowConfReasons"))
    return out.select("sessionId", status.alias("status"), code.alias("code"), text(F.col("uid")).alias("uid"), "region", F.coalesce("uid_conf", F.lit(0.0)).alias("uid_confidence"), F.when(F.col("region") != "OTHER", KNOWN_REGION).otherwise(OTHER_REGION).alias("region_confidence"), F.coalesce("agents_conf", F.lit(0.0)).alias("agents_confidence"), F.coalesce("equipment_conf", F.lit(0.0)).alias("equipment_confidence"), F.transform("agents", lambda a: a["agent"]).alias("agents"), "lowConfReasons")
