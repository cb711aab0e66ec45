"""Queries over scan sessions, review sheets, capture requests and ingested files made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions import details
from mosaiq.operators import pixels, reports, review, scan
from mosaiq.plans.common import table
from mosaiq.plans.registry import query
from mosaiq.sources import manifest, sinks

SPEC = "CASE o_orderkey % 5 WHEN 0 THEN 'roster|p' || o_orderkey || '.png' WHEN 1 THEN 'disk_detail | d.png | a' || o_custkey || ' | ' || (o_orderkey % 6 + 1) || ' | 2 | x | 1' WHEN 2 THEN '|p.png' WHEN 3 THEN 'equipment|e.png||x1' ELSE 'uid_panel|u.png||||alias|9z' END"


@query(f"""
WITH s AS (SELECT o_orderkey AS k, {SPEC} AS spec FROM orders), p AS (SELECT k, list_transform(string_split(spec, '|'), lambda x: trim(x)) AS p FROM s),
c AS (SELECT k, nullif(p[1], '') AS role, nullif(p[2], '') AS path, nullif(p[3], '') AS agentId, nullif(p[4], '') AS s4, nullif(p[5], '') AS s5, nullif(p[6], '') AS screenAlias, nullif(p[7], '') AS s7 FROM p)
SELECT k, role, path, agentId, try_cast(s4 AS INT) AS slotIndex, try_cast(s5 AS INT) AS agentSlotIndex, screenAlias, try_cast(s7 AS INT) AS pageIndex,
  concat_ws(';', CASE WHEN role IS NULL OR path IS NULL THEN 'role_and_path_required' END, CASE WHEN s4 IS NOT NULL AND try_cast(s4 AS INT) IS NULL THEN 'slotIndex_not_integer' END,
    CASE WHEN s5 IS NOT NULL AND try_cast(s5 AS INT) IS NULL THEN 'agentSlotIndex_not_integer' END, CASE WHEN s7 IS NOT NULL AND try_cast(s7 AS INT) IS NULL THEN 'pageIndex_not_integer' END) AS errors FROM c""")
def capture_specs(spark, sf):
    """Capture requests in one text each; what is wrong with them is told."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), manifest.parse_capture_spec(F.expr(SPEC)).alias("c")).select("k", "c.*")


SQL_SETS = {"brand#1": "set_1", "brand#2": "set_2", "brand#3": "set_3"}
DISC = "CASE l_linenumber % 4 WHEN 0 THEN 'hp_pct' WHEN 1 THEN ' crit_rate_pct ' WHEN 2 THEN 'luck' ELSE NULL END"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'uid_panel' WHEN l_linenumber = 2 THEN 'combat' ELSE 'disk_detail' END AS role,
  CASE WHEN l_orderkey % 3 = 0 THEN 'UID ' || l_partkey ELSE (1000000000 + l_orderkey)::VARCHAR END AS uid, l_linenumber AS slot, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE (l_partkey % 18)::VARCHAR END AS cur, '15' AS cap,
  {DISC} AS stat, CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' ELSE l_tax * 100 || ' %' END AS val FROM lineitem),
v AS (SELECT *, regexp_replace(uid, '[^0-9]', '', 'g') AS d, try_cast(cur AS INT) AS c, trim(stat) IN ('hp_pct', 'crit_rate_pct') AS ok, try_cast(replace(replace(val, '%', ''), ' ', '') AS DOUBLE) AS n FROM r),
e AS (SELECT *, CASE role WHEN 'uid_panel' THEN concat_ws(';', CASE WHEN length(d) = 0 THEN 'uid_full_required' END, CASE WHEN length(d) > 0 AND length(d) NOT BETWEEN 6 AND 12 THEN 'uid_full_must_have_6_to_12_digits' END)
  WHEN 'disk_detail' THEN concat_ws(';', CASE WHEN slot NOT BETWEEN 1 AND 6 THEN 'disc_slot_must_be_1_to_6' END, CASE WHEN c IS NULL THEN 'disc_level_pair_incomplete' END, CASE WHEN c > 15 THEN 'disc_level_current_above_max' END,
    CASE WHEN NOT coalesce(ok, false) THEN 'invalid_disc_main_stat_key' END, CASE WHEN n IS NULL THEN 'disc_main_stat_value_must_be_numeric' END) ELSE '' END AS errors FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN role = 'uid_panel' AND length(d) BETWEEN 6 AND 12 THEN d END AS uid, CASE WHEN role = 'disk_detail' AND slot BETWEEN 1 AND 6 THEN slot::INT END AS slot,
  CASE WHEN role = 'disk_detail' THEN c END AS level, CASE WHEN role = 'disk_detail' AND ok THEN trim(stat) END AS stat, errors, CASE WHEN errors = '' THEN 'reviewed' ELSE 'needs_review' END AS status FROM e""")
def review_labels(spark, sf):
    """A review sheet with a form per role: valid rows become labels, others keep their errors."""
    order = F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "uid_panel").when(F.col("l_linenumber") == 2, "combat").otherwise("disk_detail").alias("role"),
        F.when(order % 3 == 0, F.concat(F.lit("UID "), F.col("l_partkey").cast("string"))).otherwise((order + 1000000000).cast("string")).alias("raw_uid"), F.col("l_linenumber").cast("string").alias("raw_slot"),
        F.when(order % 4 != 0, (F.col("l_partkey") % 18).cast("string")).alias("cur"), F.lit("15").alias("cap"), F.expr(DISC).alias("raw_stat"), F.when(order % 7 == 0, "n/a").otherwise(F.concat((F.col("l_tax") * 100).cast("string"), F.lit(" %"))).alias("val"),
    )
    current, cap = review.level_pair(F.col("cur"), F.col("cap"), "disc_level")
    forms = {
        "uid_panel": {"uid_full": review.uid(F.col("raw_uid"))},
        "disk_detail": {"slot": review.whole(F.col("raw_slot"), "disc_slot", 1, 6), "level": current, "cap": cap, "stat": review.stat_key(F.col("raw_stat"), "disc_main_stat_key"), "value": review.value(F.col("val"), "disc_main_stat_value")},
    }
    out = review.labelled(rows, F.col("role"), forms)
    return out.select("l_orderkey", "l_linenumber", F.col("uid_panel.uid_full").alias("uid"), F.col("disk_detail.slot").alias("slot"), F.col("disk_detail.level").alias("level"), F.col("disk_detail.stat").alias("stat"), "errors", "status")


def sessions(spark, sf):
    """A session per customer; its orders are the agents that the payload lists."""
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    key = F.col("o_orderkey")
    agent = F.struct(
        F.concat(F.lit("a"), key.cast("string")).alias("agentId"), F.when(key % 3 != 0, (key % 60 + 1).cast("double")).alias("level"), F.lit(60.0).alias("levelCap"), F.when(key % 5 != 0, (key % 7).cast("double")).alias("mindscape"),
        F.lit(6.0).alias("mindscapeCap"), F.lit(None).cast("map<string,double>").alias("stats"),
        F.when(price > 200000, F.struct(F.col("o_orderpriority").alias("weaponId"), F.lit(None).cast("string").alias("displayName"), F.lit(None).cast("double").alias("level"))).alias("weapon"),
        F.when(price > 300000, F.array(F.struct(F.lit(1).alias("slot"), F.col("o_orderstatus").alias("setId"), F.lit(None).cast("string").alias("displayName"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("double").alias("levelCap")))).alias("discs"),
        F.when(key % 2 == 0, price > 250000).alias("weaponPresent"), F.lit(None).cast("map<string,boolean>").alias("discSlotOccupancy"), F.lit(None).cast("double").alias("agentConfidence"), F.lit(None).cast("int").alias("pageIndex"), F.lit(None).cast("int").alias("agentSlotIndex"),
    )
    lists = o.groupBy(F.col("o_custkey").cast("string").alias("sessionId")).agg(F.array_sort(F.collect_list(agent.alias("x")), lambda a, b: F.when(a["agentId"] < b["agentId"], -1).when(a["agentId"] > b["agentId"], 1).otherwise(0)).alias("agents"))
    crop = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.lit(None).cast("string").alias("screenRole"), F.concat(F.col("sessionId"), F.lit(".png")).alias("path"), *[F.lit(None).cast("string").alias(n) for n in ("agentId", "focusAgentId")], F.lit(None).cast("int").alias("slotIndex"), F.lit(2).alias("agentSlotIndex"), *[F.lit(None).cast("string").alias(n) for n in ("screenAlias", "alias")], (F.col("sessionId").cast("int") % 3).alias("pageIndex")))
    return lists.select("sessionId", (F.col("sessionId").cast("int") % 10 != 0).alias("inputLockActive"), F.lit("eu").alias("regionHint"), F.lit(None).cast("string").alias("region"), F.create_map(*[x for a in scan.ANCHORS for x in (F.lit(a), F.lit(True))]).alias("anchors"), F.when(F.col("sessionId").cast("int") % 2 == 0, F.concat(F.lit("u"), F.col("sessionId"))).alias("uidImagePath"), crop("icon").alias("agentIconPaths"), crop("roster").alias("screenCaptures"), "agents", F.lit(None).cast("boolean").alias("fullRosterCoverage"))


@query("""
WITH o AS (SELECT o_custkey::VARCHAR AS session, 'a' || o_orderkey AS agent, o_orderkey AS k, o_totalprice > 200000 AS w, o_totalprice > 300000 AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice > 250000 END AS stated, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 60 + 1 END AS level FROM orders)
SELECT session, agent, round(CASE WHEN level IS NULL THEN 0.24 ELSE 0.88 + 0.12 * least(1, greatest(0, (level - 1) / 59.0)) END::DOUBLE, 4) AS level_conf,
  CASE WHEN NOT w AND stated IS NOT NULL AND NOT stated THEN 0.9 WHEN w THEN 0.9 ELSE 0.22 END::DOUBLE AS weapon_conf, CASE WHEN d THEN 0.9 ELSE 0.22 END::DOUBLE AS discs_conf,
  CASE WHEN NOT w AND stated IS NOT NULL AND NOT stated THEN 'known_empty_from_equipment_occupancy' WHEN w THEN 'session_payload' ELSE 'missing' END AS weapon_source, coalesce(stated, w) AS present FROM o""")
def payload_confidence(spark, sf):
    """Confidence and provenance per field of what a session's payload lists."""
    agents, _ = scan.payload_agents(sessions(spark, sf))
    c, s = F.col("confidenceByField"), F.col("fieldSources")
    return agents.select(F.col("sessionId").alias("session"), F.col("agentId").alias("agent"), c["level"].alias("level_conf"), c["weapon"].alias("weapon_conf"), c["discs"].alias("discs_conf"), s["weapon"].alias("weapon_source"), F.col("weaponPresent").alias("present"))


@query("""
WITH u AS (SELECT DISTINCT o_custkey AS c FROM orders)
SELECT c::VARCHAR AS session, 'roster' AS role, 'roster_0' AS alias, CASE WHEN c % 3 IS NOT NULL THEN c % 3 * 3 + 2 END::INT AS slot FROM u
UNION ALL SELECT c::VARCHAR, 'uid_panel', 'legacy_uid_crop', NULL FROM u WHERE c % 2 = 0
UNION ALL SELECT c::VARCHAR, 'agent_icon_crop', 'legacy_agent_icon_1', 2 FROM u""")
def session_captures(spark, sf):
    """All captures of a session as rows: screens, uid crop, icons."""
    return manifest.captures(sessions(spark, sf)).select(F.col("sessionId").alias("session"), "role", "alias", F.col("agentSlotIndex").alias("slot"))


def shown(rows, pos, shows, stated=None, page=None, slot=None, model=None, sure=None):
    """Captures out of orders: who they show, by statement, slot or model, and what."""
    empty = {"agentId": "string", "pageIndex": "int", "agentSlotIndex": "int", "modelId": "string", "modelConfidence": "double"}
    given = dict(zip(empty, (stated, page, slot, model, sure), strict=True))
    return rows.select(F.col("o_custkey").cast("string").alias("sessionId"), pos.cast("int").alias("pos"), *[(F.lit(None) if given[n] is None else given[n]).cast(t).alias(n) for n, t in empty.items()], *shows)


@query("""
WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, 'a' || o_orderkey AS a, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
i AS (SELECT * FROM o WHERE k % 2 = 1),
m AS (SELECT *, k % 2 = 1 AS icon FROM o),
-- details: stated for every third order, by slot for icons of even rank, by a model that contradicts the slot for every seventh
dl AS (SELECT s, a, 0.8 + (k % 5) / 50.0 AS c, 0.4 + (k % 5) / 20.0 AS mc, false AS by_slot FROM o WHERE k % 3 = 0
  UNION ALL SELECT s, a, 0.7 + (k % 4) / 10.0, 0.6, true FROM i WHERE n % 2 = 0 AND k % 7 <> 0),
lost AS (SELECT s, 'detail_agent_unresolved:' || (k + 1000000) AS reason FROM i WHERE n % 2 = 0 AND k % 7 = 0),
lv AS (SELECT s, a, max(c) FILTER (by_slot AND c >= 0.78) AS sl, max(c) FILTER (NOT by_slot AND c >= 0.78) AS st, max(mc) FILTER (by_slot AND mc >= 0.5) AS ml, max(mc) FILTER (NOT by_slot AND mc >= 0.5) AS mt FROM dl GROUP BY 1, 2),
f AS (SELECT m.*, p > 200000 AS w, p > 300000 AS d, CASE WHEN k % 2 = 0 THEN p > 250000 END AS stated, CASE WHEN k % 3 <> 0 THEN k % 60 + 1 END AS level0, CASE WHEN k % 5 <> 0 THEN k % 7 END AS mind0, coalesce(lv.sl, lv.st) AS lc, coalesce(lv.ml, lv.mt) AS mc FROM m LEFT JOIN lv USING (s, a)),
-- weapons are seen below 200000 or more; six discs of one set where the price is below 300000 and the key divisible by 4, one where only below
g AS (SELECT *, NOT w AND p < 200000 AS seen_w, CASE WHEN p < 300000 THEN CASE WHEN k % 4 = 0 THEN 6 ELSE 1 END ELSE 0 END AS read,
  CASE WHEN icon THEN 0.95 ELSE 0.99 END AS id_conf, level0 IS NOT NULL OR lc IS NOT NULL AS has_level, mind0 IS NOT NULL OR mc IS NOT NULL AS has_mind FROM f),
h AS (SELECT *, CASE WHEN NOT w AND stated IS NOT NULL AND NOT stated THEN 0.9 WHEN w THEN 0.9 ELSE 0.22 END AS wc0, CASE WHEN d THEN 0.9 ELSE 0.22 END AS dc0 FROM g),
c AS (SELECT *, CASE WHEN seen_w THEN 0.96 ELSE wc0 END AS wc, CASE WHEN read = 6 THEN greatest(dc0, 0.92) WHEN read = 1 AND NOT d THEN greatest(dc0, 0.7) ELSE dc0 END AS dc FROM h),
mt AS (SELECT s, round(avg(id_conf::DECIMAL(12, 6))::DOUBLE, 4) AS agents_confidence, round(avg(((wc + dc) / 2)::DECIMAL(12, 6))::DOUBLE, 4) AS equipment_confidence, count(*)::INT AS n_agents, count(*) FILTER (icon) AS icons FROM c GROUP BY 1),
r AS (
  SELECT s, a || '.weapon_missing' AS reason FROM c WHERE NOT w AND NOT seen_w AND coalesce(stated, w) 
  UNION ALL SELECT s, a || '.level_missing' FROM c WHERE NOT has_level UNION ALL SELECT s, a || '.mindscape_missing' FROM c WHERE NOT has_mind
  UNION ALL SELECT s, 'agent_payload_not_visible_in_roster:' || a FROM c JOIN mt USING (s) WHERE NOT icon AND icons > 0
  UNION ALL SELECT s, reason FROM lost
  UNION ALL SELECT s, 'uid_missing' FROM mt WHERE s % 4 = 0 UNION ALL SELECT s, 'uid_low_confidence' FROM mt WHERE s % 4 = 0
  UNION ALL SELECT s, 'agents_low_confidence' FROM mt WHERE agents_confidence < 0.9 UNION ALL SELECT s, 'equipment_low_confidence' FROM mt WHERE equipment_confidence < 0.85),
l AS (SELECT s, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM r GROUP BY 1)
SELECT s::VARCHAR AS "sessionId", CASE WHEN s % 10 = 0 THEN 'error' WHEN reasons IS NOT NULL THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN s % 10 = 0 THEN 'INPUT_LOCK_NOT_ACTIVE' WHEN reasons IS NOT NULL THEN 'LOW_CONFIDENCE' END AS code,
  CASE WHEN s % 4 <> 0 THEN lpad(s::VARCHAR, 10, '1') ELSE '' END AS uid, agents_confidence, equipment_confidence, n_agents, coalesce(reasons, '') AS reasons FROM mt LEFT JOIN l USING (s)""")
def strict_scan(spark, sf):
    """The whole fusion over all sessions at once: gates, merge, captures named by statement, slot and model, enrichments, reasons."""
    s, o = sessions(spark, sf), table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    ident = F.concat(F.lit("a"), key.cast("string"))
    # An agent's slot is its place in the session's list.
    o = o.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int"))
    uid = s.select("sessionId", F.lpad("sessionId", 10, "1").alias("uid"), F.lit(0.97).alias("confidence")).where(F.col("sessionId").cast("int") % 4 != 0)
    icons = o.where(key % 2 == 1).select(F.col("o_custkey").cast("string").alias("sessionId"), F.col("n").alias("pos"), ident.alias("label"), F.lit(0.95).alias("confidence"), F.lit(0).alias("pageIndex"), F.col("n").alias("agentSlotIndex"))
    reading = lambda level, mind: [F.lit(40.0).alias("level"), F.lit(60.0).alias("levelCap"), level.cast("double").alias("levelConfidence"), F.lit(2.0).alias("mindscape"), F.lit(6.0).alias("mindscapeCap"), mind.cast("double").alias("mindscapeConfidence")]
    stated = shown(o.where(key % 3 == 0), key, reading(0.8 + (key % 5) / 50, 0.4 + (key % 5) / 20), stated=ident)
    odd = F.when(key % 7 == 0, "stranger")
    placed = shown(o.where((key % 2 == 1) & (F.col("n") % 2 == 0)), key + 1_000_000, reading(0.7 + (key % 4) / 10, F.lit(0.6)), page=F.lit(0), slot=F.col("n"), model=odd, sure=F.lit(0.5))
    weapon = F.struct(F.lit("w").alias("weaponId"), F.lit("W").alias("displayName"), F.lit(60.0).alias("level"))
    weapons = shown(o.where(price < 200000), key, [weapon.alias("weapon"), F.lit(0.96).alias("confidence")], stated=ident)
    disc = F.struct(F.col("slot").cast("int").alias("slot"), F.lit("x").alias("setId"), F.lit("X").alias("displayName"), F.lit(15.0).alias("level"), F.lit(15.0).alias("levelCap"))
    read = o.where(price < 300000).withColumn("slot", F.explode(F.when(key % 4 == 0, F.sequence(F.lit(1), F.lit(6))).otherwise(F.array(F.lit(1)))))
    discs = shown(read, key * 10 + F.col("slot"), [disc.alias("disc"), F.lit(0.7).alias("confidence")], stated=ident)
    out = scan.scan(s, uid, icons, stated.unionByName(placed), weapons, discs)
    return out.select("sessionId", "status", "code", "uid", "agents_confidence", "equipment_confidence", F.size("agents").alias("n_agents"), F.array_join("lowConfReasons", ";").alias("reasons"))


@query("""
SELECT p_partkey, list_aggregate(list_transform(string_split(regexp_replace(p_name, '^new ', ''), ' '), lambda w: upper(w[1]) || substr(w, 2)), 'string_agg', ' ') AS title, (p_size % 6 * 10 + 10)::INT AS level, 60 AS level_cap,
  'attack_flat' AS base_key, (p_size * 10 + 100)::DOUBLE AS base_value, 'crit_rate_pct' AS advanced_key, (p_size % 30 + 1)::DOUBLE AS advanced_value FROM part""")
def item_cards(spark, sf):
    """Titles, levels and statistics out of recognised card texts; a badge before the title is none of it."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" Lv. "), (F.col("p_size") % 6 * 10 + 10).cast("string"), F.lit("/60")).alias("t"), F.concat(F.lit("Base Stats Base ATK Advanced Stats Crit Rate W-Engine Effect "), (F.col("p_size") * 10 + 100).cast("string"), F.lit(" "), (F.col("p_size") % 30 + 1).cast("string"), F.lit("%")).alias("i"))
    blank = F.lit(None).cast("string")
    return rows.select("p_partkey", details.card("t", "i", blank, blank, blank).alias("c")).select("p_partkey", "c.*")


@query("""
WITH l AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '20240115' WHEN 1 THEN '' ELSE '20220101' END || '|' || page_id || '|' || url AS line FROM pages),
p AS (SELECT page_id, split_part(line, '|', 1) AS date, split_part(line, '|', 2) AS id, substr(line, length(split_part(line, '|', 1)) + length(split_part(line, '|', 2)) + 3) AS title FROM l)
SELECT page_id % 20 AS grp, min(id::BIGINT) AS first_hit FROM p WHERE date >= '20230101' AND title NOT LIKE '%example.net%' GROUP BY 1""")
def search_hits(spark, sf):
    """First acceptable hit per search: recent enough, not seen before; a blank date never is."""
    line = F.concat(F.when(F.col("page_id") % 3 == 0, "20240115").when(F.col("page_id") % 3 == 1, "").otherwise("20220101"), F.lit("|"), F.col("page_id").cast("string"), F.lit("|"), F.col("url"))
    pages = table(spark, sf, "pages")
    hits = pages.select(manifest.parse_search_line(line).alias("h")).select("h.*")
    seen = pages.where(F.contains("url", F.lit("example.net"))).select(F.col("url").alias("title")).distinct()
    good = hits.where("date >= '20230101'").join(seen, "title", "left_anti")
    return good.groupBy((F.col("id").cast("long") % 20).alias("grp")).agg(F.min(F.col("id").cast("long")).alias("first_hit"))


@query("""
WITH x AS (SELECT DISTINCT o_custkey AS k, (o_orderkey % 27)::INT AS n FROM orders)
SELECT k, string_agg(CASE WHEN n < 25 THEN n::VARCHAR END, ',' ORDER BY n) AS owned, count(DISTINCT CASE WHEN n < 25 THEN n END)::INT AS n_owned, (25 - count(DISTINCT CASE WHEN n < 25 THEN n END))::INT AS n_missing,
  coalesce(string_agg(CASE WHEN n >= 25 THEN n::VARCHAR END, ';' ORDER BY n::VARCHAR), '') AS unknown FROM x GROUP BY k""")
def owned_roster(spark, sf):
    """Owned and missing entries of a roster per session, in roster order; unknown ids are told."""
    roster = reports.roster_array(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("agent"), F.col("n_nationkey").alias("ordinal")), "agent", "ordinal")
    owned = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 27).cast("string").alias("agent"))
    out = review.owned_lists(owned, "k", "agent", roster)
    return out.select("k", F.nullif(F.array_join("owned", ","), F.lit("")).alias("owned"), F.size("owned").alias("n_owned"), F.size("not_owned").alias("n_missing"), "unknown")


@query("""
WITH r AS (SELECT page_id, lower(url) AS u, url AS path, sha256(url) AS sha256 FROM pages),
c AS (SELECT *, CASE WHEN regexp_matches(u, '\\buid\\b|profile') THEN 'uid_panel' WHEN regexp_matches(u, 'roster|agent_menu|agents_menu') THEN 'roster' WHEN regexp_matches(u, 'mindscape|cinema|\\bmind\\b') THEN 'mindscape' WHEN regexp_matches(u, 'amplificator|amplifier|w_engine|wengine') THEN 'amplifier_detail'
  WHEN regexp_matches(u, '\\bdis[ck][_\\-\\s]*[1-6]\\b') THEN 'disk_detail' WHEN regexp_matches(u, 'agent_detail|characteristics|stats') THEN 'agent_detail' WHEN regexp_matches(u, '\\bequipment\\b|loadout|gear') THEN 'equipment' END AS role
  FROM (SELECT page_id, sha256(path) AS sha256, path, lower(path) AS u FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'roster/' WHEN 1 THEN 'x/Disc 3/' WHEN 2 THEN 'ru/gear/' ELSE 'misc/' END || page_id % 50 || '.png' AS path FROM pages)))
SELECT DISTINCT 'b_' || role || '_' || substr(sha256, 1, 12) || '_record' AS id, role, path, CASE WHEN path LIKE 'ru/%' THEN 'RU' ELSE 'UNKNOWN' END AS locale, '1440p' AS resolution FROM c WHERE role IS NOT NULL AND page_id % 50 <> 8""")
def ingest_batch(spark, sf):
    """New files by hash become records with role, locale and id; known hashes and unclassified paths don't."""
    folder = F.when(F.col("page_id") % 4 == 0, "roster/").when(F.col("page_id") % 4 == 1, "x/Disc 3/").when(F.col("page_id") % 4 == 2, "ru/gear/").otherwise("misc/")
    files = table(spark, sf, "pages").select("page_id", F.concat(folder, (F.col("page_id") % 50).cast("string"), F.lit(".png")).alias("path")).withColumn("sha256", F.sha2("path", 256))
    known = files.where("page_id % 50 = 8").select("sha256").distinct()
    sizes = files.select("path", F.lit(2560).alias("width"), F.lit(1440).alias("height")).distinct()
    return manifest.ingested(files.select("path", "sha256"), sizes, "b", known)[0].select("id", "role", "path", "locale", "resolution")


@query("""SELECT doc_id::VARCHAR AS record_id, coalesce(quality::VARCHAR, '') AS quality, lang, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, '') AS flag FROM documents LEFT JOIN labels USING (doc_id)""")
def review_sheet(spark, sf):
    """Cells of a review sheet: text in a fixed order, blank for null."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return sinks.sheet(rows, {"record_id": F.col("doc_id"), "quality": F.col("quality"), "lang": F.col("lang"), "flag": F.when(F.col("toxic") == 1, "toxic")})


@query("""SELECT vec_id, list_aggregate(list_transform(embedding[1:8], lambda x: CASE WHEN x > 0.5 THEN '1' ELSE '0' END), 'string_agg', '') AS first_row, 64 AS n FROM embeddings""")
def glyph_rows(spark, sf):
    """Glyphs as rows of 0 and 1, and back."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    rows = table(spark, sf, "embeddings").select("vec_id", sinks.glyph_rows(grid).alias("g"))
    return rows.select("vec_id", F.col("g")[0].alias("first_row"), F.size(sinks.glyph_levels(F.col("g"))).alias("n"))


@query()
def slot_textures(spark, sf):
    """Whether patches of an image are filled, by their texture; null where that is ambiguous."""
    from mosaiq.operators import fusion

    rows = table(spark, sf, "embeddings").select("vec_id", pixels.drawn("embedding").alias("image"))
    patch = pixels.cropped(0.0, 0.0, 0.5, 0.5)
    rows = rows.select("vec_id", patch("image").alias("patch"))
    return rows.select("vec_id", F.round(pixels.texture_score("patch"), 6).alias("score")).withColumn("present", fusion.presence(F.col("score")))


