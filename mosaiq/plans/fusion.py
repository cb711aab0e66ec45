"""Fusion queries: captures, slots and partial observations from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import fusion as X
from mosaiq.plans.common import table
from mosaiq.plans.registry import query

@query("""
WITH l AS (SELECT l_orderkey AS session, l_linenumber AS ask, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (l_suppkey % 3)::INT END AS page, (l_partkey % 4 + 1)::INT AS slot, CASE WHEN l_partkey % 6 <> 5 THEN l_returnflag || l_partkey % 6 ELSE '' END AS id,
  CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE (l_suppkey % 3)::INT END AS asked, (l_suppkey % 4 + 1)::INT AS at FROM lineitem),
m AS (SELECT a.session, a.ask, a.asked AS want, a.at AS slot, nullif(k.id, '') AS id, CASE WHEN k.page IS NOT DISTINCT FROM a.asked THEN 1 WHEN k.page IS NULL THEN 2 WHEN a.asked IS NULL THEN 3 END AS rank FROM l a LEFT JOIN l k ON a.session = k.session AND a.at = k.slot),
b AS (SELECT session, ask, want, slot, max(CASE WHEN rank = 1 THEN id END) AS f, max(CASE WHEN rank = 2 THEN id END) AS s,
  CASE WHEN count(DISTINCT CASE WHEN rank IS NOT NULL THEN id END) = 1 THEN max(CASE WHEN rank IS NOT NULL THEN id END) END AS t FROM m GROUP BY 1, 2, 3, 4)
SELECT session, ask, want AS page, slot, coalesce(f, s, t, '') AS id FROM b""")
def slot_fallback_join(spark, sf):
    """Exact page, then no page, then the only candidate; each order is a session of its own."""
    l = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "session")  # noqa: E741
    part, page = F.col("l_partkey"), (F.col("l_suppkey") % 3).cast("int")
    ident = F.when(part % 6 != 5, F.concat("l_returnflag", (part % 6).cast("string"))).otherwise("")
    known = l.select("session", F.when(F.col("l_linenumber") % 3 != 0, page).alias("page"), (part % 4 + 1).cast("int").alias("slot"), ident.alias("id"))
    asks = l.select("session", F.col("l_linenumber").alias("ask"), F.when(F.col("l_quantity") % 5 != 0, page).alias("page"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("slot"))
    return X.slot_lookup(asks, known, ["session"], ["ask"])


SQL_LISTS = """
p0 AS (SELECT o_custkey AS k, 'agent' || o_orderkey % 9 AS ident, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 0),
i0 AS (SELECT o_custkey AS k, 'agent' || o_orderkey % 9 AS ident, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 = 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY k, ident ORDER BY pos) AS rn FROM p0), ir AS (SELECT *, row_number() OVER (PARTITION BY k, ident ORDER BY pos) AS rn FROM i0),
b AS (SELECT k, ident, i.pos AS icon_pos, p.pos AS payload_pos FROM (SELECT * FROM ir WHERE rn = 1) i FULL OUTER JOIN (SELECT * FROM pr WHERE rn = 1) p USING (k, ident)),
c AS (SELECT *, count(icon_pos) OVER (PARTITION BY k) AS icons, count(payload_pos) OVER (PARTITION BY k) AS payloads FROM b)"""


def lists(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("agent"), (F.col("o_orderkey") % 9).cast("string")).alias("ident"), F.col("o_orderkey").alias("pos"))
    return X.merged_lists(o.where("pos % 2 = 0"), o.where("pos % 3 = 0"), "k", "ident", "pos", "session_payload", "onnx_agent_icon")


@query(f"""WITH {SQL_LISTS}
SELECT k, ident, icon_pos, payload_pos, row_number() OVER (PARTITION BY k ORDER BY icon_pos NULLS LAST, payload_pos NULLS LAST)::INT AS ordinal FROM c""")
def full_outer_merge(spark, sf):
    return lists(spark, sf)[0]


@query(f"""WITH {SQL_LISTS}
SELECT k, reason, count(*)::BIGINT AS n FROM (
  SELECT k, 'duplicate_agent_id_from_session_payload:' || ident AS reason FROM pr WHERE rn > 1 UNION ALL SELECT k, 'duplicate_agent_id_from_onnx_agent_icon:' || ident FROM ir WHERE rn > 1
  UNION ALL SELECT k, 'agent_icon_without_payload:' || ident FROM c WHERE payload_pos IS NULL AND payloads > 0
  UNION ALL SELECT k, 'agent_payload_not_visible_in_roster:' || ident FROM c WHERE icon_pos IS NULL AND icons > 0) GROUP BY ALL""")
def merge_reasons(spark, sf):
    return lists(spark, sf)[1].groupBy("k", "reason").agg(F.count("*").alias("n"))


SQL_AGENTS = """
a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS weapon, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS level FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS weapon, c_acctbal + 1 AS level FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"""WITH {SQL_AGENTS}, x AS (SELECT id, a.weapon AS aw, s.weapon AS sw, a.level AS al, s.level AS sl, coalesce(a.weapon <> s.weapon, false) AS clash FROM a FULL OUTER JOIN s USING (id))
SELECT id, CASE WHEN clash THEN aw ELSE coalesce(aw, sw) END AS weapon, CASE WHEN clash THEN al ELSE coalesce(al, sl) END AS level,
  CASE WHEN NOT clash AND al IS NULL AND sl IS NOT NULL THEN 'seen' WHEN al IS NOT NULL THEN 'own' END AS level_source FROM x""")
def fill_nulls_enrich(spark, sf):
    """Observed fields fill what is missing, unless the identities contradict."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    a = c.where("id % 5 <> 0").select("id", F.when(F.col("id") % 4 != 0, F.col("c_mktsegment")).alias("weapon"), F.when(F.col("id") % 3 != 0, F.col("c_acctbal")).alias("level"))
    s = c.where("id % 2 = 0").select("id", F.when(F.col("id") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("weapon"), (F.col("c_acctbal") + 1).alias("level"))
    return X.enriched(a, s, ["id"], "weapon", ["level"])


@query("""
WITH one AS (SELECT l_orderkey AS k, (l_linenumber - 1) % 6 + 1 AS slot, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS ident FROM lineitem GROUP BY 1, 2),
c AS (SELECT k, ident, count(*) AS n FROM one GROUP BY 1, 2), s AS (SELECT k, sum(n) AS total, max(n) AS top, count(*) AS u, min(n) AS low FROM c GROUP BY 1)
SELECT k, CASE WHEN total <> 6 THEN 0.0 WHEN top = 6 THEN 0.92 WHEN top >= 5 THEN 0.88 WHEN top = 4 AND u <= 2 THEN 0.86 WHEN top = 4 AND u = 3 THEN 0.80 WHEN u IN (2, 3) AND top = low THEN 0.80 ELSE 0.0 END::DOUBLE AS confidence FROM s""")
def consensus_confidence(spark, sf):
    """Seven readings of six slots: the seventh overrules the first."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), ((F.col("l_linenumber") - 1) % 6 + 1).alias("slot"), F.col("l_returnflag").alias("ident"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("pos"))
    return X.consensus(rows, "k", "slot", "ident", "pos")


@query("""
SELECT user_id, hour, min(event_type) AS label, min(value) AS confidence FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H') AS hour FROM events) GROUP BY user_id, hour HAVING count(*) >= 2 AND count(DISTINCT event_type) = 1 AND min(value) >= 3""")
def agreement_filter(spark, sf):
    """Observations of one hour that all agree."""
    rows = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), "event_type", "value")
    return X.agreement(rows, ["user_id", "hour"], "event_type", "value", 3.0)


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS k, 'a' || o_orderkey % 5 AS agent, list_extract(['weapon', 'discs', 'level', 'mindscape', 'other'], (o_orderkey % 5 + 1)::INT) AS what FROM orders),
g AS (SELECT o_custkey AS k, 'a' || o_orderkey % 5 AS agent, max(CASE WHEN o_totalprice > 250000 THEN o_orderpriority END) AS weapon, bool_or(o_orderstatus = 'F') AS weapon_present, sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS n_discs,
  bool_and(o_orderstatus = 'O') AS slots_empty, max(CASE WHEN o_totalprice < 100000 THEN 1 END) AS level, max(CASE WHEN o_totalprice < 50000 THEN 1 END) AS mindscape FROM orders GROUP BY 1, 2)
SELECT k, agent || '.' || what || '_missing' AS reason FROM r JOIN g USING (k, agent)
WHERE NOT coalesce((what = 'weapon' AND (weapon IS NOT NULL OR NOT coalesce(weapon_present, true))) OR (what = 'discs' AND (n_discs > 0 OR coalesce(slots_empty, false))) OR (what = 'level' AND level IS NOT NULL) OR (what = 'mindscape' AND mindscape IS NOT NULL), false)""")
def reason_resolution(spark, sf):
    """Reasons that the fused state has settled are dropped."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey")).withColumn("agent", F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")))
    what = F.element_at(F.array(*[F.lit(x) for x in ("weapon", "discs", "level", "mindscape", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    reasons = o.select("k", F.concat("agent", F.lit("."), what, F.lit("_missing")).alias("reason")).distinct()
    price = F.col("o_totalprice")
    agents = o.groupBy("k", "agent").agg(
        F.max(F.when(price > 250000, F.col("o_orderpriority"))).alias("weapon"), F.bool_or(F.col("o_orderstatus") == "F").alias("weapon_present"), F.sum(F.when(price > 300000, 1).otherwise(0)).alias("n_discs"),
        F.bool_and(F.col("o_orderstatus") == "O").alias("slots_empty"), F.max(F.when(price < 100000, 1)).alias("level"), F.max(F.when(price < 50000, 1)).alias("mindscape"),
    )
    return X.open_reasons(reasons, agents, "k")


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'stated' END AS e, CASE WHEN event_id % 3 <> 0 THEN 's' || user_id % 3 END AS s, CASE WHEN event_id % 5 <> 0 THEN 's' || event_id % 3 END AS m, round(least(value / 100, 1), 4) AS c FROM events)
SELECT event_id, coalesce(CASE WHEN e IS NOT NULL THEN e WHEN s IS NOT NULL AND m IS NOT NULL AND s <> m THEN CASE WHEN c >= 0.88 THEN m END ELSE coalesce(s, m) END, '') AS ident,
  CASE WHEN e IS NOT NULL THEN 0.99 WHEN s IS NOT NULL AND m IS NOT NULL AND s <> m THEN CASE WHEN c >= 0.88 THEN c ELSE 0.0 END WHEN s IS NOT NULL AND m IS NOT NULL THEN greatest(0.97, c) WHEN s IS NOT NULL THEN 0.97 ELSE coalesce(CASE WHEN m IS NOT NULL THEN c END, 0.0) END::DOUBLE AS conf FROM x""")
def capture_identity(spark, sf):
    """Identity of a capture from statement, slot and model."""
    key = lambda c: F.concat(F.lit("s"), (F.col(c) % 3).cast("string"))
    ident, conf = X.capture_identity(F.when(F.col("event_id") % 11 == 0, "stated"), F.when(F.col("event_id") % 3 != 0, key("user_id")), F.when(F.col("event_id") % 5 != 0, key("event_id")), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4))
    return table(spark, sf, "events").select("event_id", F.coalesce(ident, F.lit("")).alias("ident"), conf.alias("conf"))


@query("""
WITH x AS (SELECT conv_id, count_if(role = 'system') = 0 AS lock, max(turn) >= 2 AS layout, count_if(role = 'user') >= 1 AS anchors, count_if(length(text) < 60) AS open FROM conversations GROUP BY 1),
y AS (SELECT *, CASE WHEN NOT lock THEN 'INPUT_LOCK_NOT_ACTIVE' WHEN NOT layout THEN 'UNSUPPORTED_LAYOUT' WHEN NOT anchors THEN 'ANCHOR_MISMATCH' WHEN open > 0 THEN 'LOW_CONFIDENCE' END AS code FROM x)
SELECT conv_id, CASE WHEN code IS NULL THEN 'ok' WHEN code = 'LOW_CONFIDENCE' THEN 'degraded' ELSE 'error' END AS status, code FROM y""")
def scan_status(spark, sf):
    """Gates of a scan as columns: failing sessions are routed, not thrown."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "system") == 0).alias("lock"), (F.max("turn") >= 2).alias("layout"), (F.count_if(F.col("role") == "user") >= 1).alias("anchors"), F.collect_set(F.when(F.length("text") < 60, F.col("turn"))).alias("open"))
    status, code = X.scan_status(F.col("lock"), F.col("layout"), F.col("anchors"), F.col("open"))
    return c.select("conv_id", status.alias("status"), code.alias("code"))


@query("""
WITH f AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'click') AS payload, bool_or(event_type = 'view' AND value > 30) AS model, bool_or(event_type = 'purchase' AND value > 40) AS ocr, bool_or(value > 95) AS overview FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN payload AND model THEN 'payload+model' WHEN model AND ocr THEN 'model+ocr' WHEN model THEN 'model' WHEN ocr THEN 'ocr' WHEN overview THEN 'overview' WHEN payload THEN 'payload' ELSE 'missing' END AS origin FROM f""")
def equipment_source(spark, sf):
    """Provenance by precedence of the evidence."""
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kind, v = F.col("event_type"), F.col("value")
    flags = e.groupBy("user_id", "day").agg(F.bool_or(kind == "click").alias("payload"), F.bool_or((kind == "view") & (v > 30)).alias("model"), F.bool_or((kind == "purchase") & (v > 40)).alias("ocr"), F.bool_or(v > 95).alias("overview"))
    return flags.select("user_id", "day", X.equipment_source({k: F.col(k) for k in ("payload", "model", "ocr", "overview")}).alias("origin"))


@query("""
SELECT o_custkey AS k, reason FROM (SELECT o_custkey, avg(o_totalprice)::DECIMAL(18, 4)::DOUBLE / 300000 AS uid, count(*) / 20.0 AS agents, max(o_totalprice) / 500000 AS equipment FROM orders GROUP BY 1),
  (SELECT unnest(['uid_low_confidence', 'agents_low_confidence', 'equipment_low_confidence', 'other']) AS reason)
WHERE NOT coalesce((reason = 'uid_low_confidence' AND uid >= 0.9) OR (reason = 'agents_low_confidence' AND agents >= 0.9) OR (reason = 'equipment_low_confidence' AND equipment >= 0.85), false)""")
def stale_gates(spark, sf):
    """Top-level reasons go once their metric is good enough."""
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice").cast("decimal(18,4)").cast("double") / 300000).alias("uid"), (F.count("*") / 20.0).alias("agents"), (F.max("o_totalprice") / 500000).alias("equipment"))
    reasons = m.select("k", F.explode(F.array(*[F.lit(x) for x in ("uid_low_confidence", "agents_low_confidence", "equipment_low_confidence", "other")])).alias("reason"))
    return X.fresh_gates(reasons, "k", m)
