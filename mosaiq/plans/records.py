"""Queries over record rows: paths, resolutions, labels, training samples, derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import labels as L
from mosaiq.functions import policy
from mosaiq.plans.common import table
from mosaiq.plans.registry import query

PATH = "CASE page_id % 5 WHEN 0 THEN 'a/Disc 3/x.png' WHEN 1 THEN 'uid/p.png' WHEN 2 THEN 'liquid/disk-7.png' WHEN 3 THEN 'gear/remind.png' ELSE 'mind/disk_6/z.png' END"


@query(rf"""
WITH p AS (SELECT page_id, lower({PATH}) AS u FROM pages),
r AS (SELECT page_id, try_cast(nullif(regexp_extract(u, '\bdis[ck][_\-\s]*([1-6])\b', 1), '') AS INT) AS slot, CASE WHEN regexp_matches(u, '\buid\b|profile') THEN 'uid_panel' WHEN regexp_matches(u, 'mindscape|cinema|\bmind\b') THEN 'mindscape'
  WHEN regexp_matches(u, '\bdis[ck][_\-\s]*[1-6]\b') THEN 'disk_detail' WHEN regexp_matches(u, '\bequipment\b|loadout|gear') THEN 'equipment' END AS role FROM p)
SELECT page_id, slot, role, CASE role WHEN 'uid_panel' THEN 'account,profile,uid' WHEN 'mindscape' THEN 'account,mindscape,cinema' WHEN 'equipment' THEN 'account,equipment,inventory'
  WHEN 'disk_detail' THEN 'account,equipment,inventory,disc_detail,disc' || coalesce(',slot_' || slot, '') ELSE 'account' END AS tags FROM r""")
def path_slots(spark, sf):
    """Slot, role and tags that a path tells."""
    path = F.expr(PATH)
    rows = table(spark, sf, "pages").select("page_id", policy.path_slot(path).alias("slot"), policy.path_role(path).alias("role"))
    return rows.withColumn("tags", F.array_join(policy.source_tags(F.col("role"), F.col("slot")), ","))


@query("""
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN ' 1440P ' WHEN 1 THEN '1920x1080' WHEN 2 THEN 'odd' WHEN 3 THEN '720p' END AS stated, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 2560 ELSE 1920 END END AS w, CASE WHEN o_orderkey % 3 <> 0 THEN CASE o_custkey % 4 WHEN 0 THEN 1440 WHEN 1 THEN 1080 WHEN 2 THEN 1300 ELSE 400 END END AS h FROM orders),
s AS (SELECT *, CASE o WHEN 0 THEN '1440p' WHEN 1 THEN '1080p' WHEN 3 THEN '1080p' ELSE '' END AS said FROM (SELECT *, k % 5 AS o FROM r))
SELECT k, CASE WHEN w IS NULL THEN said WHEN abs(w / h::DOUBLE - 16 / 9.0::DOUBLE) > 0.2 OR (said <> '' AND said <> CASE WHEN h >= 1296 THEN '1440p' ELSE '1080p' END) THEN '' WHEN h >= 1296 THEN '1440p' ELSE '1080p' END AS resolution FROM s""")
def runtime_resolution(spark, sf):
    """What is stated and what is seen must agree, and the layout must be 16:9."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    stated = policy.cases([(key % 5 == k, F.lit(v)) for k, v in ((0, " 1440P "), (1, "1920x1080"), (2, "odd"), (3, "720p"))], F.lit(None).cast("string"))
    w = F.when(key % 3 != 0, F.when(cust % 2 == 0, 2560).otherwise(1920))
    h = F.when(key % 3 != 0, F.when(cust % 4 == 0, 1440).when(cust % 4 == 1, 1080).when(cust % 4 == 2, 1300).otherwise(400))
    return table(spark, sf, "orders").select(key.alias("k"), policy.runtime_resolution(stated, w, h).alias("resolution"))


def payload(*pairs):
    """A map of the filled pairs."""
    both = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[c.cast("string") for _, c in pairs]))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def labelled_rows(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    head = F.when(size % 4 == 0, "uid_digit").when(size % 4 == 1, "agent_icon").otherwise("equipment")
    own = payload(("uid_digit", F.when(size % 8 == 0, F.concat(F.lit(" "), (size % 10).cast("string")))), ("label", F.when(size % 3 == 0, F.concat(F.lit("x"), (size % 7).cast("string")))), ("agent_icon_id", F.when(size % 5 == 0, F.col("p_brand"))), ("disc_set_id", F.when(size % 6 == 2, F.col("p_type"))))
    hint = payload(("label", F.when(size % 2 == 0, F.lit("s"))), ("agent_icon_id", F.when(size % 7 == 1, F.lit("unknown thing"))))
    return p.select("p_partkey", "p_size", head.alias("head"), own.alias("own"), hint.alias("hint"), (F.col("p_partkey") % 3 == 0).alias("reviewed"))


SQL_ROWS = """
r AS (SELECT p_partkey, p_size AS z, CASE p_size % 4 WHEN 0 THEN 'uid_digit' WHEN 1 THEN 'agent_icon' ELSE 'equipment' END AS head, CASE WHEN p_size % 8 = 0 THEN (p_size % 10)::VARCHAR END AS d, CASE WHEN p_size % 3 = 0 THEN 'x' || p_size % 7 END AS l,
  CASE WHEN p_size % 5 = 0 THEN p_brand END AS a, CASE WHEN p_size % 6 = 2 THEN p_type END AS t, CASE WHEN p_size % 2 = 0 THEN 's' END AS hl, CASE WHEN p_size % 7 = 1 THEN 'unknown thing' END AS ha, p_partkey % 3 = 0 AS reviewed FROM part),
o AS (SELECT *, d IS NOT NULL OR l IS NOT NULL OR a IS NOT NULL OR t IS NOT NULL AS has_own, hl IS NOT NULL OR ha IS NOT NULL AS has_hint FROM r)"""


@query(f"""WITH {SQL_ROWS}
SELECT p_partkey, coalesce(d, a, t, CASE WHEN head <> 'agent_icon' THEN l END, '') AS audit,
  coalesce(CASE head WHEN 'uid_digit' THEN coalesce(d, CASE WHEN l IS NOT NULL THEN substr(l, 2) END, '') WHEN 'agent_icon' THEN CASE WHEN coalesce(a, t) IS NOT NULL THEN CASE WHEN a = 'Brand#1' THEN 'one' ELSE 'unknown' END END ELSE coalesce(a, t, l) END, '') AS plan,
  CASE WHEN has_own THEN 'own' WHEN has_hint THEN 'hint' ELSE 'none' END AS active, CASE WHEN reviewed OR has_own THEN 'own' WHEN has_hint THEN 'hint' ELSE 'none' END AS chosen FROM o""")
def label_precedence(spark, sf):
    """Which key names the label and which payload counts, by the rules of audits, plans, previews and training."""
    canonical = lambda c: F.when(c == "Brand#1", "one").otherwise("")
    rows = labelled_rows(spark, sf)
    own, hint, head = F.col("own"), F.col("hint"), F.col("head")
    act, cho = L.active(own, hint), L.chosen(own, hint, F.col("reviewed"), "any")
    side = lambda m: F.when(F.to_json(m) == F.to_json(own), F.when((F.size(own) > 0) | F.col("reviewed"), "own").otherwise("none")).when(F.coalesce(F.size(m), F.lit(0)) > 0, "hint").otherwise("none")
    return rows.select("p_partkey", L.audit_label(own, head).alias("audit"), L.plan_label(own, head, canonical).alias("plan"), F.when(F.size(own) > 0, "own").when(F.size(act) > 0, "hint").otherwise("none").alias("active"), F.when(cho.isNull(), "none").otherwise(side(cho)).alias("chosen"))


@query(f"""WITH {SQL_ROWS},
c AS (SELECT p_partkey, CASE WHEN reviewed THEN l WHEN has_own THEN l ELSE hl END AS label, NOT (reviewed OR has_own OR has_hint) AS nothing, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 < 5 THEN 'train' ELSE 'val' END AS split, p_partkey % 11 = 0 AS pathless FROM o WHERE head = 'equipment' OR NOT (reviewed OR has_own OR has_hint)),
k AS (SELECT *, CASE WHEN nothing THEN 'no_payload' WHEN label IS NULL THEN 'no_label' WHEN split IS NULL THEN 'no_split' WHEN pathless THEN 'no_path' ELSE 'kept' END AS outcome FROM c),
n AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS i FROM (SELECT DISTINCT label FROM k WHERE outcome = 'kept'))
SELECT p_partkey AS id, outcome, k.label, split, CASE WHEN outcome = 'kept' THEN i END AS label_index FROM k LEFT JOIN n ON n.label = k.label""")
def training_sample(spark, sf):
    """Rows of a head with label, split and dense label index; the others with the reason why they are skipped."""
    rows = labelled_rows(spark, sf).withColumn("id", F.col("p_partkey")).withColumn("path", F.when(F.col("id") % 11 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))))
    splits = rows.where("id % 7 <> 0").select(F.col("id").alias("record_id"), F.when(F.col("id") % 7 < 5, "train").otherwise("val").alias("split"))
    # A reviewed payload counts even if it is empty.
    best = L.chosen(F.col("own"), F.col("hint"), F.col("reviewed"), "any")
    return L.training_sample(rows, splits, "equipment", best, L.value(best, "label"), F.col("head"))


@query("""
SELECT format('{}_uid_digit_{:02d}', o_orderkey, i - 1) AS id, 'derived_uid_digit' AS kind, substr((1000000000 + o_orderkey)::VARCHAR, i::INT, 1) AS label, (i - 1)::INT AS piece, o_orderkey::VARCHAR AS parent
FROM orders, range(1, 11) t(i)""")
def derived_digits(spark, sf):
    """One row per digit of a reviewed number, with the way back to its parent."""
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("s").alias("sourceId"), F.lit("t").alias("sessionId"), (F.col("o_orderkey") + 1000000000).cast("string").alias("uid"))
    return L.derived(parents, F.filter(F.split("uid", ""), lambda c: c != ""), "uid_digit").select("id", "kind", "label", "piece", F.col("derivedFromRecordId").alias("parent"))


@query("""
SELECT n_nationkey, unnest(['who is ' || n_name, n_name || ' gameplay ' || n_nationkey, 'guide ' || n_name]) AS q FROM nation""")
def search_texts(spark, sf):
    """Search texts of each entity from templates."""
    q = L.candidate_queries(F.col("n_name"), F.col("n_nationkey").cast("string"), ["who is {name}", "{name} gameplay {id}", "guide {name}"])
    return table(spark, sf, "nation").select("n_nationkey", F.explode(q).alias("q"))


@query("""
WITH r AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'amp_o_x' WHEN 1 THEN 'amp_ii' WHEN 2 THEN p_brand || '_o' WHEN 3 THEN '' ELSE p_brand END AS i, CASE p_size % 5 WHEN 0 THEN 'ii' WHEN 1 THEN p_name || ' O' ELSE p_name END AS n FROM part)
SELECT p_partkey, (CASE WHEN i = '' OR i LIKE '%\\_o' ESCAPE '\\' OR i LIKE 'amp\\_o\\_%' ESCAPE '\\' OR i = 'amp_ii' THEN 0 ELSE 100 END + CASE WHEN n = 'ii' OR n LIKE '% O' THEN 0 ELSE 20 END + least(length(i), 40))::INT AS quality FROM r""")
def alias_quality(spark, sf):
    size, brand, name = F.col("p_size"), F.col("p_brand"), F.col("p_name")
    ident = F.when(size % 6 == 0, "amp_o_x").when(size % 6 == 1, "amp_ii").when(size % 6 == 2, F.concat(brand, F.lit("_o"))).when(size % 6 == 3, "").otherwise(brand)
    shown = F.when(size % 5 == 0, "ii").when(size % 5 == 1, F.concat(name, F.lit(" O"))).otherwise(name)
    return table(spark, sf, "part").select("p_partkey", L.alias_quality(ident, shown).alias("quality"))


@query("""
SELECT event_id, coalesce(CASE event_type WHEN 'click' THEN value / 100 <= 0.3 AND user_id / 100.0 >= 0.1 WHEN 'view' THEN value / 100 <= 0.1 AND user_id / 100.0 >= 0.5 ELSE false END, false) AS safe FROM events""")
def safe_predictions(spark, sf):
    """Predictions that pass their own row of a rule table."""
    rule = L.safe_prediction(F.col("event_type"), F.col("value") / 100, F.col("user_id") / 100.0, {"click": (0.3, 0.1), "view": (0.1, 0.5)})
    return table(spark, sf, "events").select("event_id", rule.alias("safe"))
