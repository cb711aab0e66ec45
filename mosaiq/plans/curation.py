"""Curation queries: policy, scope, splits, queues, upserts, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import policy, texts
from mosaiq.operators import curation as C
from mosaiq.operators import ranks as R
from mosaiq.plans.common import table
from mosaiq.plans.registry import query

def source_no():
    """The number in a source's name."""
    return F.substring("source", 4, 9).try_cast("int")


#: Tags by source number, so that every role rule is met.
TAG_RULES = [("uid", 0), ("roster", 1), ("cinema", 2), ("w_engine", 3), ("disc", 4), ("inventory", 5), ("stats", 6), ("account", 7)]


def documents_as_sources(spark, sf):
    tag = policy.cases([(source_no() % 10 == k, F.lit(t)) for t, k in TAG_RULES], F.lit("combat"))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.array(tag).alias("tags"))


SQL_TAG = "CASE try_cast(substr(source, 4, 9) AS INT) % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for t, k in TAG_RULES) + " ELSE 'combat' END"
SQL_WORKFLOW = "CASE WHEN tag = 'combat' THEN 'combat_reference' ELSE 'account_import' END"
SQL_ROLE = "CASE tag WHEN 'uid' THEN 'uid_panel' WHEN 'roster' THEN 'roster' WHEN 'cinema' THEN 'mindscape' WHEN 'w_engine' THEN 'amplifier_detail' WHEN 'disc' THEN 'disk_detail' WHEN 'inventory' THEN 'equipment' WHEN 'stats' THEN 'agent_detail' WHEN 'account' THEN 'account_unknown' ELSE 'combat' END"
SQL_HEAD = "CASE lang WHEN 'en' THEN 'agent_icon' WHEN 'fr' THEN 'equipment' WHEN 'de' THEN 'uid_digit' ELSE 'unknown' END"


@query(f"""
WITH s AS (SELECT doc_id, lang, {SQL_TAG} AS tag FROM documents),
p AS (SELECT doc_id, {SQL_WORKFLOW} AS workflow, {SQL_ROLE} AS role, {SQL_HEAD} AS head FROM s),
h AS (SELECT *, CASE role WHEN 'uid_panel' THEN 'uid_digit' WHEN 'roster' THEN 'agent_icon' WHEN 'agent_detail' THEN 'agent_icon'
      WHEN 'equipment' THEN 'agent_icon,equipment' WHEN 'disk_detail' THEN 'equipment' WHEN 'amplifier_detail' THEN 'equipment'
      WHEN 'account_unknown' THEN 'agent_icon,equipment,uid_digit' ELSE '' END AS heads FROM p)
SELECT doc_id, workflow, role, head, heads FROM h
WHERE workflow = 'account_import' AND list_contains(string_split(heads, ','), head)""")
def scope_filter(spark, sf):
    """Rows of the account workflow whose head their screen role allows."""
    s = documents_as_sources(spark, sf)
    none = F.lit(None).cast("string")
    s = s.withColumn("workflow", policy.source_workflow(none, F.col("source"), none, F.col("tags")))
    s = s.withColumn("role", policy.source_role(none, F.col("workflow"), F.col("tags")))
    head = policy.cases([(F.col("lang") == k, F.lit(v)) for k, v in (("en", "agent_icon"), ("fr", "equipment"), ("de", "uid_digit"))], none)
    s = s.withColumn("head", policy.record_head(head, none, none)).withColumn("h", policy.eligible_heads(F.lit(None).cast("array<string>"), F.col("role")))
    s = s.where(policy.in_scope(F.col("workflow"), policy.ACCOUNT, policy.import_eligible(F.col("workflow"), F.col("h"), F.col("head"))))
    return s.select("doc_id", "workflow", "role", "head", F.array_join("h", ",").alias("heads"))


@query("""
WITH r AS (SELECT d.doc_id, d.source, d.lang, l.doc_id IS NOT NULL AS ok, d.source || '::session::' || (d.doc_id // 10)::VARCHAR AS g
           FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT g, row_number() OVER (ORDER BY md5('42' || g), g) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM r WHERE ok)),
s AS (SELECT g, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM g),
c AS (SELECT source, count_if(ok) AS samples, count(DISTINCT lang) FILTER (ok) AS langs, count_if(ok AND split = 'train') AS train,
      count_if(ok AND split = 'val') AS val, count_if(ok AND split = 'test') AS test, count_if(NOT ok) AS unsplit
      FROM r LEFT JOIN s USING (g) GROUP BY source)
SELECT source, samples::BIGINT AS samples, langs::BIGINT AS langs, train::BIGINT AS train, val::BIGINT AS val, test::BIGINT AS test, unsplit::BIGINT AS unsplit,
  concat_ws(';', CASE WHEN samples < 20 THEN 'need_at_least_20_reviewed_samples' END, CASE WHEN langs < 3 THEN 'need_at_least_3_distinct_labels' END,
    CASE WHEN train = 0 THEN 'missing_train_split_samples' END, CASE WHEN val = 0 THEN 'missing_val_split_samples' END,
    CASE WHEN test = 0 THEN 'missing_test_split_samples' END) AS blockers
FROM c""")
def readiness_by_source(spark, sf):
    """Per source: reviewed samples, languages, leakage-free split counts, and what blocks training."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit(True).alias("ok"))
    key = policy.group_key(F.col("source"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(""), F.col("doc_id").cast("string"), F.lit(""), F.lit(False))
    rows = docs.select("doc_id", "source", "lang", key.alias("g")).join(labels, "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    rows = rows.join(R.group_splits(rows.where("ok"), "g", "42"), "g", "left")
    split = lambda s: F.count_if(F.col("ok") & (F.col("split") == s)).alias(s)
    out = rows.groupBy("source").agg(F.count_if("ok").alias("samples"), F.count_distinct(F.when(F.col("ok"), F.col("lang"))).alias("langs"), split("train"), split("val"), split("test"), F.count_if(~F.col("ok")).alias("unsplit"))
    blockers = [F.when(F.col("samples") < 20, F.lit("need_at_least_20_reviewed_samples")), F.when(F.col("langs") < 3, F.lit("need_at_least_3_distinct_labels"))]
    blockers += [F.when(F.col(s) == 0, F.lit(f"missing_{s}_split_samples")) for s in ("train", "val", "test")]
    return out.withColumn("blockers", F.concat_ws(";", *blockers))


@query("""
SELECT reason, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN source IN ('src1', 'src7') THEN 'source' WHEN lang = 'de' THEN 'head' WHEN n_chars < 500 THEN 'low_confidence' ELSE 'kept' END AS reason FROM documents)
GROUP BY reason""")
def prune_reasons(spark, sf):
    rules = [("source", F.col("source").isin("src1", "src7")), ("head", F.col("lang") == "de"), ("low_confidence", F.col("n_chars") < 500)]
    return C.pruned(table(spark, sf, "documents"), rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH kept AS (SELECT * FROM documents WHERE n_chars >= 4000 AND lang <> 'en')
SELECT 'source' AS kind, source AS name FROM (SELECT DISTINCT source FROM documents) s WHERE source NOT IN (SELECT source FROM kept)
UNION ALL SELECT 'label', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM kept)""")
def unused_sources(spark, sf):
    """Sources without kept rows, and labels whose row was removed."""
    docs = table(spark, sf, "documents")
    kept = docs.where("n_chars >= 4000 and lang <> 'en'")
    sources = docs.select("source").distinct().join(kept, "source", "left_anti").select(F.lit("source").alias("kind"), F.col("source").alias("name"))
    labels = table(spark, sf, "labels").join(kept, "doc_id", "left_anti").select(F.lit("label"), F.col("doc_id").cast("string"))
    return sources.union(labels)


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2""")
def exact_dedup(spark, sf):
    return C.exact_dedup(table(spark, sf, "documents"), F.col("text"), "doc_id")


SQL_BITS = """
signs AS (SELECT vec_id, bit_string::BIT::BIGINT AS h FROM (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bit_string FROM embeddings)),
bits AS (SELECT vec_id * 4 + k AS frame, xor(h, coalesce(list_sum(list_transform(range(0, 3 * k), lambda j: 1::BIGINT << ((vec_id * 7 + j * 11) % 48)::INT)), 0)::BIGINT) AS h FROM signs, range(0, 4) t(k)),
reps AS (SELECT h, min(frame) AS frame FROM bits GROUP BY h)"""


def frames(spark, sf):
    """Four frames per vector: 64-bit hashes, the signs of its numbers with the first in the top bit; each frame turns three more
    low bits than the one before. The third frame shows something else."""
    halves = [F.aggregate(F.slice("embedding", k, 32), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)) for k in (1, 33)]
    h = F.shiftleft(halves[0], 32).bitwiseOR(halves[1])
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    turned = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda j: j < 3 * F.col("k")), F.lit(0).cast("long"), lambda a, j: a + F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("vec_id") * 7 + j * 11) % 48).cast("int")))
    shown = F.when(F.col("k") == 2, F.reverse("embedding")).otherwise(F.col("embedding"))
    return rows.select((F.col("vec_id") * 4 + F.col("k")).alias("frame"), F.col("h").bitwiseXOR(turned).alias("h"), shown.alias("shown"))


@query(f"""WITH {SQL_BITS}
SELECT a.frame AS a, b.frame AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM reps a JOIN reps b
ON a.frame < b.frame AND ((a.h >> 48) & 65535) = ((b.h >> 48) & 65535) WHERE bit_count(xor(a.h, b.h)) <= 6""")
def near_dup_bits(spark, sf):
    return C.near_pairs(frames(spark, sf), "frame", "h")


@query()
def near_dup_greedy(spark, sf):
    """Frames that no kept one comes near in hash and looks like."""
    from mosaiq.operators import pixels

    return C.greedy_survivors(frames(spark, sf), "frame", "h", "shown", pixels.vectors_alike).select("frame", "accepted")


SQL_GROUP_SPLIT = """
g AS (SELECT source, row_number() OVER (ORDER BY md5('7' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
s AS (SELECT source, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM g)"""


@query(f"WITH {SQL_GROUP_SPLIT} SELECT doc_id, source, split FROM documents JOIN s USING (source)")
def split_groups(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(R.group_splits(docs, "source", "7"), "source")


@query(f"""WITH {SQL_GROUP_SPLIT},
old AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE doc_id % 2 = 0),
new AS (SELECT doc_id, split FROM documents JOIN s USING (source) WHERE lang = 'en')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def split_merge(spark, sf):
    """Rows of the selected scope are assigned anew; other old assignments stay."""
    docs = table(spark, sf, "documents")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("split"))
    new = docs.where("lang = 'en'").join(R.group_splits(docs, "source", "7"), "source").select("doc_id", "split")
    return R.merge_splits(old, new, "doc_id")


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, sf):
    return R.stratified_splits(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", "42")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9' || doc_id::VARCHAR), doc_id::VARCHAR) AS r, count(*) OVER () AS n FROM labels)
SELECT doc_id FROM r WHERE r <= greatest(1, floor(n * 0.05))""")
def double_review_sample(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return R.hash_sample(rows, "key", "9", 0.05).select("doc_id")


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE n <= 3 OR r IN (0, (n - 1) // 2, n - 1)""")
def even_sample(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return R.even_sample(rows, ["conv_id"], [F.col("turn")], 3)


SQL_SCORED = """
scored AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 8 ELSE 18 END + CASE lang WHEN 'en' THEN 42 WHEN 'fr' THEN 26 WHEN 'de' THEN 12 ELSE 0 END
    + CASE WHEN lang = 'fr' AND l.doc_id IS NULL THEN 25 ELSE 0 END
    + CASE WHEN coalesce(n_chars / 10000.0, 0) < 0.05 THEN 22 WHEN coalesce(n_chars / 10000.0, 0) < 0.1 THEN 12 ELSE 0 END AS score,
    concat_ws(';', CASE WHEN l.doc_id IS NULL THEN 'unlabeled' ELSE 'needs_review' END, CASE lang WHEN 'en' THEN 'uid_digit' WHEN 'fr' THEN 'agent_icon' WHEN 'de' THEN 'equipment' END,
    CASE WHEN lang = 'fr' AND l.doc_id IS NULL THEN 'missing_agent_suggestion' END,
    CASE WHEN coalesce(n_chars / 10000.0, 0) < 0.05 THEN 'very_low_conf' WHEN coalesce(n_chars / 10000.0, 0) < 0.1 THEN 'low_conf' END) AS reasons,
    lang || ':' || source AS grp
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def scored(spark, sf):
    from mosaiq.operators.reports import priority

    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    head = policy.cases([(F.col("lang") == a, F.lit(b)) for a, b in (("en", "uid_digit"), ("fr", "agent_icon"), ("de", "equipment"))], F.lit("unknown"))
    status = F.when(F.col("labelled"), "needs_review").otherwise("unlabeled")
    score, reasons = priority(status, head, F.col("labelled").isNotNull(), F.lit(False), F.lit(False), F.col("n_chars") / 10000.0, low=(0.05, 0.1))
    return docs.select("doc_id", score.alias("score"), reasons.alias("reasons"), F.concat_ws(":", "lang", "source").alias("grp"))


@query(f"WITH {SQL_SCORED} SELECT doc_id, score, reasons FROM scored")
def priority_score(spark, sf):
    return scored(spark, sf).select("doc_id", "score", "reasons")


SQL_QUEUE = f"""{SQL_SCORED},
turns AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS turn FROM scored),
top AS (SELECT *, row_number() OVER (ORDER BY turn, score DESC, grp) AS position FROM turns QUALIFY position <= 300),
queue AS (SELECT *, 'batch-' || lpad(((position - 1) // 50 + 1)::VARCHAR, 3, '0') AS batch_id FROM top)"""


@query(f"WITH {SQL_QUEUE} SELECT position, batch_id, doc_id, score, grp FROM queue")
def round_robin_queue(spark, sf):
    return R.round_robin(scored(spark, sf), "grp", "score", "doc_id", 50, 6).select("position", "batch_id", "doc_id", "score", "grp").withColumn("position", F.col("position").cast("long"))


@query(f"WITH {SQL_QUEUE} SELECT batch_id, count(*)::BIGINT AS size, max(score) AS top_score, count(DISTINCT grp)::BIGINT AS groups FROM queue GROUP BY batch_id")
def batch_summary(spark, sf):
    return R.round_robin(scored(spark, sf), "grp", "score", "doc_id", 50, 6).groupBy("batch_id").agg(F.count("*").alias("size"), F.max("score").alias("top_score"), F.count_distinct("grp").alias("groups"))


@query("""
WITH old AS (SELECT doc_id, quality, toxic FROM labels),
new AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 1 END AS quality, CASE WHEN lang = 'en' THEN 0 END AS toxic FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, coalesce(new.quality, old.quality) AS quality, coalesce(new.toxic, old.toxic) AS toxic,
  NOT (coalesce(new.quality, old.quality) IS NOT DISTINCT FROM old.quality AND coalesce(new.toxic, old.toxic) IS NOT DISTINCT FROM old.toxic) AS changed,
  concat_ws(';', CASE WHEN coalesce(new.quality, old.quality) IS NULL THEN 'quality_missing' END, CASE WHEN coalesce(new.toxic, old.toxic) IS NULL THEN 'toxic_missing' END) AS errors
FROM old FULL OUTER JOIN new USING (doc_id)""")
def review_upsert(spark, sf):
    """Reviewed fields over labels; what is still missing is told in `errors`, not thrown."""
    old = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    new = table(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, 1).alias("quality"), F.when(F.col("lang") == "en", 0).alias("toxic"))
    out = C.upserted(old, new, "doc_id", ["quality", "toxic"])
    return out.withColumn("errors", F.concat_ws(";", *[F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in ("quality", "toxic")]))


@query("""
SELECT event_id, coalesce(CASE WHEN value > 50 THEN 99 END, try_cast(json_extract_string(props, '$.k') AS INT)) AS k, (value > 50 AND json_extract_string(props, '$.k') IS NOT NULL) AS overwritten
FROM events""")
def demote_merge(spark, sf):
    """Suggestions are merged into the map of a row; later values win on equal keys."""
    old = F.from_json("props", "map<string,int>")
    new = F.when(F.col("value") > 50, F.create_map(F.lit("k"), F.lit(99))).otherwise(F.create_map().cast("map<string,int>"))
    merged = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf, "events").select("event_id", merged["k"].alias("k"), ((F.col("value") > 50) & old["k"].isNotNull()).alias("overwritten"))


@query("""
WITH c AS (SELECT user_id, event_type AS v, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS rn FROM c),
t AS (SELECT user_id, max(CASE WHEN rn = 1 THEN v END) AS best, max(CASE WHEN rn = 1 THEN n END) AS n1, coalesce(max(CASE WHEN rn = 2 THEN n END), 0) AS n2 FROM r GROUP BY user_id),
x AS (SELECT u.user_id, best, CASE WHEN best IS NULL THEN 'no_ocr' WHEN n2 = 0 THEN 'single_unique' WHEN n1 >= 3 AND n2 <= 1 THEN 'strong_majority' ELSE 'conflicting_ocr' END AS resolution
      FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t USING (user_id))
SELECT user_id, CASE WHEN resolution IN ('single_unique', 'strong_majority') THEN best ELSE '' END AS resolved, resolution FROM x""")
def majority_vote(spark, sf):
    votes = table(spark, sf, "events").select("user_id", F.when(F.col("value") < 20, F.col("event_type")).alias("vote"))
    return C.majority(votes, "user_id", "vote")


@query("""
WITH m AS (SELECT source AS cluster_id, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 1 ELSE 0 END AS wanted, doc_id FROM documents)
SELECT m.doc_id, wanted, quality AS current, CASE WHEN quality = wanted THEN 'applied' ELSE 'conflict' END AS status FROM m JOIN labels USING (doc_id)""")
def cluster_apply(spark, sf):
    """Decisions on clusters of rows are applied to their members; members that say otherwise are conflicts."""
    clusters = table(spark, sf, "documents").groupBy("source").agg(F.collect_list("doc_id").alias("members"))
    clusters = clusters.select("members", F.when(source_no() % 2 == 0, 1).otherwise(0).cast("string").alias("wanted"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    out = C.clusters_applied(clusters, "members", "wanted", labels, "doc_id", "quality")
    return out.withColumn("wanted", F.col("wanted").cast("int")).withColumn("current", F.col("current").cast("int"))


@query("""
WITH p AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pack FROM conversations)
SELECT conv_id, pack::BIGINT AS pack, count(*)::BIGINT AS n, count_if(role = 'assistant')::BIGINT AS answers, count_if(role = 'assistant') <> 1 AS ambiguous FROM p GROUP BY conv_id, pack""")
def packs_gaps_islands(spark, sf):
    rows = R.islands(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], F.col("role") == "user", "pack")
    answers = F.count_if(F.col("role") == "assistant")
    return rows.groupBy("conv_id", "pack").agg(F.count("*").alias("n"), answers.alias("answers"), (answers != 1).alias("ambiguous"))


@query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""")
def best_per_key(spark, sf):
    return R.first_per_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc_nulls_last("value"), F.asc("event_id")])


SQL_VARIANTS = """
v AS (SELECT p_type AS alias, p_brand AS ident, count(*) AS samples, CASE WHEN p_brand LIKE '%1' THEN 0 ELSE 100 END + least(length(p_brand), 40) AS quality FROM part GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY quality DESC, samples DESC, ident) AS rn, first_value(ident) OVER (PARTITION BY alias ORDER BY quality DESC, samples DESC, ident) AS winner FROM v)"""


@query(f"WITH {SQL_VARIANTS} SELECT alias, ident, samples::BIGINT AS samples, CASE WHEN rn = 1 THEN '' ELSE winner END AS lost_to FROM w")
def winner_losers(spark, sf):
    quality = F.when(F.endswith("ident", F.lit("1")), 0).otherwise(100) + F.least(F.length("ident"), F.lit(40))
    variants = table(spark, sf, "part").groupBy(F.col("p_type").alias("alias"), F.col("p_brand").alias("ident")).agg(F.count("*").alias("samples"))
    won, lost = R.winners_and_losers(variants, "alias", "ident", quality, "samples")
    return won.withColumn("lost_to", F.lit("")).unionByName(lost.withColumnRenamed("winner", "lost_to"))


@query("""
WITH s AS (SELECT user_id, event_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts FROM events),
b AS (SELECT user_id, event_id, sum(CASE WHEN step > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS band FROM s)
SELECT user_id, band::BIGINT AS band, count(*)::BIGINT AS n FROM b GROUP BY user_id, band""")
def bands(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return R.gap_bands(events, ["user_id"], F.col("at"), [F.col("ts"), F.col("event_id")], 86400, "band").groupBy("user_id", "band").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT user_id, row_number() OVER w AS ordinal, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS spread,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ordinal::INT AS ordinal, round(spread, 4) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spread, ordinal) AS rn FROM r WHERE n = 10) WHERE rn = 1""")
def sliding_score(spark, sf):
    """The steadiest run of exactly ten observations per user."""
    return R.best_window(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value"), 10).withColumn("spread", F.round("spread", 4))


@query("""
WITH i AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate)::BIGINT + o_orderkey % 60 * 86400 AS b FROM orders),
t AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i),
s AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM t)
SELECT k, min(a) AS a, max(b) AS b, count(*)::BIGINT AS n FROM s GROUP BY k, isle""")
def interval_merge(spark, sf):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), start.alias("a"), (start + F.col("o_orderkey") % 60 * 86400).alias("b"))
    return R.merged_intervals(rows, ["k"], "a", "b")


#: Row by row, each user's last kept value goes along.
SQL_SCENES = """
WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
k AS (SELECT user_id, event_id, value, n, value AS last, true AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.value, r.n, CASE WHEN abs(r.value - k.last) >= 10 THEN r.value ELSE k.last END, abs(r.value - k.last) >= 10 FROM k JOIN r ON r.user_id = k.user_id AND r.n = k.n + 1)
SELECT user_id, event_id, value FROM k WHERE kept"""


@query(SQL_SCENES)
def scene_filter(spark, sf):
    """Observations that differ enough from the last one kept, per user."""
    return C.scene_keepers(table(spark, sf, "events"), "user_id", "event_id", "value", 10.0)


@query("""
WITH old AS (SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 0), new AS (SELECT doc_id, 'fresh' AS source FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)""")
def insert_if_absent(spark, sf):
    docs = table(spark, sf, "documents")
    return C.insert_absent(docs.where("doc_id % 4 <> 0").select("doc_id", "source"), docs.where("doc_id % 2 = 0").select("doc_id", F.lit("fresh").alias("source")), "doc_id")


@query("""
WITH new AS (SELECT conv_id, 'crop' AS kind, count(*)::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, role AS kind, turn AS n FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT * FROM new WHERE conv_id % 3 = 0""")
def replace_derived(spark, sf):
    """Derived rows of the touched parents are deleted, then inserted anew."""
    conv = table(spark, sf, "conversations")
    touched = conv.where("conv_id % 3 = 0")
    new = touched.where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.lit("crop").alias("kind"), "n")
    return C.replaced_children(conv.select("conv_id", F.col("role").alias("kind"), F.col("turn").alias("n")), new, touched, "conv_id")


@query("""
SELECT user_id, regexp_replace(coalesce(n, ''), '(^ )|( $)', '') AS note FROM (
  SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'checked twice' WHEN user_id % 3 = 1 THEN 'checked twice recanonicalised' ELSE 'recanonicalised' END AS n FROM events)""")
def review_notes(spark, sf):
    notes = F.when(F.col("user_id") % 3 == 0, "checked twice").when(F.col("user_id") % 3 == 1, "checked twice")
    rows = table(spark, sf, "events").select("user_id").distinct().withColumn("old", notes)
    return rows.select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("old")).otherwise(texts.note_added(F.col("old"), "recanonicalised")).alias("note"))


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS k FROM part WHERE p_size = 1 UNION SELECT p.p_partkey FROM t JOIN part p ON p.p_partkey // 8 = t.k WHERE p.p_size <= 40) SELECT k FROM t""")
def trusted_growth(spark, sf):
    """Trusted rows that vouch for others, until none is new."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("next"), F.floor(F.col("p_partkey") / 8).alias("by"), "p_size")
    seeds = part.where("p_size = 1").select(F.col("next").alias("k"))
    return C.fixpoint(seeds, lambda t: t.join(part.where("p_size <= 40"), F.col("k") == F.col("by")).select(F.col("next").alias("k")).distinct())
