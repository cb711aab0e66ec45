"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import policy
from mosaiq.operators import reports as P
from mosaiq.plans.common import table
from mosaiq.plans.registry import query


@query("""
SELECT n_name, count(c_custkey)::BIGINT AS customers, count_if(c_acctbal > 5000)::BIGINT AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def coverage_nation(spark, sf):
    """Counts for every entry of a dimension, 0 where there are none."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    out = P.zero_filled(table(spark, sf, "nation"), counts, "n_nationkey", "customers")
    return out.select("n_name", "customers", F.coalesce("rich", F.lit(0).cast("long")).alias("rich"))


@query("""
SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1992-03-01')""")
def missing_brand(spark, sf):
    """Dimension entries without an observation in a period."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    seen = table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1992-03-01'").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return part.select("p_brand").distinct().join(seen, "p_brand", "left_anti")


@query("""
SELECT r_regionkey, n_nationkey FROM region, nation WHERE n_regionkey <> r_regionkey""")
def owned_complement(spark, sf):
    """What each owner lacks of a roster."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    roster = P.roster_array(nation.withColumn("ordinal", F.col("n_nationkey")), "n_nationkey", "ordinal")
    owned = table(spark, sf, "region").select("r_regionkey").join(nation, "r_regionkey", "left")
    return P.complement(owned, "r_regionkey", "n_nationkey", roster)


@query("""
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*)::BIGINT AS n, greatest(0, 300 - count(*))::BIGINT AS deficit FROM documents
GROUP BY GROUPING SETS ((lang), (source), (lang, source))""")
def counts_grouping_sets(spark, sf):
    """Sampling plan: several groupings in one pass, with what is missing to a target."""
    docs = table(spark, sf, "documents")
    out = docs.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"))
    return P.deficits(out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n"), "n", 300)


@query("""
SELECT c_mktsegment, count(*)::BIGINT AS n, greatest(0, 310 - count(*))::BIGINT AS deficit FROM customer GROUP BY 1""")
def deficit_report(spark, sf):
    return P.deficits(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "n", 310)


@query("""
SELECT count(*)::BIGINT AS total, count_if(l.doc_id IS NOT NULL)::BIGINT AS reviewed, count_if(l.doc_id IS NULL)::BIGINT AS unlabeled, count_if(quality = 0)::BIGINT AS poor,
  count_if(toxic = 1)::BIGINT AS toxic, count_if(n_chars < 600)::BIGINT AS low_confidence, count_if(quality IS NOT NULL AND n_chars < 600)::BIGINT AS low_reviewed,
  count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS langs, count(DISTINCT CASE WHEN quality = 1 THEN source END)::BIGINT AS good_sources,
  string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list FROM documents LEFT JOIN labels l USING (doc_id)""")
def qa_audit(spark, sf):
    """All audit figures in one pass."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    when = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return rows.agg(
        F.count("*").alias("total"), when(F.col("has"), "reviewed"), when(F.col("has").isNull(), "unlabeled"), when(F.col("quality") == 0, "poor"), when(F.col("toxic") == 1, "toxic"),
        when(F.col("n_chars") < 600, "low_confidence"), when(F.col("quality").isNotNull() & (F.col("n_chars") < 600), "low_reviewed"),
        F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct(F.when(F.col("quality") == 1, F.col("source"))).alias("good_sources"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"),
    )


SPLIT = "CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 = 7 THEN 'val' WHEN user_id % 10 = 8 THEN 'test' END"
SQL_FIELDS = ", ".join(f"count_if(coalesce({s}, 'unsplit') = '{name}' AND {rule})::BIGINT AS {field}_{name}" for s in ["split"] for name in ("train", "val", "test", "unsplit") for field, rule in (("value", "value IS NOT NULL"), ("big", "value > 50"), ("props", "props LIKE '%k%'")))


@query(f"SELECT event_type, {SQL_FIELDS} FROM (SELECT *, {SPLIT} AS split FROM events) GROUP BY event_type")
def field_completeness(spark, sf):
    events = table(spark, sf, "events").withColumn("split", F.expr(SPLIT))
    return P.completeness(events, "event_type", "split", {"value": F.col("value").isNotNull(), "big": F.col("value") > 50, "props": F.col("props").like("%k%")})


@query("""
WITH p AS (SELECT conv_id, turn // 4 AS page, count(*) AS n, max(turn % 4 + 1) AS slots FROM conversations GROUP BY 1, 2)
SELECT conv_id, arg_max(n, page) < CASE WHEN max(slots) > 0 THEN max(slots) ELSE max(n) END AS "full" FROM p GROUP BY conv_id""")
def page_coverage(spark, sf):
    """Whether the last page of each conversation is shorter than a page can be."""
    rows = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 4).alias("page"), (F.col("turn") % 4 + 1).alias("slot"))
    return P.coverage_by_page(rows, "conv_id", "page", "slot")


@query("""
SELECT coalesce(CASE WHEN source LIKE 'src1%' THEN source END, '__missing__') AS grp, dense_rank() OVER (ORDER BY coalesce(CASE WHEN source LIKE 'src1%' THEN source END, '__missing__'))::INT AS number,
  count(*)::BIGINT AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1""")
def group_numbers(spark, sf):
    """Panels by group, numbered by a dense rank over the groups; rows without a group form one of their own."""
    from pyspark.sql import Window as W

    grp = F.coalesce(F.when(F.col("source").like("src1%"), F.col("source")), F.lit("__missing__"))
    groups = table(spark, sf, "documents").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return groups.select("grp", F.dense_rank().over(W.orderBy("grp")).alias("number"), "n", "langs")


@query("""
SELECT source, string_agg(lang || ':' || n, '; ' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def session_counts(spark, sf):
    per = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("lang", F.concat_ws(":", "lang", F.col("n").cast("string")).alias("s"))))
    return per.groupBy("source").agg(F.array_join(F.transform(cells, lambda x: x["s"]), "; ").alias("counts"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE value < 2)
SELECT event_type, count(*)::BIGINT AS n, string_agg(CASE WHEN rn <= 3 THEN event_id::VARCHAR END, ',' ORDER BY rn) AS examples FROM r GROUP BY event_type""")
def failures_with_examples(spark, sf):
    """Failures counted by reason, with the first few of each."""
    bad = table(spark, sf, "events").where("value < 2").select("event_type", "event_id")
    from pyspark.sql import Window as W

    ranked = bad.withColumn("rn", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")))
    heads = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("event_id"))))
    return ranked.groupBy("event_type").agg(F.count("*").alias("n"), F.array_join(F.transform(heads, lambda x: x.cast("string")), ",").alias("examples"))


@query("""
SELECT workflow, role, count(*)::BIGINT AS n FROM (SELECT CASE WHEN heads IS NULL THEN 'combat_reference' ELSE 'account_import' END AS workflow,
  CASE WHEN heads IS NULL THEN 'combat' WHEN heads = 'de' THEN 'uid_panel' WHEN heads = 'fr' THEN 'equipment' ELSE 'account_unknown' END AS role
  FROM (SELECT source, substr(source, 4)::INT AS k, string_agg(DISTINCT lang, ',' ORDER BY lang) AS h FROM documents GROUP BY 1, 2), LATERAL (SELECT CASE WHEN k % 2 = 0 THEN h END AS heads)) GROUP BY ALL""")
def realigned_sources(spark, sf):
    """Live sources take the role of the only head of their records; the others become references."""
    heads = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("heads"))
    live = F.substring("source", 4, 9).cast("int") % 2 == 0
    one = F.when(F.size("heads") == 1, F.col("heads")[0])
    role = policy.cases([(one == "de", F.lit("uid_panel")), (one == "fr", F.lit("equipment"))], F.lit("account_unknown"))
    rows = heads.select(F.when(live, policy.ACCOUNT).otherwise(policy.COMBAT_FLOW).alias("workflow"), F.when(live, role).otherwise("combat").alias("role"))
    return rows.groupBy("workflow", "role").agg(F.count("*").alias("n"))
