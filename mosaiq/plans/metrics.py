"""Model-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import quality as Q
from mosaiq.plans.common import table
from mosaiq.plans.registry import query

SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (r = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (r = floor(0.9 * (n - 1))) AS p90, max(value) FILTER (r = floor(0.99 * (n - 1))) AS p99, max(value) AS most FROM r GROUP BY 1""")
def percentiles_floor(spark, sf):
    return Q.floor_percentiles(table(spark, sf, "events"), ["event_type"], "value", SHARES)


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def percentiles_linear(spark, sf):
    return Q.linear_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""
WITH r AS (SELECT ceil(least(value / 100, 1) * 15) AS bin, least(value / 100, 1)::DECIMAL(28, 9) AS conf, (user_id % 100 < value)::INT AS ok FROM events),
b AS (SELECT bin, sum(conf) AS conf, sum(ok) AS ok, count(*) AS n FROM r GROUP BY 1)
SELECT round(sum(CASE WHEN bin >= 1 THEN abs(ok - conf) ELSE 0 END)::DOUBLE / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b""")
def ece(spark, sf):
    conf = F.least(F.col("value") / 100, F.lit(1.0))
    return Q.calibration_error(table(spark, sf, "events"), conf, F.col("user_id") % 100 < F.col("value")).select(F.round("ece", 9).alias("ece"), "n")


@query("""
WITH r AS (SELECT quality AS t, CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars > 900 THEN 2 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
s AS (SELECT label, (SELECT count(*) FROM r WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM r WHERE t = label) AS actual, (SELECT count(*) FROM r WHERE p = label) AS said FROM l)
SELECT round(sum(tp) / sum(actual), 6) AS accuracy, round(avg(CASE WHEN said > 0 THEN tp / said ELSE 0 END::DECIMAL(28, 9))::DOUBLE, 6) AS precision, round(avg(CASE WHEN actual > 0 THEN tp / actual ELSE 0 END::DECIMAL(28, 9))::DOUBLE, 6) AS recall,
  round(avg(CASE WHEN actual + said > 0 THEN 2 * tp / (actual + said) ELSE 0 END::DECIMAL(28, 9))::DOUBLE, 6) AS f1 FROM s""")
def macro_f1(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    guess = F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") > 900, 2).otherwise(0)
    return Q.macro_scores(rows.select(F.col("quality").alias("t"), guess.alias("p")), "t", "p")


@query("""
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT *, sum(n) OVER () / greatest(n, 1) AS w FROM c)
SELECT label, n::BIGINT AS n, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def class_weights(spark, sf):
    return Q.class_weights(table(spark, sf, "embeddings"), "label")


@query("""
WITH t AS (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
e AS (SELECT v.vec_id, t.label, list_sum(list_transform(list_zip(v.embedding, t.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / 64 AS error FROM embeddings v, t),
r AS (SELECT *, row_number() OVER w AS rn, lead(error) OVER w - error AS margin FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY error, label))
SELECT vec_id, label, round(error, 6) AS error, round(margin, 6) AS margin FROM r WHERE rn = 1""")
def template_top2(spark, sf):
    """Nearest template of each vector and the margin to the next label."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("template"))
    out = Q.nearest_templates(rows.select("vec_id", "embedding"), "vec_id", "embedding", first, "label", "template")
    return out.select("vec_id", "label", F.round("error", 6).alias("error"), F.round("margin", 6).alias("margin"))


@query()
def phash_synthetic(spark, sf):
    """Perceptual hashes of small images made from vectors."""
    from mosaiq.operators import pixels

    return table(spark, sf, "embeddings").select("vec_id", pixels.phash(pixels.drawn("embedding")).alias("phash"))


@query()
def ssim_synthetic(spark, sf):
    """Structural similarity of each vector's image to that of its label's first vector."""
    from mosaiq.operators import pixels

    rows = table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", pixels.ssim(pixels.drawn("embedding"), pixels.drawn("first")).alias("ssim"))


@query()
def digit_bootstrap(spark, sf):
    """Labels recovered by a classifier that grows its trusted rows round by round."""
    from mosaiq.operators import models

    return models.bootstrap_labels(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
