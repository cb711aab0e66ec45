"""Text parsing and entity resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import policy, texts
from mosaiq.operators import entity as E
from mosaiq.plans.common import table
from mosaiq.plans.registry import query

NAME = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' [3]' WHEN 1 THEN ' Slot 2' WHEN 2 THEN ' / W-Engine' ELSE ' NEW' END"
SQL_DISPLAY = f"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({NAME})), '&', ' and '), '[/_]', ' ', 'g'),
  '\\s*\\[[1-6]\\]\\s*$', ''), '\\s*\\((?:slot|disc|disk)\\s*[1-6]\\)\\s*$', ''), '\\s*slot\\s*[1-6]\\s*$', '')), 'w[- ]engine', 'wengine', 'g'), '[^0-9a-zA-Z+\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"SELECT p_partkey, {SQL_DISPLAY} AS name_key FROM part")
def display_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", texts.display_key(F.expr(NAME.replace("||", "||")), ascii_only=True).alias("name_key"))


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({SQL_DISPLAY}, '-', ' '), '\\bnew\\b', ' ', 'g'), '^[^0-9a-z]+', ' '), '^[a-z]\\s+', ' '),
  '^[0-9]+\\s+', ' '), '\\b(?:yp|lv)[a-z0-9/.-]*\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS alias_key FROM part""")
def alias_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", texts.alias_key(F.expr(NAME), ascii_only=True).alias("alias_key"))


def brand_dimension(spark, sf):
    """Brands as a dimension with aliases: the brand itself and its part types by frequency order."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return brands.select(F.col("p_brand").alias("ident"), number.alias("ordinal"), F.array(F.col("p_brand"), F.concat(F.lit("maker "), (number % 7).cast("string"))).alias("aliases"))


@query("""
WITH d AS (SELECT DISTINCT p_brand AS id, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS ordinal FROM part),
x AS (SELECT id, ordinal, 0 AS pos, lower(id) AS alias FROM d UNION ALL SELECT id, ordinal, 1, 'maker ' || ordinal % 7 FROM d),
i AS (SELECT alias, id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY ordinal, pos) AS rn FROM x) WHERE rn = 1),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) END AS k0, 'maker ' || p_size AS k1, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) END AS k2 FROM part)
SELECT p_partkey, coalesce(a.id, b.id, c.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'raw' WHEN b.id IS NOT NULL THEN 'maker' WHEN c.id IS NOT NULL THEN 'brand' END AS mode,
  CASE WHEN a.id IS NOT NULL THEN 0.995 WHEN b.id IS NOT NULL THEN 0.93 WHEN c.id IS NOT NULL THEN 0.78 ELSE 0.0 END::DOUBLE AS confidence
FROM r LEFT JOIN i a ON a.alias = k0 LEFT JOIN i b ON b.alias = k1 LEFT JOIN i c ON c.alias = k2""")
def entity_cascade(spark, sf):
    """Alias lookups in order of trust."""
    index = E.alias_index(brand_dimension(spark, sf), "ident", "aliases", lambda c: F.lower(F.trim(c)))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    brand = F.lower("p_brand")
    stages = [
        ("raw", F.when(F.col("p_partkey") % 3 == 0, brand), index, 0.995),
        ("maker", F.concat(F.lit("maker "), F.col("p_size").cast("string")), index, 0.93),
        ("brand", F.when(F.col("p_partkey") % 2 == 0, brand), index, 0.78),
    ]
    return E.staged(rows, stages).select("p_partkey", "id", "mode", "confidence")


def titles(spark, sf):
    """Misread customer names and the nation names that they may mean."""
    read = table(spark, sf, "nation").select(F.explode(F.array(F.translate("n_name", "AEIO", "4310"), F.expr("substring(n_name, 2, 99)"), F.concat("n_name", F.lit(" X")), F.reverse("n_name"))).alias("title"))
    read = read.select(F.lower("title").alias("title")).distinct()
    return read, table(spark, sf, "nation").select(F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("id"))


@query()
def fuzzy_top2(spark, sf):
    """Best alias by the share of matching characters, with threshold and margin."""
    read, known = titles(spark, sf)
    return E.fuzzy_best(read, "title", known, 0.72, 0.05)


@query("""
WITH t AS (SELECT DISTINCT lower(unnest([translate(n_name, 'AEIO', '4310'), substr(n_name, 2), n_name || ' X', reverse(n_name)])) AS title FROM nation),
s AS (SELECT title, n_nationkey AS id, lower(n_name) AS alias, 1 - levenshtein(title, lower(n_name)) / greatest(length(title), length(n_name))::DOUBLE AS score FROM t, nation),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY title ORDER BY score DESC, alias))
SELECT title, id, round(score, 6) AS score FROM r WHERE rn = 1 AND score >= 0.6 AND score - second >= 0.05""")
def fuzzy_levenshtein(spark, sf):
    read, known = titles(spark, sf)
    return E.fuzzy_best(read, "title", known, 0.6, 0.05, "edits").select("title", "id", F.round("score", 6).alias("score"))


RAW_UID = "CASE event_id % 4 WHEN 0 THEN 'uid ' || (1000000000 + event_id * 7919) WHEN 1 THEN (10000 + event_id) || '-' || (20000 + user_id) WHEN 2 THEN 'x' || (100000000000 + event_id) ELSE event_type END"


@query(f"""
WITH r AS (SELECT event_id, {RAW_UID} AS t FROM events), d AS (SELECT *, regexp_extract(t, '(?:^|[^0-9])([0-9]{{10}})(?:[^0-9]|$)', 1) AS f, regexp_replace(t, '[^0-9]', '', 'g') AS g FROM r)
SELECT event_id, CASE WHEN f <> '' THEN f WHEN length(g) = 10 THEN g ELSE '' END AS uid, CASE WHEN length(g) BETWEEN 6 AND 12 THEN g ELSE '' END AS digits FROM d""")
def uid_extract(spark, sf):
    raw = F.expr(RAW_UID)
    return table(spark, sf, "events").select("event_id", texts.uid_from_text(raw).alias("uid"), texts.uid_digits(raw).alias("digits"))


RAW_LEVEL = "CASE event_id % 5 WHEN 0 THEN (event_id % 65) || '/' || (event_id % 7 * 10) WHEN 1 THEN (10 + event_id % 60) || '60' WHEN 2 THEN (event_id % 10) || 'O' || '/6O' WHEN 3 THEN '6O' || (event_id % 10) || '60' ELSE event_id::STRING END"


@query(f"""
WITH r AS (SELECT event_id, translate(translate({RAW_LEVEL.replace("STRING", "VARCHAR")}, 'OoIiLl', '001111'), '|', '/') AS t FROM events),
d AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS g FROM r),
p AS (SELECT event_id, CASE WHEN contains(t, '/') THEN regexp_replace(split_part(t, '/', 1), '[^0-9]', '', 'g') WHEN length(g) = 3 AND substr(g, 2, 2) IN ('10', '20', '30', '40', '50', '60') THEN CASE WHEN g[1] = '0' THEN g[2] ELSE g[1] END
    WHEN length(g) IN (4, 5) THEN substr(g, 1, 2) WHEN length(g) = 6 THEN substr(g, 1, 3) ELSE '' END AS l,
  CASE WHEN contains(t, '/') THEN regexp_replace(split_part(t, '/', 2), '[^0-9]', '', 'g') WHEN length(g) = 3 AND substr(g, 2, 2) IN ('10', '20', '30', '40', '50', '60') THEN substr(g, 2, 2)
    WHEN length(g) = 4 THEN substr(g, 3, 2) WHEN length(g) = 5 THEN substr(g, 4, 2) WHEN length(g) = 6 THEN substr(g, 4, 3) ELSE '' END AS r FROM d),
n AS (SELECT event_id, try_cast(l AS INT) AS a, try_cast(r AS INT) AS b FROM p)
SELECT event_id, CASE WHEN a > 0 AND b IN (10, 20, 30, 40, 50, 60) AND a <= b THEN a END AS current, CASE WHEN a > 0 AND b IN (10, 20, 30, 40, 50, 60) AND a <= b THEN b END AS cap FROM n""")
def level_pair(spark, sf):
    pair = texts.level_pair(F.expr(RAW_LEVEL))
    return table(spark, sf, "events").select("event_id", pair["current"].alias("current"), pair["cap"].alias("cap"))


@query("""
WITH t AS (SELECT page_id, list_filter(regexp_split_to_array(lower(url), '[^0-9a-zЀ-ӿ]+'), lambda x: x <> '') AS tokens, lower(url) AS u FROM pages)
SELECT page_id, len(tokens)::INT AS n_tokens, CASE WHEN list_has_any(tokens, ['ru', 'rus', 'russian']) THEN 'RU' WHEN list_has_any(tokens, ['en', 'eng', 'english']) THEN 'EN' ELSE 'UNKNOWN' END AS locale,
  CASE WHEN regexp_matches(u, '\\buid\\b|profile') THEN 'uid_panel' WHEN regexp_matches(u, 'roster|agent_menu|agents_menu') THEN 'roster' WHEN regexp_matches(u, 'mindscape|cinema|\\bmind\\b') THEN 'mindscape'
    WHEN regexp_matches(u, 'amplificator|amplifier|w_engine|wengine') THEN 'amplifier_detail' WHEN regexp_matches(u, '\\bdis[ck][_\\-\\s]*[1-6]\\b') THEN 'disk_detail'
    WHEN regexp_matches(u, 'agent_detail|characteristics|stats') THEN 'agent_detail' WHEN regexp_matches(u, '\\bequipment\\b|loadout|gear') THEN 'equipment' END AS role FROM t""")
def path_tokens_locale(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.size(policy.path_tokens(url)).alias("n_tokens"), policy.path_locale(url).alias("locale"), policy.path_role(url).alias("role"))


SQL_CELL = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, '<tr><td>' || page_id || '</td><td>' || {SQL_CELL.format('url')} || '</td><td>' || {SQL_CELL.format('html')} || '</td></tr>' AS row FROM pages")
def html_escape_export(spark, sf):
    cells = [texts.html_cell(c) for c in (F.col("page_id"), F.col("url"), F.col("html"))]
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>")).alias("row"))


@query("""
SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(props, '$.k')::DOUBLE END AS k, json_type(props, '$.missing') IS NOT NULL AS has_missing FROM events""")
def json_props(spark, sf):
    """Typed getters: only a number counts as a number."""
    from mosaiq.functions import variants

    doc = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", variants.as_number(doc, "$.k").alias("k"), F.try_variant_get(doc, "$.missing", "variant").isNotNull().alias("has_missing"))


@query("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS slots FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_contains(slots, 1) AS s1, list_contains(slots, 2) AS s2, list_contains(slots, 3) AS s3, list_contains(slots, 4) AS s4, list_contains(slots, 5) AS s5, list_contains(slots, 6) AS s6,
  NOT list_has_any(slots, [1, 2, 3, 4, 5, 6]) AS all_empty FROM s""")
def occupancy_map(spark, sf):
    slots = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("slots")).withColumn("m", texts.occupancy(F.col("slots")))
    return slots.select("l_orderkey", *[F.col("m")[str(k)].alias(f"s{k}") for k in range(1, 7)], texts.all_empty(F.col("m")).alias("all_empty"))


@query("""
SELECT p_partkey, trim(regexp_replace(replace(lower(trim(p_name)), '&', ' and '), '[^0-9a-z]+', '_', 'g'), '_') AS slug,
  CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN true ELSE false END AS corrupted FROM part""")
def slugs(spark, sf):
    spoiled = F.when(F.col("p_size") % 5 == 0, "????? [1]").when(F.col("p_size") % 5 == 1, "a?b?c?").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", texts.slug(F.col("p_name"), ascii_only=True).alias("slug"), texts.looks_corrupted(spoiled).alias("corrupted"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+' || round(value, 1) || ' %' WHEN 1 THEN replace(round(value, 2)::VARCHAR, '.', ',') WHEN 2 THEN 'n/a' ELSE ' ' || event_id || ' ' END AS t, value FROM events)
SELECT event_id, round(try_cast(replace(regexp_replace(trim(t), '[%+\\s]', '', 'g'), ',', '.') AS DOUBLE), 4) AS number, least(1, greatest(0, (value - 1) / 59.0)) AS part FROM r""")
def number_coercion(spark, sf):
    raw = "CASE event_id % 4 WHEN 0 THEN '+' || round(value, 1) || ' %' WHEN 1 THEN replace(cast(round(value, 2) AS STRING), '.', ',') WHEN 2 THEN 'n/a' ELSE ' ' || event_id || ' ' END"
    return table(spark, sf, "events").select("event_id", texts.number(F.expr(raw)).alias("number"), texts.fraction(F.col("value"), 1.0, 60.0).alias("part"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 2 = 0 THEN 'en-US' ELSE 'ru' END AS tag FROM orders""")
def dates_and_tags(spark, sf):
    compact = F.when(F.col("o_orderkey") % 3 == 0, "2024-13").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    tag = texts.language_tag(F.when(F.col("o_orderkey") % 2 == 0, " en ").otherwise("RU"))
    return table(spark, sf, "orders").select("o_orderkey", texts.iso_utc(F.col("o_orderdate")).alias("at"), texts.compact_date(compact).alias("day"), tag.alias("tag"))


@query("""SELECT source, string_agg(v, '|' ORDER BY i) AS focus FROM (SELECT DISTINCT source, unnest(['a' || substr(source, 4), 'b', 'c']) AS v, unnest([1, 2, 3]) AS i FROM documents) GROUP BY source""")
def focus_notes(spark, sf):
    note = F.concat(F.lit("public video; focus=a"), F.substring("source", 4, 9), F.lit(", b|c ;x"))
    return table(spark, sf, "documents").select("source").distinct().select("source", F.array_join(texts.focus_values(note), "|").alias("focus"))
