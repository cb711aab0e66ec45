"""The corpus queries of the entry point: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import avi, decontam, mix, neardup, pii, quality, tokens, toxicity, urls, warc
from mosaiq.llm.common import table


#: Host, path, and whether URLs under them are allowed.
URL_RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("score", "p_reject")})


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=1000)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_avi": op4_avi,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def inverse_sql(knots: tuple[tuple[float, float], ...], share: str) -> str:
    """The time at which a schedule has wanted a share of its words, as SQL."""
    real = lambda x: f"{x!r}::DOUBLE"
    whole = sum((r0 + r1) * (t1 - t0) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False))
    out, done = "", 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        area, slope = f"({share} * {real(whole)} - {real(done)})", (r1 - r0) / (t1 - t0)
        x = f"{area} / {real(r0)}" if abs(slope) < 1e-12 else f"(sqrt(greatest({real(r0 * r0)} + {real(2 * slope)} * {area}, 0.0::DOUBLE)) - {real(r0)}) / {real(slope)}"
        done += (r0 + r1) * (t1 - t0) / 2
        out += f" WHEN {share} * {real(whole)} <= {real(done)} THEN least({real(t1)}, greatest({real(t0)}, {real(t0)} + {x}))"
    return f"CASE{out} ELSE {real(knots[-1][0])} END"


def url_sql() -> str:
    """The twin of the URL filter: the same counts and smoothing, order by order."""
    k_all, sides = range(1, urls.ORDER + 1), ("good", "bad")
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    allowed = " ".join(f"WHEN {fits(h, p)} THEN {str(a).lower()}" for h, p, a in ordered)
    seed = " OR ".join(f"contains(host, '{w}')" for w in urls.SEEDS)
    parts = [
        rf"r AS (SELECT page_id, coalesce(url, '') AS text, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"q AS (SELECT *, CASE {rule} END AS rule, CASE {allowed} END AS allowed FROM r)",
        f"u AS (SELECT text, bool_and(kind) AS kind FROM (SELECT text, CASE WHEN {seed} THEN false WHEN coalesce(allowed, true) THEN true END AS kind FROM q) GROUP BY text)",
        f"x AS (SELECT *, ('0x' || substr(md5(text), 1, 8))::BIGINT % 5 = 0 AS held, repeat(chr(2), {urls.ORDER}) || text || chr(3) AS padded FROM u)",
        f"c AS (SELECT text, kind, held, substr(padded, k::INT, {urls.ORDER + 1}) AS gram FROM x, range(1, length(text) + 2) t(k))",
        "g AS (SELECT gram, count_if(NOT held AND coalesce(kind, false)) AS good, count_if(NOT held AND NOT coalesce(kind, true)) AS bad FROM c GROUP BY gram)",
        f"l AS (SELECT substr(gram, {urls.ORDER + 1}, 1) AS gram, sum(good) AS good, sum(bad) AS bad FROM g GROUP BY 1)",
        "z AS (SELECT 1.0::DOUBLE / (count(*) + 1) AS floor, " + ", ".join(f"sum({c}) AS n_{c}, greatest(count_if({c} > 0), 1) AS d_{c}" for c in sides) + " FROM l)",
        "p0 AS (SELECT gram, " + ", ".join(f"({c} + d_{c} * floor) / (n_{c} + d_{c})::DOUBLE AS p_{c}" for c in sides) + " FROM l, z)",
    ]
    for k in k_all:
        parts += [
            f"h{k} AS (SELECT substr(gram, {urls.ORDER + 1 - k}, {k + 1}) AS gram, sum(good) AS good, sum(bad) AS bad FROM g GROUP BY 1)",
            f"n{k} AS (SELECT substr(gram, 1, {k}) AS ctx, " + ", ".join(f"sum({c}) AS n_{c}, count_if({c} > 0) AS d_{c}" for c in sides) + f" FROM h{k} GROUP BY 1)",
            f"p{k} AS (SELECT h.gram, " + ", ".join(f"CASE WHEN n_{c} > 0 THEN ({c} + d_{c} * p_{c}) / (n_{c} + d_{c})::DOUBLE ELSE p_{c} END AS p_{c}" for c in sides) + f" FROM h{k} h JOIN n{k} n ON n.ctx = substr(h.gram, 1, {k}) JOIN p{k - 1} p ON p.gram = substr(h.gram, 2, {k}))",
        ]
    parts += [
        f"e AS (SELECT gram, round((ln(p_good) - ln(p_bad)) * 1000000)::BIGINT AS gain FROM p{urls.ORDER})",
        "s AS (SELECT text, any_value(kind) AS kind, any_value(held) AS held, sum(gain) / count(*) / 1000000 AS score FROM c JOIN e USING (gram) GROUP BY text)",
        "m AS (SELECT avg(score) FILTER (kind) AS mg, avg(score) FILTER (NOT kind) AS mb, (coalesce(var_pop(score) FILTER (kind), 0) * count_if(kind) + coalesce(var_pop(score) FILTER (NOT kind), 0) * count_if(NOT kind)) / count(*) AS v FROM s WHERE held AND kind IS NOT NULL)",
    ]
    p_reject = "CASE WHEN mg IS NULL OR mb IS NULL THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-greatest(least(((score - mg) ** 2 - (score - mb) ** 2) / (2 * greatest(v, 0.0001)), 35.0::DOUBLE), -35.0::DOUBLE))) END"
    parts += [f"j AS (SELECT q.*, score, {p_reject} AS p_reject FROM q JOIN s USING (text), m)"]
    verdict = "CASE WHEN coalesce(allowed, p_reject <= 0.5) THEN 'allow' ELSE 'block' END"
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, host, path, rule, {verdict} AS verdict, round(score, 4) + 0.0::DOUBLE AS score, round(p_reject, 4) + 0.0::DOUBLE AS p_reject FROM j"


#: Rounds of resharing in the twin of the mix; more than any table of sources of the tests needs.
RESHARES = 60
SQL_POSITION = "CASE o % {n} {whens} END".format(n=len(mix.SCHEDULES), whens=" ".join(f"WHEN {k} THEN {inverse_sql(s, '(middle / target)')}" for k, s in enumerate(mix.SCHEDULES)))

ORACLES: dict[str, str] = {
    "op1_mix": rf"""
WITH RECURSIVE b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
d AS (SELECT *, ('0x' || substr(mark, 1, 10))::BIGINT / 1099511627776::DOUBLE AS draw FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS o FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[o % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
lv AS (SELECT 0 AS i, 0.0::DOUBLE AS level UNION ALL
  SELECT i + 1, coalesce((SELECT ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) FILTER (cap < lv.level * weight), 0.0)) / nullif(sum(weight) FILTER (NOT cap < lv.level * weight), 0) FROM w), level) FROM lv WHERE i < {RESHARES}),
t AS (SELECT w.*, least(cap, (SELECT level FROM lv WHERE i = {RESHARES}) * weight) AS target FROM w),
m AS (SELECT d.*, source_size, o, target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, mark ROWS UNBOUNDED PRECEDING) - size / 2::DOUBLE AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size > 0 AND target > middle THEN least(ceil((target - middle) / source_size)::INT, 3) ELSE 0 END AS copies FROM m)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, CASE WHEN copies > 0 THEN {SQL_POSITION} END AS position FROM c""",
    "op2_url_filter": url_sql(),
    "op6_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.b FROM reach r JOIN edges e ON e.a = r.o),
comp AS (SELECT d, min(o) AS c FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents JOIN comp ON d = doc_id LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)""",
}
