"""Precedence of labels: which payload counts, which key names the label, and rows derived from labelled ones.

Payloads are maps of text here, as `variants` reads them out of documents: a value of another type is simply absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions.policy import filled

# Keys that name a label, in order.
AUDIT_KEYS = ["uid_full", "uid_digit", "agent_icon_id", "amplifier_id", "disc_set_id", "equipment_agent_id"]
IDENTITY_KEYS = ["agent_icon_id", "amplifier_id", "disc_set_id"]


def value(payload: Column, key: str) -> Column:
    return filled(F.try_element_at(payload, F.lit(key)))


def audit_label(payload: Column, head: Column) -> Column:
    """The first filled key; a plain `label` doesn't count for icons. '' if none."""
    return F.coalesce(*[value(payload, k) for k in AUDIT_KEYS], F.when(head != "agent_icon", value(payload, "label")), F.lit(""))


def digit_label(payload: Column) -> Column:
    """The one digit that a digit row is labelled with, from its own key or the plain label; '' if none."""
    one = lambda c: F.when(F.length(F.regexp_replace(c, "[^0-9]", "")) == 1, F.regexp_replace(c, "[^0-9]", ""))
    return F.coalesce(one(value(payload, "uid_digit")), one(value(payload, "label")), F.lit(""))


def plan_label(payload: Column, head: Column, canonical) -> Column:
    """Label for the sampling plan by head. canonical: column function for agents, '' or null where unknown."""
    named = F.coalesce(*[value(payload, k) for k in IDENTITY_KEYS])
    agent = F.when(named.isNotNull(), F.coalesce(filled(canonical(named)), F.lit("unknown")))
    other = F.coalesce(named, value(payload, "label"))
    return F.coalesce(F.when(head == "uid_digit", digit_label(payload)).when(head == "agent_icon", agent).otherwise(other), F.lit(""))


def chosen(labels: Column, suggested: Column, reviewed: Column, source: str) -> Column:
    """Payload to train on: 'reviewed' ones only, 'suggested' ones only, or the best there is. Null if none."""
    some = lambda m: F.when(F.coalesce(F.size(m), F.lit(0)) > 0, m)
    if source == "reviewed":
        return F.when(reviewed, labels)
    if source == "suggested":
        return some(suggested)
    return F.when(reviewed, labels).otherwise(F.coalesce(some(labels), some(suggested)))


def active(labels: Column, suggested: Column) -> Column:
    """Labels if any of their values is filled, else suggestions."""
    return F.when(F.coalesce(F.exists(F.map_values(labels), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(False)), labels).otherwise(F.coalesce(suggested, F.create_map().cast("map<string,string>")))


def training_sample(records: DataFrame, splits: DataFrame, head: str, payload: Column, label: Column, row_head: Column) -> DataFrame:
    """Rows of a head with label, split and a dense label index, and rows that were skipped with the reason: id, outcome, label,
    split, label_index. Rows of another head are left out. The index follows the labels' order, as trainers expect."""
    rows = records.withColumn("_p", payload).withColumn("_l", filled(label)).where((row_head == head) | payload.isNull())
    rows = rows.join(splits.withColumnRenamed("record_id", "id"), "id", "left")
    outcome = F.when(F.col("_p").isNull(), "no_payload").when(F.col("_l").isNull(), "no_label").when(F.col("split").isNull(), "no_split").when(filled(F.col("path")).isNull(), "no_path").otherwise("kept")
    rows = rows.withColumn("outcome", outcome)
    # A window over the distinct labels, of which a head has a few dozen.
    index = rows.where("outcome = 'kept'").select("_l").distinct().select("_l", (F.dense_rank().over(W.orderBy("_l")) - 1).alias("label_index"))
    return rows.join(index, "_l", "left").select("id", "outcome", F.col("_l").alias("label"), "split", F.when(F.col("outcome") == "kept", F.col("label_index")).alias("label_index"))


def derived(parents: DataFrame, pieces: Column, kind: str) -> DataFrame:
    """One row per piece of a parent: id `<parent>_<kind>_<nn>`, its label, and the way back. pieces: array of labels."""
    rows = parents.select("*", F.posexplode(pieces).alias("piece", "piece_label"))
    return rows.select(F.format_string(f"%s_{kind}_%02d", "id", "piece").alias("id"), F.lit(f"derived_{kind}").alias("kind"), F.col("piece_label").alias("label"), "piece", F.col("id").alias("derivedFromRecordId"), "sourceId", "sessionId")


def candidate_queries(name: Column, ident: Column, templates: list[str]) -> Column:
    """Search texts of an entity, in order; {name} and {id} stand for its own."""
    return F.array(*[F.replace(F.replace(F.lit(t), F.lit("{name}"), name), F.lit("{id}"), ident) for t in templates])


def suspicious_id(ident: Column) -> Column:
    """Ids that recognition noise made."""
    t = F.coalesce(F.trim(ident), F.lit(""))
    return (t == "") | F.endswith(t, F.lit("_o")) | F.startswith(t, F.lit("amp_o_")) | t.isin([f"amp_{x}" for x in ("i", "ii", "iii", "iv", "v", "vi", "mew", "new")])


def suspicious_name(name: Column) -> Column:
    t = F.lower(F.coalesce(F.trim(name), F.lit("")))
    return (t == "") | t.isin("i", "ii", "iii", "iv", "v", "vi") | F.endswith(t, F.lit(" o"))


def alias_quality(ident: Column, name: Column) -> Column:
    return F.when(suspicious_id(ident), 0).otherwise(100) + F.when(suspicious_name(name), 0).otherwise(20) + F.least(F.length(F.coalesce(ident, F.lit(""))), F.lit(40))


def safe_prediction(value_: Column, error: Column, margin: Column, rules: dict[str, tuple[float, float]]) -> Column:
    """Whether a prediction passes its own row of a rule table: value -> (most error, least margin). Missing figures fail."""
    out = F.lit(False)
    for k, (most, least) in rules.items():
        out = F.when(value_ == k, (F.coalesce(error, F.lit(1.0)) <= most) & (F.coalesce(margin, F.lit(0.0)) >= least)).otherwise(out)
    return out
