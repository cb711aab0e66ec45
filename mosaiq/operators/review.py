"""Review labels: rows of a review sheet become validated label structs; what is wrong is told in `errors`, not thrown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import texts
from mosaiq.functions.policy import cases, filled, first_text, text

#: Keys of statistics.
STAT_KEYS = "anomaly_mastery anomaly_proficiency attack_flat attack_pct crit_damage_pct crit_rate_pct defense_flat defense_pct energy_regen hp_flat hp_pct ice_damage_bonus_pct impact pen_flat pen_ratio_pct".split()


class Checked:
    """A value and the texts of what is wrong with it."""

    def __init__(self, value: Column, *errors: Column):
        self.value, self.errors = value, list(errors)


def told(rule: Column, name: str) -> Column:
    return F.when(F.coalesce(rule, F.lit(False)), F.lit(name))


def uid(raw: Column, *fallbacks: Column) -> Checked:
    digits = F.regexp_replace(first_text(raw, *fallbacks), "[^0-9]", "")
    n = F.length(digits)
    return Checked(F.when(n.between(6, 12), digits), told(n == 0, "uid_full_required"), told((n > 0) & ~n.between(6, 12), "uid_full_must_have_6_to_12_digits"))


def whole(raw: Column, field: str, low: int, high: int, fallback: Column | None = None) -> Checked:
    source = F.coalesce(filled(raw), filled(fallback.cast("string"))) if fallback is not None else filled(raw)
    number = texts.number(source)
    ok = number.isNotNull() & (number == F.floor(number)) & number.between(low, high)
    return Checked(F.when(ok, number.cast("int")), told(source.isNotNull() & ~F.coalesce(ok, F.lit(False)), f"{field}_must_be_{low}_to_{high}"))


def level_pair(current: Column, cap: Column, field: str, fallback: tuple[Column, Column] | None = None) -> tuple[Checked, Checked]:
    """Both or none, from 0 to 99, current at most cap."""
    a = whole(current, f"{field}_current", 0, 99, fallback and fallback[0])
    b = whole(cap, f"{field}_max", 0, 99, fallback and fallback[1])
    a.errors += [told(a.value.isNull() != b.value.isNull(), f"{field}_pair_incomplete"), told(a.value > b.value, f"{field}_current_above_max")]
    return a, b


def value(raw: Column, field: str) -> Checked:
    n = texts.number(filled(raw))
    return Checked(n, told(n.isNull(), f"{field}_must_be_numeric"))


def stat_key(raw: Column, field: str) -> Checked:
    ok = texts.stat_key_valid(F.trim(raw), STAT_KEYS)
    return Checked(F.when(ok, F.trim(raw)), told(~ok, f"invalid_{field}"))


def known(raw: Column, index: dict[str, str] | Column, field: str, required: bool = True) -> Checked:
    """A canonical id. index: a column that holds it (from a lookup join), or a small map of aliases."""
    ident = index if isinstance(index, Column) else cases([(F.lower(F.trim(raw)) == k, F.lit(v)) for k, v in index.items()], F.lit(None).cast("string"))
    wrong = ident.isNull() if required else (text(raw) != "") & ident.isNull()
    return Checked(ident, told(wrong, f"invalid_{field}"))


def stat_map(raw: Column, field: str = "agent_stats_json") -> Checked:
    """JSON object of known keys and numbers."""
    parsed = F.from_json(raw, "map<string,string>")
    given = text(raw) != ""
    bad = F.exists(F.map_entries(parsed), lambda e: ~texts.stat_key_valid(F.trim(e["key"]), STAT_KEYS) | texts.number(e["value"]).isNull())
    clean = F.transform_values(parsed, lambda k, v: texts.number(v))
    return Checked(F.when(given & parsed.isNotNull() & ~bad, clean), told(given & parsed.isNull(), f"{field}_must_be_an_object"), told(given & bad, f"{field}_invalid"))


def substats(raw: Column, field: str = "disc_substats_json") -> Checked:
    """JSON list of {key, value}."""
    parsed = F.from_json(raw, "array<struct<key:string,value:string>>")
    given = text(raw) != ""
    bad = F.exists(parsed, lambda e: e.isNull() | ~texts.stat_key_valid(F.trim(e["key"]), STAT_KEYS) | texts.number(e["value"]).isNull())
    clean = F.transform(parsed, lambda e: F.struct(F.trim(e["key"]).alias("key"), texts.number(e["value"]).alias("value")))
    return Checked(F.when(given & parsed.isNotNull() & ~bad, clean), told(given & parsed.isNull(), f"{field}_must_be_a_list"), told(given & bad, f"{field}_invalid"))


def disc_summary(raw: Column, set_names: dict[str, str], field: str = "equipment_disc_summary_json") -> Checked:
    """JSON list of {slot, setId or setName, level, levelCap}, sorted by slot. set_names: key of an alias -> id."""
    parsed = F.from_json(raw, "array<struct<slot:string,setId:string,setName:string,level:string,levelCap:string>>")
    given = text(raw) != ""
    ident = lambda e: cases([(F.lower(first_text(e["setId"], e["setName"])) == k, F.lit(v)) for k, v in set_names.items()], F.lit(None).cast("string"))
    slot = lambda e: texts.number(e["slot"]).cast("int")
    level, cap = (lambda e: texts.number(e["level"])), (lambda e: texts.number(e["levelCap"]))
    bad = F.exists(parsed, lambda e: e.isNull() | ~F.coalesce(slot(e).between(1, 6), F.lit(False)) | ident(e).isNull() | (level(e).isNull() != cap(e).isNull()) | F.coalesce(level(e) > cap(e), F.lit(False)))
    clean = F.array_sort(F.transform(parsed, lambda e: F.struct(slot(e).alias("slot"), ident(e).alias("setId"), level(e).alias("level"), cap(e).alias("levelCap"))))
    return Checked(F.when(given & parsed.isNotNull() & ~bad, clean), told(given & parsed.isNull(), f"{field}_must_be_a_list"), told(given & bad, f"{field}_invalid"))


def labelled(rows: DataFrame, role: Column, forms: dict[str, dict[str, Checked]]) -> DataFrame:
    """Adds one nullable struct per role, `errors` (joined by ';') of the row's own role, and `status`: reviewed, or needs_review if
    anything is wrong. Roles without a form only keep their provenance."""
    out, errors = rows, F.lit("")
    for name, fields in reversed(forms.items()):
        errors = F.when(role == name, F.concat_ws(";", *[e for c in fields.values() for e in c.errors])).otherwise(errors)
    for name, fields in forms.items():
        out = out.withColumn(name, F.when(role == name, F.struct(*[c.value.alias(f) for f, c in fields.items()])))
    return out.withColumn("errors", errors).withColumn("status", F.when(errors == "", "reviewed").otherwise("needs_review"))


def applied(records: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Review rows against records: key, outcome (applied, invalid, missing). Rows without a key are left out."""
    rows = reviews.where(text(F.col(key)) != "").select(key, "errors")
    met = rows.join(records.select(key).distinct().withColumn("there", F.lit(True)), key, "left")
    return met.select(key, F.when(F.col("there").isNull(), "missing").when(F.col("errors") != "", "invalid").otherwise("applied").alias("outcome"))


def demoted(suggestions: Column, labels: Column, protected: list[str]) -> Column:
    """Labels merged into suggestions, later wins; protected keys stay out. Maps of equal types."""
    moved = F.map_filter(labels, lambda k, v: ~k.isin(protected))
    return F.map_zip_with(suggestions, moved, lambda k, a, b: F.coalesce(b, a))


def owned_lists(owned: DataFrame, key: str, ident: str, roster: Column) -> DataFrame:
    """Per session the owned ids in roster order, the rest of the roster, and unknown ids. roster: see reports.roster_array."""
    mine = owned.groupBy(key).agg(F.collect_set(ident).alias("mine"))
    unknown = F.array_join(F.array_sort(F.transform(F.array_except("mine", roster), lambda x: x.cast("string"))), ";")
    return mine.select(key, F.array_intersect(roster, "mine").alias("owned"), F.array_except(roster, "mine").alias("not_owned"), unknown.alias("unknown"))
