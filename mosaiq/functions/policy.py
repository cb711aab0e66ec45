"""Dataset policy as column builders: workflow, screen role, eligible heads, locale, resolution, predicates.

Text is compared after trimming, and null equals blank, as throughout the data model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and rule tables of the data model.
ACCOUNT, COMBAT_FLOW, ANY = "account_import", "combat_reference", "any"
ROLE_HEADS = {
    "uid_panel": ["uid_digit"],
    "roster": ["agent_icon"],
    "agent_detail": ["agent_icon"],
    "equipment": ["agent_icon", "equipment"],
    "disk_detail": ["equipment"],
    "amplifier_detail": ["equipment"],
    "account_unknown": ["agent_icon", "equipment", "uid_digit"],
}
HEAD_ROLE = {"uid_digit": "uid_panel", "agent_icon": "agent_detail", "equipment": "equipment"}
ACCOUNT_TAGS = "profile roster account inventory equipment uid agent_detail stats disc disk disc_detail disk_detail amplifier amplificator w_engine mindscape cinema".split()
#: Tags of each role, in the order in which roles are tried.
ROLE_TAGS = [
    ("uid_panel", ["uid", "profile"]),
    ("roster", ["roster"]),
    ("mindscape", ["mindscape", "cinema"]),
    ("amplifier_detail", ["amplifier", "amplificator", "w_engine"]),
    ("disk_detail", ["disc_detail", "disk_detail", "disc", "disk"]),
    ("equipment", ["equipment", "inventory"]),
    ("agent_detail", ["agent_detail", "agent", "stats"]),
]
#: Substrings of a lower-cased path that tell a role, in the order in which they are tried.
PATH_ROLES = [
    ("uid_panel", r"\buid\b|profile"),
    ("roster", "roster|agent_menu|agents_menu"),
    ("mindscape", r"mindscape|cinema|\bmind\b"),
    ("amplifier_detail", "amplificator|amplifier|w_engine|wengine"),
    ("disk_detail", r"\bdis[ck][_\-\s]*[1-6]\b"),
    ("agent_detail", "agent_detail|characteristics|stats"),
    ("equipment", r"\bequipment\b|loadout|gear"),
]


def text(c: Column) -> Column:
    """Trimmed text; null becomes blank."""
    return F.coalesce(F.trim(c), F.lit(""))


def filled(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns], F.lit(""))


def text_list(items: Column) -> Column:
    """Trimmed, non-blank entries of a list; null becomes empty."""
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The first pair whose condition holds."""
    return reduce(lambda out, p: F.when(p[0], p[1]).otherwise(out), reversed(pairs), otherwise)


def source_workflow(workflow: Column, source_id: Column, source_type: Column, tags: Column) -> Column:
    tags = F.transform(text_list(tags), F.lower)
    account = F.startswith(text(source_id), F.lit("live_session_")) | F.arrays_overlap(tags, words(ACCOUNT_TAGS)) | (F.lower(text(source_type)) == "live-capture")
    return F.coalesce(filled(workflow), F.when(account, F.lit(ACCOUNT)).otherwise(COMBAT_FLOW))


def source_role(role: Column, workflow: Column, tags: Column) -> Column:
    """workflow: as inferred by source_workflow."""
    tags = F.transform(text_list(tags), F.lower)
    rules = [(F.arrays_overlap(tags, words(t)), F.lit(r)) for r, t in ROLE_TAGS]
    inferred = cases(rules, F.when(workflow == ACCOUNT, F.lit("account_unknown")).otherwise("combat"))
    return F.coalesce(filled(role), inferred)


def role_heads(role: Column) -> Column:
    return cases([(role == r, words(h)) for r, h in ROLE_HEADS.items()], F.array().cast("array<string>"))


def eligible_heads(explicit: Column, role: Column) -> Column:
    explicit = text_list(explicit)
    return F.when(F.size(explicit) > 0, explicit).otherwise(role_heads(role))


def head_role(head: Column) -> Column:
    return cases([(text(head) == h, F.lit(r)) for h, r in HEAD_ROLE.items()], F.lit("account_unknown"))


def record_head(head: Column, label_head: Column, suggested_head: Column) -> Column:
    return F.coalesce(filled(head), filled(label_head), filled(suggested_head), F.lit("unknown"))


def record_workflow(own: Column, of_source: Column) -> Column:
    """of_source: null if the source is missing."""
    return F.coalesce(filled(own), of_source, F.lit(COMBAT_FLOW))


def record_role(own: Column, of_source: Column, head: Column) -> Column:
    """A missing source infers combat; an unknown account screen takes its head's default."""
    role = F.coalesce(of_source, F.lit("combat"))
    return F.coalesce(filled(own), F.when(role != "account_unknown", role), head_role(head))


def import_eligible(workflow: Column, heads: Column, head: Column) -> Column:
    return (workflow == ACCOUNT) & F.array_contains(heads, head)


def in_scope(workflow: Column, wanted: str, eligible: Column | None = None) -> Column:
    """Blank or 'any' matches all; with eligible, only import-eligible rows."""
    wanted = (wanted or ANY).strip().lower()
    out = F.lit(True) if wanted in ("", ANY) else F.lower(workflow) == wanted
    return out & eligible if eligible is not None else out


def reviewed(status: Column, has_final: Column) -> Column:
    return (F.lower(text(status)) == "reviewed") & has_final


def locale(value: Column, default: str = "RU") -> Column:
    v = F.upper(text(value))
    return F.when(v.isin("RU", "EN", "UNKNOWN", "MIXED", "AUTO"), v).otherwise(default)


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "[^0-9a-zЀ-ӿ]+"), lambda x: x != "")


def path_locale(path: Column, default: str = "UNKNOWN") -> Column:
    """RU is tried before EN. Tokens are cut at hyphens, so only the bare parts of hyphenated hints can match."""
    tokens = path_tokens(path)
    return F.when(F.arrays_overlap(tokens, words(["ru", "rus", "russian"])), F.lit("RU")).when(F.arrays_overlap(tokens, words(["en", "eng", "english"])), F.lit("EN")).otherwise(default)


def path_role(path: Column) -> Column:
    """Null: unclassified."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return cases([(F.rlike(low, F.lit(p)), F.lit(r)) for r, p in PATH_ROLES], F.lit(None).cast("string"))


def resolution(width: Column, height: Column) -> Column:
    known = (width > 0) & (height > 0)
    return (
        F.when((width >= 2560) | (height >= 1440), F.lit("1440p"))
        .when((width >= 1920) | (height >= 1080), F.lit("1080p"))
        .when(known, F.concat(width.cast("string"), F.lit("x"), height.cast("string")))
        .otherwise("unknown")
    )


def group_key(source_id: Column, session_id: Column, match_id: Column, record_id: Column, uid: Column, uid_kept_together: Column) -> Column:
    """Rows that must share a split: those of one ten-digit uid, else of a session, a match, or the row alone."""
    digits = F.regexp_replace(F.coalesce(uid, F.lit("")), "[^0-9]", "")
    source = F.coalesce(F.nullif(source_id, F.lit("")), F.lit("src_unknown"))
    return (
        F.when(uid_kept_together & (F.length(digits) == 10), F.concat(F.lit("uid_full::"), digits))
        .when(F.coalesce(session_id, F.lit("")) != "", F.concat(source, F.lit("::session::"), session_id))
        .when(F.coalesce(match_id, F.lit("")) != "", F.concat(source, F.lit("::match::"), match_id))
        .otherwise(F.concat(source, F.lit("::record::"), F.coalesce(record_id, F.lit(""))))
    )


def path_slot(path: Column) -> Column:
    """Slot 1 to 6 that a path names after disk or disc; null if none."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"\bdis[ck][_\-\s]*([1-6])\b", 1), F.lit("")).try_cast("int")


#: Tags of a new source by its role.
SOURCE_TAGS = {
    "uid_panel": ["account", "profile", "uid"],
    "roster": ["account", "roster", "agents"],
    "agent_detail": ["account", "agent_detail", "agent", "stats"],
    "equipment": ["account", "equipment", "inventory"],
    "disk_detail": ["account", "equipment", "inventory", "disc_detail", "disc"],
    "amplifier_detail": ["account", "equipment", "inventory", "amplifier"],
    "mindscape": ["account", "mindscape", "cinema"],
}


def source_tags(role: Column, slot: Column) -> Column:
    out = cases([(role == r, words(t)) for r, t in SOURCE_TAGS.items()], words(["account"]))
    return F.when((role == "disk_detail") & slot.isNotNull(), F.array_append(out, F.concat(F.lit("slot_"), slot.cast("string")))).otherwise(out)


def global_slot(page: Column, slot: Column) -> Column:
    """Slots of three per page count through the pages; larger ones do already."""
    return F.when(page.isNotNull() & slot.between(1, 3), page * 3 + slot).otherwise(slot)


#: Layout of a supported screen.
ASPECT, ASPECT_TOLERANCE, TALL = 16 / 9, 0.2, 1296


def runtime_resolution(stated: Column, width: Column, height: Column) -> Column:
    """1440p or 1080p; '' if the layout isn't 16:9 or what is stated and what is seen differ. width, height: null if nothing was seen."""
    text_ = F.lower(text(stated))
    lines = F.coalesce(F.regexp_extract(text_, r"^(\d+)p$", 1).try_cast("int"), F.regexp_extract(text_, r"^\d+x(\d+)$", 1).try_cast("int"))
    name = lambda h: F.when(h >= TALL, "1440p").otherwise("1080p")
    said = F.when(lines.isNotNull(), name(lines)).otherwise("")
    seen = width.isNotNull() & height.isNotNull()
    good = (width > 0) & (height > 0) & (F.abs(width / F.greatest(height, F.lit(1)) - ASPECT) <= ASPECT_TOLERANCE)
    return F.when(~seen, said).when(~good | ((said != "") & (said != name(height))), "").otherwise(name(height))


def focus_fields(ids: Column) -> tuple[Column, Column]:
    """(first id, the list only if it has more than one)."""
    return F.try_element_at(ids, F.lit(1)), F.when(F.size(ids) > 1, ids)
