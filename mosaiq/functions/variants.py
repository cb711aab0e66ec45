"""Typed getters for VARIANT documents: a value counts only if it has the wanted type; nothing is converted silently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def _kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def as_text(doc: Column, path: str) -> Column:
    """Trimmed text; null if missing, blank, or not a string."""
    return F.when(_kind(doc, path) == "STRING", F.nullif(F.trim(F.try_variant_get(doc, path, "string")), F.lit("")))


def as_number(doc: Column, path: str, booleans: bool = False) -> Column:
    """Double; null if missing or not a number. booleans: count true and false as 1 and 0."""
    kind = _kind(doc, path)
    out = F.when(F.rlike(kind, F.lit(NUMERIC)), F.try_variant_get(doc, path, "double"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean").cast("double")).otherwise(out) if booleans else out


def as_boolean(doc: Column, path: str) -> Column:
    return F.when(_kind(doc, path) == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))


def as_json(doc: Column, path: str) -> Column:
    """Compact JSON of a field; null if missing."""
    return F.to_json(F.try_variant_get(doc, path, "variant"))


def first_text(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[as_text(doc, p) for p in paths], F.lit(""))
