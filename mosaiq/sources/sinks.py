"""Writers: tables, one-row reports, sheets, pages of cells, glyph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.texts import html_cell


def save_table(df: DataFrame, path: str) -> None:
    """Overwrite as Parquet; the committer publishes whole files only, so a failed job leaves the old ones or none."""
    df.write.mode("overwrite").parquet(path)


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text per row, with null fields left out."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def save_report(report: DataFrame, path: str) -> None:
    report_json(report).write.mode("overwrite").text(path)


def sheet(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Named cells as text, null as blank, in the given order."""
    return df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def save_sheet(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header. bom: its first name starts with a byte-order mark, which spreadsheets look for."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], chr(0xFEFF) + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def html_rows(df: DataFrame, columns: list[str], link: str | None = None) -> DataFrame:
    """One escaped table row per row; the column `link` becomes an anchor to its own text."""
    cell = lambda c: F.concat(F.lit("<td>"), F.when(F.lit(c == link), F.concat(F.lit('<a href="'), html_cell(F.col(c)), F.lit('">'), html_cell(F.col(c)), F.lit("</a>"))).otherwise(html_cell(F.col(c))), F.lit("</td>"))
    return df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")).alias("value"))


def markdown(report: dict) -> str:
    """A small report of scalars and lists as Markdown."""
    lines = []
    for name, value in report.items():
        if isinstance(value, (list, tuple)):
            lines += [f"## {name}", *([f"- {v}" for v in value] or ["- none"])]
        elif isinstance(value, dict):
            lines += [f"## {name}", *[f"- {k}: {v}" for k, v in value.items()]]
        else:
            lines.append(f"- {name}: {value}")
    return "\n".join(lines) + "\n"


def glyph_rows(rows: Column) -> Column:
    """Rows of a glyph as texts of 0 and 1."""
    return F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.when(x > 0.5, "1").otherwise("0")), ""))


def glyph_levels(rows: Column) -> Column:
    """The inverse: one list of numbers."""
    return F.flatten(F.transform(rows, lambda r: F.transform(F.filter(F.split(r, ""), lambda c: c != ""), lambda c: c.cast("float"))))
