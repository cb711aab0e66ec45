"""Text, number, date and map functions as column builders. Only what Spark has no function for is an Arrow UDF."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from mosaiq.functions.policy import cases, filled

LEVEL_CAPS = [10, 20, 30, 40, 50, 60]
#: Letters that optical recognition takes for digits.
LOOKALIKES = ("OoОоIiІіLlЛл", "000011111111")
MOJIBAKE = "РЃЄёїј"


@F.pandas_udf(StringType())
def nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC form; pure ASCII, which it leaves alone, is settled without Python by the caller's choice of ascii_only."""
    return nfkc_udf(c)


def matched_share(alias: str):
    """Scores texts by their share of characters that match the alias (twice the matches over both lengths)."""
    matcher = difflib.SequenceMatcher(None, "", alias)

    def score(text: str) -> float:
        matcher.set_seq1(text)
        return matcher.ratio()

    return score


def edit_share(alias: str):
    """Scores texts by 1 - edits / length of the longer text."""

    def score(text: str) -> float:
        row = list(range(len(alias) + 1))
        for i, c in enumerate(text, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(alias, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return 1 - row[-1] / max(len(text), len(alias))

    return score


#: Name -> (maker of an alias's score, most that two lengths allow).
SCORES = {"sequence": (matched_share, lambda a, b: 2 * min(a, b) / (a + b)), "edits": (edit_share, lambda a, b: 1 - abs(a - b) / max(a, b))}


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def display_key(c: Column, ascii_only: bool = False) -> Column:
    """Key of a displayed name: lower case, dashes and separators made alike, slot suffixes gone, other signs blank."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = out if ascii_only else nfkc(out)
    out = F.translate(out, "–—− ", "--- ")
    out = F.regexp_replace(F.regexp_replace(out, "&", " and "), "[/_]", " ")
    for suffix in (r"\s*\[[1-6]\]\s*$", r"\s*\((?:slot|disc|disk)\s*[1-6]\)\s*$", r"\s*slot\s*[1-6]\s*$"):
        out = F.regexp_replace(out, suffix, "")
    out = F.regexp_replace(F.trim(out), "w[- ]engine", "wengine")
    return squeezed(F.regexp_replace(out, "[^0-9a-zA-ZЀ-ӿ+\\- ]+", " "))


def alias_key(c: Column, digits_as_letters: bool = False, ascii_only: bool = False) -> Column:
    """Key under which aliases of a title meet: the display key without hyphens, badges, level marks and stray letters."""
    out = F.regexp_replace(display_key(c, ascii_only), "-", " ")
    out = F.translate(out, "ё", "е")
    for pattern in (r"(?iU)\bnew\b", r"(?U)^[\W_]+", r"(?iU)^[a-zа-я]\s+", r"^[0-9]+\s+", r"(?iU)^\b[оo]\b\s*", r"(?iU)\b(?:ур|yp|lv)[a-zа-я0-9/.-]*\b", r"(?iU)\b[oо]\b$", r"(?iU)\b[еe]\b$"):
        out = F.regexp_replace(out, pattern, " ")
    out = squeezed(out)
    return F.translate(out, "1058", "losb") if digits_as_letters else out


def slug(c: Column, ascii_only: bool = False) -> Column:
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = out if ascii_only else nfkc(out)
    out = F.regexp_replace(out, "&", " and ")
    return F.trim(F.regexp_replace(out, "[^0-9a-z]+", "_"), F.lit("_"))


def looks_corrupted(c: Column) -> Column:
    """Blank, or at least 35 % question marks or misread letters among what carries meaning."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-_\[\]()]", "")
    n = F.length(body)
    count = lambda signs: n - F.length(F.translate(body, signs, ""))
    marks, odd = count("?"), count(MOJIBAKE)
    return (n == 0) | (marks >= 0.35 * n) | ((odd > 0) & (odd >= 0.35 * n))


def uid_from_text(c: Column, least: int = 10, most: int = 10) -> Column:
    """Digits that stand alone, `least` to `most` of them (ten in a UID), else all digits if there are so many; '' otherwise."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?:^|[^0-9])([0-9]{{{least},{most}}})(?:[^0-9]|$)", 1)
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(found != "", found).when(F.length(digits).between(least, most), digits).otherwise("")


def uid_digits(c: Column, least: int = 6, most: int = 12) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits).between(least, most), digits).otherwise("")


def level_pair(token: Column) -> Column:
    """struct<current, cap> of tokens such as 60/60, 6060, 60160, with letters read as digits; null fields if it's none."""
    t = F.translate(F.regexp_replace(F.coalesce(token, F.lit("")), r"[\s]", ""), *LOOKALIKES)
    t = F.translate(t, "|\\", "//")
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)
    slash = F.contains(t, F.lit("/"))
    side = lambda k: F.regexp_replace(F.regexp_extract(t, "^([^/]*)/(.*)$", k), "[^0-9]", "")
    three = (n == 3) & F.substring(digits, 2, 2).isin([str(x) for x in LEVEL_CAPS])
    first = F.substring(digits, 1, 1)
    left = F.when(slash, side(1)).when(three, F.when(first == "0", F.substring(digits, 2, 1)).otherwise(first)).when(n.isin(4, 5), F.substring(digits, 1, 2)).when(n == 6, F.substring(digits, 1, 3)).otherwise("")
    right = F.when(slash, side(2)).when(three, F.substring(digits, 2, 2)).when(n == 4, F.substring(digits, 3, 2)).when(n == 5, F.substring(digits, 4, 2)).when(n == 6, F.substring(digits, 4, 3)).otherwise("")
    current, cap = left.try_cast("int"), right.try_cast("int")
    ok = (current > 0) & cap.isin(LEVEL_CAPS) & (current <= cap)
    return F.struct(F.when(ok, current).alias("current"), F.when(ok, cap).alias("cap"))


def number(c: Column) -> Column:
    """'+12,5 %' -> 12.5; null if it is no number. Rounded to four places."""
    body = F.translate(F.regexp_replace(F.trim(c), r"[%+\s]", ""), ",", ".")
    return F.round(body.try_cast("double"), 4)


def fraction(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def value_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[+\-]?\d+(?:\.\d+)?(?:/0)?%?"), F.lit(0))


def rescaled(value: Column, limit: float) -> Column:
    """A value that recognition made ten times too large, or more, brought to the limit or below."""
    steps = F.greatest(F.lit(0.0), F.ceil(F.log10(value / limit)))
    return F.when(value > limit, value / F.pow(F.lit(10.0), steps)).otherwise(value)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_date(c: Column) -> Column:
    """YYYYMMDD -> ISO date; null if it is none."""
    return F.date_format(F.try_to_date(F.trim(c), "yyyyMMdd"), "yyyy-MM-dd")


def html_cell(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def occupancy(slots: Column, n: int = 6) -> Column:
    """map<'1'..'n', boolean>: whether each slot is in a list."""
    keys = F.sequence(F.lit(1), F.lit(n))
    return F.map_from_arrays(F.transform(keys, lambda k: k.cast("string")), F.transform(keys, lambda k: F.coalesce(F.array_contains(slots, k), F.lit(False))))


def all_empty(slots: Column, n: int = 6) -> Column:
    return (F.size(slots) == n) & ~F.exists(F.map_values(slots), lambda x: x)


def cleaned(row: Column) -> Column:
    """Entries of a map whose value isn't blank."""
    return F.map_filter(row, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")


def stat_key_valid(c: Column, keys: list[str]) -> Column:
    return F.coalesce(c.isin(keys), F.lit(False))


def mode_confidence(mode: Column, table: dict[str, float]) -> Column:
    return cases([(mode == k, F.lit(v)) for k, v in table.items()], F.lit(0.0))


def note_added(notes: Column, note: str) -> Column:
    """A note is appended once."""
    old = F.coalesce(notes, F.lit(""))
    return F.when(F.contains(old, F.lit(note)), old).otherwise(F.trim(F.concat(old, F.lit(" " + note))))


def language_tag(locale: Column) -> Column:
    return F.when(F.coalesce(F.upper(F.trim(locale)), F.lit("")) == "EN", F.lit("en-US")).otherwise("ru")


def focus_values(note: Column) -> Column:
    """Names in 'focus=a,b|c/d; ...', in order."""
    listed = F.regexp_extract(F.coalesce(note, F.lit("")), "focus=([^;]*)", 1)
    return F.filter(F.transform(F.split(listed, "[,|/]"), lambda x: F.trim(x)), lambda x: x != "")


def display_name(first: Column, second: Column) -> Column:
    """The first of two names that isn't corrupted, else whichever is filled."""
    return F.coalesce(F.when(~looks_corrupted(first), F.trim(first)), F.when(~looks_corrupted(second), F.trim(second)), filled(first), filled(second))
