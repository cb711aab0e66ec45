"""Benchmark decontamination by canonical templates.

Words are lower-cased and stripped of punctuation at their ends. Numbers, units, and names (capitalised words inside a
sentence) become typed placeholders, so a question with other numbers or names has the same template. Windows of WIDTH
template words of a document are looked up among those of the benchmark; a window needs more plain words than placeholders,
others are looked up by their words as they stand, so that exact copies of numbers and titles match.
Hits on one diagonal (the same shift between document and item) make up an aligned run. Slots must be consistent: an
item's value always stands for one value of the document, and different values of the item for different ones. A document is
contaminated by an item when the longest consistent stretch of a run holds a whole window and covers at least half of the
item's words, or ENOUGH of them.

Plan: windows of the benchmark are broadcast after a check of their number; every document is then judged where it is
read, without a shuffle. Windows of a larger benchmark set bits of a table of fixed size instead; document windows whose bit is
set meet the benchmark's in a hash join, where frequent windows are dealt into copies. Both ways give the same rows.

Defined results: null and empty texts, and items of fewer than LEAST words, match nothing; items of fewer than WIDTH words
must match as a whole; repeated rows give repeated results; null ids match like others; extra columns are only carried by
`clean_documents`, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import MOST_WORDS, arrow_map, copied, held, salted, spread, utf8, windows, written

WIDTH, LEAST = 8, 5
#: Covered words that suffice however long the item is.
ENOUGH = 13
#: Windows of a benchmark that are broadcast at most, 24 bytes each; bits of the table that stands for a larger one, and of a part.
MOST_BROADCAST, BITS, PART_BITS = 2_000_000, 1 << 27, 1 << 13
#: Common units of measure.
UNITS = frozenset(b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g gram grams kg kilogram kilograms mg lb lbs pound pounds oz ounce ounces t ton tons ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kph km/h m/s c f k v w kw mw hz khz mhz ghz kb mb gb tb usd eur gbp dollar dollars cent cents euro euros percent %".split())
EDGES = b"\"'`.,;:!?()[]{}<>|*#&@~_=+\\"
NUMBER = re.compile(rb"[-+]?[$]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
NUMBER_STARTS = frozenset(b"+-$0123456789")
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
#: Template ids of the placeholders; plain words have others, with the low three bits clear.
NUM, UNIT, NAME = 8, 16, 24
CAPITAL, ENDS, EMPTY = 1, 2, 4
#: Keeps hashes of windows of words apart from those of templates.
LITERAL = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Raw word -> template id with flags in the low bits, remembered up to a bound."""

    def __missing__(self, raw: bytes) -> int:
        core = raw.strip(EDGES)
        letters = core if core.isascii() else core.decode("utf-8", "replace")
        low = letters.lower() if letters is core else letters.lower().encode()
        if not core:
            out = EMPTY
        elif (core[0] in NUMBER_STARTS and NUMBER.fullmatch(low)) or low in NUMBER_WORDS:
            out = NUM
        elif low in UNITS:
            out = UNIT
        else:
            out = (xxhash.xxh3_64_intdigest(low) | 1 << 63) & ~7
            if letters[:1].isupper() and (letters[1:].islower() or len(letters) == 1):
                out |= CAPITAL
        if raw.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":"):
            out |= ENDS
        if len(self) < MOST_WORDS and len(raw) <= 64:
            self[raw] = out
        return out


def template(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Template ids, whether each is a slot, and the raw words behind them."""
    raw = text.split()
    codes = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    empty = (codes & np.uint64(EMPTY)) != 0
    if empty.any():
        codes = codes[~empty]
        raw = [w for w, e in zip(raw, empty.tolist(), strict=True) if not e]
    starts = np.ones(len(codes), bool)
    starts[1:] = (codes[:-1] & np.uint64(ENDS)) != 0
    name = ((codes & np.uint64(CAPITAL)) != 0) & ~starts
    ids = np.where(name, np.uint64(NAME), codes & ~np.uint64(7))
    return ids, ids <= NAME, raw


def value(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw.strip(EDGES).decode("utf-8", "replace").lower().encode())


def cut(ids: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows that hold more plain words than placeholders."""
    if len(ids) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    slots = np.concatenate([[0], np.cumsum(slot)])
    good = 2 * (slots[width:] - slots[:-width]) < width
    return windows(ids, width)[good], np.flatnonzero(good)


def cut_literal(ids: np.ndarray, slot: np.ndarray, raw: list[bytes], width: int, item: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of windows of the words themselves, where the template is too generic to be cut.

    A name at the start of an item may stand inside a sentence of a document: an item's first window, and windows of a document
    that begin with a name, are cut too.
    """
    if len(ids) < width or not (item or slot.any()):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    slots = np.concatenate([[0], np.cumsum(slot)])
    need = 2 * (slots[width:] - slots[:-width]) >= width
    need |= (np.arange(len(need)) == 0) if item else ids[: len(need)] == np.uint64(NAME)
    if not need.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = ids.copy()
    for k in np.flatnonzero(slot).tolist():
        words[k] = (value(raw[k]) | 1 << 63) & ~7
    return windows(words, width)[need] ^ LITERAL, np.flatnonzero(need)


class Index:
    """All windows of the benchmark, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        words = Words()
        self.items = []
        rows: list[tuple[int, int, int, bool]] = []
        self.widths = set()
        for item_id, text in items:
            ids, slot, raw = template(text, words)
            if len(ids) < LEAST:
                continue
            width = min(WIDTH, len(ids))
            self.widths.add(width)
            hashes, at = cut(ids, slot, width)
            rows += [(h, len(self.items), k, False) for h, k in zip(hashes.tolist(), at.tolist(), strict=True)]
            hashes, at = cut_literal(ids, slot, raw, width, True)
            rows += [(h, len(self.items), k, True) for h, k in zip(hashes.tolist(), at.tolist(), strict=True)]
            values = {int(k): value(raw[k]) for k in np.flatnonzero(slot)}
            self.items.append((item_id, len(ids), width, values))
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int32)
        self.at = np.array([r[2] for r in rows], np.int32)
        self.literal = np.array([r[3] for r in rows], bool)


def stretch(covered: list[int], pairs: dict[int, tuple]) -> int:
    """Length of the longest part of the covered positions whose (item value, document value) pairs are a one-to-one mapping."""
    there: dict = {}
    back: dict = {}
    best = start = 0
    for end, p in enumerate(covered):
        if p in pairs:
            a, b = pairs[p]
            while (a in there and there[a][0] != b) or (b in back and back[b][0] != a):
                if covered[start] in pairs:
                    x, y = pairs[covered[start]]
                    for side, key in ((there, x), (back, y)):
                        side[key][1] -= 1
                        if not side[key][1]:
                            del side[key]
                start += 1
            there.setdefault(a, [b, 0])[1] += 1
            back.setdefault(b, [a, 0])[1] += 1
        best = max(best, end + 1 - start)
    return best


def best_run(at: list[tuple[int, bool]], length: int, width: int, pair) -> int:
    """Words that the longest consistent stretch of the hits (item position, whether literal) of one run covers; 0 if too few.

    Hits of templates are judged alone, with the literal ones, and the literal ones alone: no kind spoils the other's run.
    pair: a covered position's (item value, document value), None where the item has no slot.
    """
    kinds = {x for _, x in at}
    best = 0
    for chosen in ({False}, {True}, {False, True}) if len(kinds) == 2 else (kinds,):
        covered = sorted({p + i for p, x in at if x in chosen for i in range(width)})
        if len(covered) > best and len(covered) >= min(ENOUGH, length / 2):
            n = stretch(covered, {p: v for p in covered if (v := pair(p)) is not None})
            if n >= max(width, min(ENOUGH, length / 2)):
                best = max(best, n)
    return best


def judge(hits: list[tuple[int, int, int, bool]], items: list, raw: list[bytes]) -> list[tuple[int, int]]:
    """(item, words covered) of the items whose best consistent run covers enough of them. hits: (item, item position, position, literal)."""
    runs: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    for item, p, k, literal in hits:
        runs.setdefault((item, k - p), []).append((p, literal))
    best: dict[int, int] = {}
    for (item, shift), at in runs.items():
        _, length, width, values = items[item]
        n = best_run(at, length, width, lambda p: (values[p], value(raw[p + shift])) if p in values else None)  # noqa: B023
        if n:
            best[item] = max(best.get(item, 0), n)
    return sorted(best.items())


def matches(text: bytes, index: Index, words: Words) -> list[tuple[int, int]]:
    ids, slot, raw = template(text, words)
    hits = []
    for width in index.widths:
        hashes, at = cut(ids, slot, width)
        more, places = cut_literal(ids, slot, raw, width, False)
        if len(more):
            hashes, at = np.concatenate([hashes, more]), np.concatenate([at, places])
        if not len(hashes) or not len(index.hash):
            continue
        low = np.searchsorted(index.hash, hashes)
        found = index.hash[np.minimum(low, len(index.hash) - 1)] == hashes
        for h, k, j in zip(hashes[found].tolist(), at[found].tolist(), low[found].tolist(), strict=True):
            while j < len(index.hash) and index.hash[j] == h:
                if index.items[index.item[j]][2] == width:
                    hits.append((int(index.item[j]), int(index.at[j]), k, bool(index.literal[j])))
                j += 1
    return judge(hits, index.items, raw) if hits else []


def small_benchmark(benchmark: DataFrame, text_col: str) -> bool:
    """An upper bound of its windows: words are at most half the bytes."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col) + 1), F.lit(0))).first()[0]
    return size / 2 <= MOST_BROADCAST


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", small: bool | None = None) -> DataFrame:
    """(doc_id, item_id, n_words, covered): one row per document and item that contaminates it, n_words being the item's length
    and covered how many of them one consistent run holds."""
    if small is None:
        small = small_benchmark(benchmark, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not small:
        # Texts meet by their own keys, so rows that share an id, or have none, are judged alone; ids follow at the end.
        rows = rows.select("doc_id", "text", text_key("text").alias("doc_key"))
        items = benchmark.select(F.col(item_col).alias("item_id"), text_key(item_text_col).alias("item_key"))
        found = joined(rows.select("doc_key", "text").dropDuplicates(["doc_key"]), keyed_items(benchmark, item_text_col))
        found = found.join(items, "item_key").join(rows.select("doc_id", "doc_key"), "doc_key")
        return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), "n_words", "covered")
    shared = broadcast_index(benchmark, item_col, item_text_col)

    def run(batch: pa.RecordBatch):
        index, words, out = shared.value, held("template words", None, Words), []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            out += [(doc_id, *index.items[i][:2], n) for i, n in matches(text, index, words)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_words", "covered"])

    return arrow_map(spread(rows), run, "doc_id long, item_id long, n_words long, covered long")


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def keyed_items(benchmark: DataFrame, text_col: str) -> DataFrame:
    return benchmark.select(text_key(text_col).alias("item_key"), F.col(text_col).alias("text")).dropDuplicates(["item_key"])


def broadcast_index(benchmark: DataFrame, item_col: str, text_col: str):
    items = sorted(((r[0], (r[1] or "").encode()) for r in benchmark.select(item_col, text_col).collect()), key=lambda x: (x[0] is None, x))
    return benchmark.sparkSession.sparkContext.broadcast(Index(items))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    if not small_benchmark(benchmark, item_text_col):
        # All columns go in one struct, so no name can clash with the key's.
        marked = docs.select(text_key(text_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        texts = docs.select(text_key(text_col).alias("doc_key"), F.col(text_col).alias("text")).dropDuplicates(["doc_key"])
        bad = joined(texts, keyed_items(benchmark, item_text_col)).select(F.col("doc_key").alias("key")).distinct()
        return marked.join(bad, "key", "left_anti").select("row.*")
    shared = broadcast_index(benchmark, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        words = held("template words", None, Words)
        keep = [not matches(x, shared.value, words) for x in utf8(batch.column(at))]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(spread(docs), run, docs.schema)


def windows_of(key: bytes, text: bytes, words: Words, widths: list[int] | None, seen: np.ndarray | None) -> list[tuple]:
    """Rows of all windows of an item (widths None), or of a document's windows of these widths whose bit is set."""
    ids, slot, raw = template(text, words)
    item, out = widths is None, []
    for width in ([min(WIDTH, len(ids))] * (len(ids) >= LEAST)) if item else widths:
        for literal, (hashes, at) in enumerate([cut(ids, slot, width), cut_literal(ids, slot, raw, width, item)]):
            if seen is not None and len(hashes):
                bit = (hashes & np.uint64(BITS - 1)).astype(np.int64)
                met = (seen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                hashes, at = hashes[met], at[met]
            for h, k in zip(hashes.astype(np.int64, casting="unsafe").tolist(), at.tolist(), strict=True):
                values = [value(raw[k + i]) - 2**63 if slot[k + i] or literal and not item else None for i in range(width)]
                out.append((key, h, k, width, len(ids), values, bool(literal)))
    return out


def exploded(table: DataFrame, kind: str, widths: list[int] | None = None, seen=None) -> DataFrame:
    """A row per window: key, h, at, width, words, values, literal, with the kind's name before those of one side."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
    names = [f"{kind}_key", "h", f"{kind}_at", "width", f"{kind}_words", f"{kind}_values", "literal"]

    def run(batch: pa.RecordBatch):
        words = held("template words", None, Words)
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            out = windows_of(key, text, words, widths, seen.value if seen else None)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    types = ["binary", "long", "long", "int", "long", "array<long>", "boolean"]
    return arrow_map(table, run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def bit_table(items: DataFrame):
    """A broadcast table of BITS bits, set where a window's hash falls. Parts of it are made apart; the driver only joins them."""
    bit = F.col("h").bitwiseAND(F.lit(BITS - 1))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(PART_BITS, bool)
        flags[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"part": pdf["part"][:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    bits = items.select((bit / PART_BITS).cast("long").alias("part"), (bit % PART_BITS).alias("bit")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    # At most BITS / 8 bytes, whatever the benchmark's size.
    for row in bits.groupBy("part").applyInPandas(part, "part long, bits binary").collect():
        start = row.part * PART_BITS // 8
        out[start : start + PART_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return items.sparkSession.sparkContext.broadcast(out)


def joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet in a hash join, and each document and item is judged in a group.

    (doc_key, item_key, n_words, covered) of distinct texts: doc_key, text and item_key, text.
    """
    items = written(exploded(benchmark, "item"), "item-windows")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WIDTH - LEAST + 1
    hits = written(exploded(docs, "doc", widths, bit_table(items)), "document-windows")
    dealt, hot = salted(hits, "h", "doc_key")
    met = dealt.join(copied(items, "h", hot), ["h", "width", "literal", "salt"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        length, pairs = int(pdf["item_words"].iloc[0]), {}
        for p, a, b in zip(pdf["item_at"], pdf["item_values"], pdf["doc_values"], strict=True):
            # Arrow gives lists with nulls as floats, others as integers.
            pairs |= {p + i: (float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and x == x}
        at = list(zip(pdf["item_at"].tolist(), pdf["literal"].tolist(), strict=True))
        n = best_run(at, length, int(pdf["width"].iloc[0]), pairs.get)
        return pd.DataFrame({"doc_key": pdf["doc_key"][:1], "item_key": pdf["item_key"][:1], "n_words": [length], "covered": [n]}) if n else pd.DataFrame({"doc_key": [], "item_key": [], "n_words": [], "covered": []})

    runs = met.groupBy("doc_key", "item_key", "shift").applyInPandas(decide, "doc_key binary, item_key binary, n_words long, covered long")
    return runs.groupBy("doc_key", "item_key", "n_words").agg(F.max("covered").alias("covered"))
