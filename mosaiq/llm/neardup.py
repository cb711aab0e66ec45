"""Near-duplicate removal by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of five words; a shorter one has its whole word sequence as one shingle; a
document without words has an empty set and is linked with nothing. The sketch throws every shingle into one of t
bins per round, and keeps per bin the least value of the earliest round that reached it. Rounds t to 2t-1 put all
shingles into bin (round - t), so every coordinate fills whatever the set's size, and the share of equal coordinates
is concentrated about the Jaccard similarity as for t independent ones. Equal runs of `rows` coordinates make two
documents candidates; only links that full sets confirm count.

Plan: rows get a number each and documents with equal sets collapse to the least of them, the class's node, so copies cost
one row. In each band bucket all members are first compared with the bucket's least node, and confirmed links are joined
into components; in ROUNDS more rounds, rows outside the bucket's largest component are compared with another of its members.
Pairs that share a bucket but still lie in different components are then looked for in blocks of bounded
size, where whole sketches rule out what can't reach the threshold; what remains is confirmed on full sets too. So a group
of n near copies costs about n comparisons, yet no link between different components is lost. A node that meets many
others is dealt into salted copies.

Defined results: ids are integers. Null texts count as empty; other columns are not read; an empty table gives an empty
result. Each row gets a row back. Rows that share an id are one document with several texts, linked where any of them is,
so all of them have one component; a row without words has that of its id. Rows without an id are not linked, have a
null component and are kept. `survivors` keeps one row of each component: of the least id, that of the most
shingles; repeated rows leave one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import WordHash, arrow_map, copied, discard, held, mixed, salted, slices, spread, utf8, windows, word_ids, written

#: Bytes of text that are sketched together.
CHUNK = 1 << 20
#: Members of a bucket that are compared in one block.
BLOCK = 256
#: Rounds of comparisons with a member of a bucket's largest component, before blocks.
ROUNDS = 1
SHINGLE = 5
#: Coordinates of a sketch. Bands use the first of them, estimates of similarity all.
COORDINATES = 512
#: Coordinates that are compared first; unlike pairs disagree in too many of them already.
FIRST = 256


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows) that miss a pair at the threshold with a chance below one in a million, of at most 256 coordinates."""
    j, best = percent / 100, (256, 1)
    for rows in range(1, 17):
        bands = 256 // rows
        if (1 - j**rows) ** bands < 3e-6:
            best = (bands, rows)
    return best


def shingles(text: bytes, hashes: dict) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(windows(word_ids(text.lower().split(), hashes), SHINGLE))


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates per set. Coordinates of an empty set have all bits set."""
    n = len(sets)
    full = np.full(n * t, np.uint64(2**64 - 1), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    for step in range(2 * t):
        if not len(items):
            break
        h = mixed(items ^ np.uint64((step + 1) * 0xD6E8FEB86659FD93 % 2**64))
        bins = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if step < t else np.full(len(items), step - t)
        np.minimum.at(full, owner * t + bins, (h & np.uint64(2**40 - 1)) | np.uint64(step << 40))
        if step % 4 == 3 or step < 4:
            short = (full.reshape(n, t) == np.uint64(2**64 - 1)).any(axis=1)
            keep = short[owner]
            items, owner = items[keep], owner[keep]
    return full.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    acc = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), grid.shape[:2]).copy()
    for k in range(rows):
        acc = mixed(acc ^ grid[:, :, k])
    return acc.astype(np.int64, casting="unsafe")


def numbered(docs: DataFrame) -> DataFrame:
    """row, a unique number, and `doc`, the struct of all columns. Written, so the numbers stay."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered")


def sketched(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """row, doc_id, n_shingles, sig (of the whole set; null if empty), keys (one per band), bytes8 (8 bits per coordinate)."""
    t = COORDINATES

    def run(batch: pa.RecordBatch):
        texts, hashes = utf8(batch.column(2)), held("word hashes", None, WordHash)
        for a, b in slices(texts, CHUNK):
            sets = [shingles(x, hashes) for x in texts[a:b]]
            s = sketch(sets, t)
            sig = [np.array([mixed(x).sum(dtype=np.uint64), mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), len(x)], dtype=np.uint64).tobytes() if len(x) else None for x in sets]
            keys = band_keys(s, bands, per_band)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[a:b],
                    batch.column(1)[a:b],
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(sig, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    pa.array([x.tobytes() for x in (s & np.uint64(255)).astype(np.uint8)], pa.binary()),
                ],
                names=["row", "doc_id", "n_shingles", "sig", "keys", "bytes8"],
            )

    return arrow_map(spread(rows.select("row", F.col("doc_id").cast("long"), "text")), run, "row long, doc_id long, n_shingles long, sig binary, keys array<long>, bytes8 binary")


def least_agreement(percent: int) -> int:
    """Equal coordinates below which a pair misses the threshold, by five deviations."""
    j = percent / 100
    return int((j - 5 * math.sqrt(j * (1 - j) / COORDINATES)) * COORDINATES)


def agreements(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Equal bytes of each of the rows with one row; up to 255 * 8 columns, in eighths that are added as bytes of a word."""
    lanes = (rows == row).view(np.uint64).sum(axis=-1, dtype=np.uint64)
    return lanes.view(np.uint8).reshape(len(rows), 8).sum(axis=1, dtype=np.int64)


def side(table: DataFrame, node: str) -> DataFrame:
    """The table's columns with the node's name behind them."""
    return table.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in table.columns if c != "node"])


def verified(pairs: DataFrame, info: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b), those whose full sets have 100 * intersection >= percent * union. With info, sizes and whole sketches rule
    out most others before texts are met. pairs: a written table; info: node, n_shingles, bytes8; texts: node, text."""
    least = least_agreement(percent)
    dealt, hot = salted(pairs, "a", "b")
    meet = lambda rows, table: rows.join(side(table, "b").hint("merge"), "b").join(copied(side(table, "a"), "a", hot).hint("merge"), ["a", "salt"])

    def like(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (3, 4))
        yield batch.select([0, 1, 2]).filter(pa.array(agreements(x, y) >= least))

    likely = dealt
    if info is not None:
        both = meet(dealt, info.select("node", "n_shingles", "bytes8")).where(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        likely = written(arrow_map(both.select("a", "b", "salt", "bytes8_a", "bytes8_b"), like, "a long, b long, salt int"), "likely")
    both = meet(likely, texts).select("a", "b", "text_a", "text_b")
    last: list = [None, None]

    def equal(batch: pa.RecordBatch):
        keep, hashes = [], held("word hashes", None, WordHash)
        for a, text_a, text_b in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
            if last[0] != a:
                last[:] = a, shingles(text_a, hashes)
            x, y = last[1], shingles(text_b, hashes)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = written(arrow_map(both, equal, "a long, b long"), "links")
    discard(hot, *([likely] if info is not None else []))
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that each end of the links reaches. Large-star and small-star rounds until nothing moves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not edges.isEmpty():
        # Large star: neighbours above a node go to the least of its neighbourhood; small star: those below do.
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(small, "edges")
        discard(edges)
        edges = after
        # Done when each node has one edge and no node is both a child and a parent.
        unsettled = edges.groupBy("u").count().where("count > 1").select("u").union(edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))
        if unsettled.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def open_rows(labelled: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, dealt to blocks: key, node, comp, in_main, x, others. labelled: key, node, comp.

    A bucket's largest component needs no look at itself: its rows and the rest are dealt into blocks of BLOCK rows apart, and
    only pairs with a block of the rest are groups, each of at most about 2 * BLOCK rows; x is a row's block, which meets blocks
    0 to others - 1. So a bucket in which few rows are left open costs about as much as it has rows.
    """
    held = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sized = held.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("m")).where("m > n_main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = sized.select("key", "main", blocks(F.col("n_main")).alias("c_main"), blocks(F.col("m") - F.col("n_main")).alias("c_rest"))
    dealt = labelled.join(sized.hint("merge"), "key")
    # Blocks of the rest have the first numbers, those of the largest component the ones after.
    in_main, draw = F.col("comp") == F.col("main"), F.xxhash64("node", "key")
    dealt = dealt.withColumn("x", F.when(in_main, F.col("c_rest") + F.pmod(draw, "c_main")).otherwise(F.pmod(draw, "c_rest")).cast("int"))
    others = F.when(in_main, F.col("c_rest")).otherwise(F.col("c_rest") + F.col("c_main"))
    return dealt.select("key", "node", "comp", in_main.alias("in_main"), "x", others.alias("others"))


def leftovers(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of bucket members in different components that may reach the threshold, found in bounded blocks.

    A pair that meets in several buckets is told by the first of them, which only whole band keys can name. rows: as of
    open_rows, with n_shingles, bytes8 and keys.
    """
    least = least_agreement(percent)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.withColumn("p", F.least("x", "other")).withColumn("q", F.greatest("x", "other")).drop("other", "others", "in_main")

    def found(group: pa.RecordBatch) -> np.ndarray:
        nodes, comps, sizes, x, p, q = (group.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "x", "p", "q"))
        grid = np.frombuffer(b"".join(group.column("bytes8").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
        first, second = np.ascontiguousarray(grid[:, :FIRST]), np.ascontiguousarray(grid[:, FIRST:])
        keys, here = group.column("keys").flatten().to_numpy().reshape(len(nodes), -1), group.column("key")[0].as_py()
        n, same = len(nodes), p[0] == q[0]
        of_p = n if same else int((x == p[0]).sum())
        out = [np.empty((0, 2), np.int64)]
        for i in range(of_p):
            start = i + 1 if same else of_p
            ok = (comps[start:] != comps[i]) & (100 * np.minimum(sizes[start:], sizes[i]) >= percent * np.maximum(sizes[start:], sizes[i]))
            if not ok.any():
                continue
            equal = agreements(first[start:], first[i])
            (at,) = (ok & (equal >= least - (COORDINATES - FIRST))).nonzero()
            if len(at):
                at = at[equal[at] + agreements(second[start + at], second[i]) >= least] + start
                at = at[keys[i][(keys[at] == keys[i]).argmax(axis=1)] == here] if len(at) else at
                out.append(np.stack([np.minimum(nodes[at], nodes[i]), np.maximum(nodes[at], nodes[i])], axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups lie one after the other; the last one of a batch may go on in the next.
        last: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*last, batch]).combine_chunks().to_batches()[0] if last else batch
            marks = np.stack([rows.column(c).to_numpy() for c in ("key", "p", "q")])
            cuts = [0, *((marks[:, 1:] != marks[:, :-1]).any(axis=0).nonzero()[0] + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield told(found(rows.slice(a, b - a)))
            last = [rows.slice(cuts[-1])]
        for rows in last:
            yield told(found(rows))

    def told(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    group = ["key", "p", "q"]
    # Small groups are many, so they are not handed over one by one.
    return dealt.repartition(*group).sortWithinPartitions(*group, "x").mapInArrow(run, "a long, b long").distinct()


def assigned(rows: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, sig and component_id of each row. rows: row, doc_id, text, with numbers that stay."""
    bands, per_band = band_shape(percent)
    all_rows = written(sketched(rows, bands, per_band), "sketches")
    # Equal sets: one node each. Only numbers and signatures are shuffled.
    classes = written(all_rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("row").alias("node")), "classes")
    of_rows = written(all_rows.where("sig is not null and doc_id is not null").select("row", "doc_id", "n_shingles", "sig").join(classes, "sig"), "of-rows")
    several = of_rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select("doc_id", "a")
    same_id = written(of_rows.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "same-id")
    reps = all_rows.withColumnRenamed("row", "node").join(classes.select("node").hint("merge"), "node", "left_semi")
    # One exchange by key serves both the counting of buckets and the choice of their members.
    keys = reps.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot <> top").select("key", "pivot")
    members = written(keys.join(shared.hint("merge"), "key"), "members")
    info = written(reps.select("node", "n_shingles", "keys", "bytes8").join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "info")
    # Texts are shuffled once, those of candidates alone go further.
    texts = written(rows.select(F.col("row").alias("node"), "text").join(info.select("node").hint("merge"), "node", "left_semi"), "texts")
    tried = written(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    links = verified(tried, info, texts, percent).union(same_id)
    labels, opened = components(links), None
    for step in range(ROUNDS + 1):
        comps = info.select("node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Only numbers and labels are dealt to buckets; sketches follow for the buckets that still hold several components.
        opened = written(open_rows(members.select("key", "node").join(comps.hint("merge"), "node")), "open")
        if step < ROUNDS:
            pivots = opened.where("in_main").groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(step))).alias("pivot"))
            pairs = opened.where(~F.col("in_main")).join(pivots.hint("merge"), "key").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        else:
            pairs = leftovers(opened.join(info.hint("merge"), "node"), percent)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "more-pairs")
        discard(opened)
        if not pairs.isEmpty():
            # Blocks have looked at sizes and sketches already.
            links = links.union(verified(pairs, info if step < ROUNDS else None, texts, percent))
            labels, tried = components(links), tried.union(pairs)
    discard(members, info, texts)
    # A component is named by the least id of its classes.
    whole = labels.union(labels.select(F.col("comp").alias("node"), "comp").distinct())
    names = whole.join(classes, "node").groupBy("comp").agg(F.min("rep").alias("name"))
    named = whole.join(names, "comp").select("node", "name")
    by_id = of_rows.join(named, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("name", "rep")).alias("component_id"))
    out = all_rows.select("row", "doc_id", "n_shingles", "sig")
    with_id = out.where("doc_id is not null").join(by_id, "doc_id", "left").select("row", "doc_id", "n_shingles", "sig", F.coalesce("component_id", "doc_id").alias("component_id"))
    return with_id.union(out.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, linking sets with 100 * intersection >= percent * union."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("row", "doc.doc_id", "doc.text")
    out = assigned(rows, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def survivors(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of docs; rows without an id all stay."""
    table = numbered(docs)
    rows = table.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"))
    found = written(assigned(rows, percent).where("doc_id is not null").select("row", "doc_id", "component_id", F.struct(-F.col("n_shingles"), F.coalesce("sig", F.lit(b"")), "row").alias("rank")), "components")
    best = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    gone = found.select("row").join(best, "row", "left_anti")
    return table.join(gone, "row", "left_anti").select("doc.*")
