import random

import numpy as np
import pytest

from mosaiq.llm import common, neardup
from mosaiq.llm.common import WordHash


def sets_of(rows):
    out = {}
    for k, text in rows:
        w = (text or "").encode().lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows, percent):
    sets, parent = sets_of(rows), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        find(a)
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def made(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    rows, k = [], 0
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([3, 12, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in copy)))
            k += 7
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80), (3, 60)])
def test_components_equal_brute_force(spark, seed, percent):
    rows = made(seed)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = neardup.near_duplicates(documents, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85)


def test_blocks_find_what_the_star_misses(spark, monkeypatch):
    """A chain in which only neighbours are similar, in blocks of two."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    words = [f"t{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[k * 12 : k * 12 + 160])) for k in range(18)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 80)


def test_a_chance_agreement_in_an_earlier_band_loses_no_link(spark, monkeypatch):
    """Two similar rows share the bucket of band 1 with an unlike pivot; in band 0 only the low bits of their coordinates agree."""
    words = [f"t{k}" for k in range(100)]
    texts = {1: " ".join(f"u{k}" for k in range(100)), 2: " ".join(words), 3: " ".join([*words[:-1], "other"])}
    bands, per_band = neardup.band_shape(80)
    same, unlike = bytes(neardup.COORDINATES), b"\1" * per_band + b"\0" * per_band + b"\1" * (neardup.COORDINATES - 2 * per_band)
    keys = {k: [1000 * k + b if b != 1 else 7 for b in range(bands)] for k in texts}
    made_up = [(k, k, 96, bytes([k]), keys[k], unlike if k == 1 else same) for k in texts]
    monkeypatch.setattr(neardup, "sketched", lambda *_: spark.createDataFrame(made_up, "row long, doc_id long, n_shingles long, sig binary, keys array<long>, bytes8 binary"))
    rows = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "row long, doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.assigned(rows, 80).collect()} == {1: 1, 2: 2, 3: 2}


def brute_by_id(rows, percent):
    """(id, text) rows; an id may have several texts, and is linked where any of them is."""
    found = brute(list(enumerate(t for _, t in rows)), percent)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for at, (_, root) in found.items():
        if rows[at][0] is not None and rows[root][0] is not None:
            x, y = find(rows[at][0]), find(rows[root][0])
            parent[max(x, y)] = min(x, y)
    return [(k, found[at][0], None if k is None else find(k)) for at, (k, _) in enumerate(rows)]


def test_ids_with_several_texts_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (5, a), (5, b), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 80).collect()) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert [tuple(r) for r in neardup.survivors(df, 80).collect()] == [(3, a)]
    # The smaller id's text is in no other row: it still stands for the group, and no text without a link goes.
    other = " ".join(f"c{k}" for k in range(30))
    left = neardup.survivors(spark.createDataFrame([(1, other), (4, a), (4, b), (2, b), (7, a), (7, a)], "doc_id long, text string"), 80).collect()
    assert sorted(tuple(r) for r in left) == [(1, other), (2, b)]


@pytest.mark.parametrize("seed", [11, 12])
def test_repeated_ids_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(k // 7, t) for k, t in made(seed, 120)]
    rows = [(rng.choice(rows)[0] if rng.random() < 0.1 else k, t) for k, t in rows]
    rows += [rows[3], rows[3], (rows[4][0], ""), (None, "alone without an id"), (10**6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(df, 80).collect()
    want = brute_by_id(rows, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(want, key=str)
    left = neardup.survivors(df, 80).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert sum(r.doc_id is None for r in left) == 1 and {tuple(r) for r in left} <= set(rows)


def test_two_texts_of_one_id_and_length_keep_their_own_sets(spark):
    words = [f"w{k:03d}" for k in range(100)]
    near = [*words[:-1], "x099"]
    rows = [(1, " ".join(f"q{k:03d}" for k in range(100))), (1, " ".join(words)), (2, " ".join(near))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1}


def test_salted_copies_of_a_node_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "PARTS", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[:-2], f"x{rng.randrange(9)}", f"y{k}"])) for k in range(40)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 80)


def test_long_chains_of_links_settle(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    found = {r.node: r.comp for r in neardup.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 300)}


def test_agreements_count_equal_bytes():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (50, 512)).astype(np.uint8)
    assert (neardup.agreements(rows, rows[7]) == (rows == rows[7]).sum(axis=1)).all()
    assert (neardup.agreements(rows[:, :256].copy(), rows[7, :256]) == (rows[:, :256] == rows[7, :256]).sum(axis=1)).all()


def test_every_coordinate_fills_and_estimates_concentrate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 700):
        s = neardup.sketch([rng.integers(0, 2**63, n).astype(np.uint64)], 256)
        assert (s != np.uint64(2**64 - 1)).all()
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = neardup.sketch([pool[:240], pool[60:]], 512)
        errors.append((a == b).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.03


def test_shape_of_bands():
    for percent in (80, 85, 90):
        bands, rows = neardup.band_shape(percent)
        assert bands * rows <= 256 and (1 - (percent / 100) ** rows) ** bands < 1e-5


def test_hard_inputs(spark, hard, empty):
    found = neardup.near_duplicates(hard, 85).collect()
    assert len(found) == hard.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[1]] == [(8, 1, True)] * 2
    assert all((r.n_shingles, r.component_id) == (0, r.doc_id) for k in (2, 3, 4) for r in by[k])
    assert by[5][0].n_shingles == 1 and by[6][0].n_shingles == 5
    assert all(r.component_id is None and r.kept for r in by[None]) and sorted(r.n_shingles for r in by[None]) == [0, 6]
    left = neardup.survivors(hard, 85)
    assert left.schema == hard.schema and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None", "None"]
    assert neardup.survivors(empty, 85).collect() == []
    assert neardup.near_duplicates(empty, 85).collect() == []


def test_shingle_hashes_count_distinct_sets():
    rng = random.Random(5)
    for _ in range(50):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 200)))
        assert len(neardup.shingles(text.encode(), WordHash())) == len(sets_of([(1, text)])[1])
