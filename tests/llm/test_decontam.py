import random

import pytest

from mosaiq.llm import common, decontam


def brute(docs, items):
    """Pairs by comparing every alignment of every document and item."""
    words, out = decontam.Words(), []
    cut = {k: decontam.template((t or "").encode(), words) for k, t in items}
    for doc_id, text in docs:
        ids, slot, raw = decontam.template((text or "").encode(), words)
        for item_id, (want, want_slot, want_raw) in cut.items():
            n = len(want)
            width = min(decontam.WIDTH, n)
            if n < decontam.LEAST:
                continue
            best = 0
            for shift in range(-n + 1, len(ids)):
                covered = set()
                for p in range(n - width + 1):
                    k = p + shift
                    if 0 <= k <= len(ids) - width and list(ids[k : k + width]) == list(want[p : p + width]) and 2 * sum(want_slot[p : p + width]) < width:
                        covered |= set(range(p, p + width))
                at = sorted(covered)
                for i in range(len(at)):
                    for j in range(i + 1, len(at) + 1):
                        pairs = {(decontam.value(want_raw[p]), decontam.value(raw[p + shift])) for p in at[i:j] if want_slot[p]}
                        if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) and j - i >= max(width, min(decontam.ENOUGH, n / 2)):
                            best = max(best, j - i)
            if best:
                out.append((doc_id, item_id, n, best))
    return sorted(out, key=str)


ITEM = "If Anna buys 12 apples and Bob buys 7 apples then how many apples do Anna and Bob have after 12 days"


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(rng.randrange(60)).translate(str.maketrans("0123456789", "abcdefghij"))
    items = [(1, ITEM), (2, " ".join(word() for _ in range(20))), (3, "one short"), (4, None), (5, " ".join(word() for _ in range(6))), (6, " ".join(word() for _ in range(30))), (7, "we add 3 apples to 3 pears and 3 plums then take 3 figs and 3 dates away now")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (1, f"{noise(30)}. If Carl buys 31 apples and Dora buys 9 apples then how many apples do Carl and Dora have after 31 days. {noise(20)}"),
        (2, f"{noise(30)}. If Carl buys 31 apples and Dora buys 9 apples then how many apples do Fred and Dora have after 31 days"),
        (3, f"{noise(10)} {items[1][1]} {noise(10)}"),
        (4, items[1][1].upper()),
        (5, f"{noise(5)} {items[4][1]}, {noise(5)}"),
        (6, noise(200)),
        (7, " ".join(items[5][1].split()[:12]) + " " + noise(20)),
        (8, " ".join(items[5][1].split()[7:25])),
        (9, None),
        (10, ""),
        (11, "one short " * 30),
        (12, "we add 4 apples to 5 pears and 6 plums then take 7 figs and 8 dates away now"),
        (13, "we add 4 apples to 4 pears and 4 plums then take 4 figs and 9 dates away now"),
        (None, items[1][1]),
    ]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_matches_equal_brute_force(spark, small):
    docs, items = cases()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((tuple(r) for r in decontam.contaminated(d, b, small=small).collect()), key=str)
    assert found == sorted(brute(docs, items), key=str)
    ids = {r[0] for r in found}
    assert {1, 3, 4, 5, 8, 13, None} <= ids and not ids & {6, 7, 9, 10, 11, 12}
    # All but what the one name, or number, that breaks the mapping cuts off.
    assert [r for r in found if r[0] == 2] == [(2, 1, 22, 19)] and [r[3] for r in found if r[0] == 13] == [15]


@pytest.mark.parametrize("small", [True, False])
def test_exact_copies_of_items_made_of_placeholders_match(spark, small):
    items = [(1, "Calculate 12 + 7 * 3 - 4 / 2"), (2, "The Old Man And The Sea By Ernest Hemingway In Cuba"), (3, "Paris London Berlin Rome Vienna Oslo"), (4, ITEM), (5, "Add 3 kg and 4 kg to 5 kg and 6 kg then take 7 kg away")]
    d = spark.createDataFrame([(k, f"some words before it {t} and some after") for k, t in items] + [(9, "Calculate 13 + 8 * 5 - 6 / 3"), (10, "some words before it Madrid London Berlin Rome Vienna Oslo")], "doc_id long, text string")
    found = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), small=small).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(1, 6)]
    assert all(r.covered == r.n_words for r in found if r.doc_id in (1, 2, 3))


def test_rows_that_share_ids_are_judged_alone_on_both_paths(spark):
    docs, items = cases()
    texts = [t for _, t in docs]
    halves = [" ".join(items[1][1].split()[:9]), " ".join(items[1][1].split()[9:])]
    d = spark.createDataFrame([*((1, t) for t in texts), *((None, t) for t in texts), *((2, t) for t in halves), docs[2], docs[2]], "doc_id long, text string")
    b = spark.createDataFrame([*((7, t) for _, t in items), (None, items[1][1]), items[4], items[4]], "item_id long, text string")
    one, other = (sorted(map(str, decontam.contaminated(d, b, small=small).collect())) for small in (True, False))
    assert one == other and len(one) > len(set(one))


def test_documents_that_hold_an_item_are_found(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {d.doc_id for d in documents.collect() if any(t in d.text for _, t in items)}
    found = {r.doc_id for r in decontam.contaminated(documents, bench).collect()}
    assert want <= found and len(found - want) <= 2
    kept = decontam.clean_documents(documents, bench)
    assert kept.schema == documents.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - found


def test_large_benchmark_path_of_the_filter(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame([(*r, 7, b"k", 3) for r in [*docs, docs[5], docs[5]]], "doc_id long, text string, mosaiq_row int, key binary, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontam.clean_documents(d, b).collect()))
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    monkeypatch.setattr(common, "PARTS", 5)
    other = decontam.clean_documents(d, b)
    assert other.schema == d.schema and sorted(map(str, other.collect())) == one
    assert all("mosaiq_row=7" in x for x in one) and sum("doc_id=6" in x for x in one) == 3


def test_hard_inputs(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs away"), (None, "lorem ipsum dolor sit amet lorem ipsum dolor")], "item_id long, text string")
    assert decontam.contaminated(hard, none).collect() == [] and decontam.contaminated(empty, some).collect() == []
    assert sorted((r.doc_id, r.item_id or 0) for r in decontam.contaminated(hard, some).collect()) == [(1, 1), (1, 1), (6, 0)]
    assert decontam.clean_documents(hard, some).count() == hard.count() - 3
    assert decontam.clean_documents(hard, none).schema == hard.schema


def test_longest_stretch_equals_all_parts():
    rng = random.Random(6)
    for _ in range(400):
        covered = sorted(rng.sample(range(30), rng.randint(1, 20)))
        pairs = {p: (rng.randint(1, 3), rng.randint(1, 3)) for p in covered if rng.random() < 0.5}
        best = 0
        for i in range(len(covered)):
            for j in range(i + 1, len(covered) + 1):
                held = {pairs[p] for p in covered[i:j] if p in pairs}
                if len({a for a, _ in held}) == len({b for _, b in held}) == len(held):
                    best = max(best, j - i)
        assert decontam.stretch(covered, pairs) == best
