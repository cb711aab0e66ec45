import zlib

import numpy as np
import pytest

from mosaiq.llm import quality, toxicity
from mosaiq.llm.labelled import linear, logistic, sigmoid


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize(("operator", "label", "least"), [(quality.quality_scores, "quality", 0.97), (toxicity.toxicity_scores, "toxic", 0.9)])
def test_held_out_accuracy(larger, operator, label, least):
    docs, labels = larger
    rows = operator(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == held(k) for k, h in zip(rows.doc_id, rows.held_out, strict=True))
    rows = rows[rows.held_out]
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) > least
    assert (rows.predicted == rows[label]).mean() > 0.95


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_other_columns_and_held_out_labels_change_nothing(spark, documents, labels, operator):
    from pyspark.sql import functions as F

    one = sorted((r.doc_id, r.score) for r in operator(documents, labels).collect())
    odd = documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).repartition(3)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = sorted((r.doc_id, r.score) for r in operator(odd, flipped).collect())
    assert one == two


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_hard_inputs(hard, empty, documents, labels, no_labels, operator):
    for marks in (labels, no_labels):
        found = operator(hard, marks).collect()
        assert len(found) == hard.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
        assert all(r.held_out == held(r.doc_id) for r in found)
        assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1
        assert operator(empty, marks).collect() == []


def test_lexicons_alone_decide_without_labels(spark, no_labels):
    docs = spark.createDataFrame([(1, "what a lovely day it is"), (2, "you stupid idiot moron, worthless scum")], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, no_labels).collect()}
    assert found == {1: 0, 2: 1}
    assert [r.doc_id for r in toxicity.accepted(docs, no_labels).collect()] == [1]


def test_label_model_finds_rates_and_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    rates = [(0.02, 0.7), (0.05, 0.6), (0.01, 0.5), (0.1, 0.6)]
    votes = np.array([np.where(y, rng.random(4000) < b, rng.random(4000) < a) for a, b in rates]).T.astype(float)
    votes = np.hstack([votes, votes[:, [3]], votes[:, [3]]])
    model = toxicity.label_model(votes)
    assert ((model["posterior"] > 0.5) == y).mean() > 0.88
    assert model["rates"][1, 0] == pytest.approx(0.7, abs=0.12) and model["rates"][0, 0] < 0.06
    assert (model["share"][[3, 4, 5]] < 0.6).all() and model["share"][0] > model["share"][3]


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [1.5, -2, 0] + 0.3 + rng.normal(size=500) > 0).astype(float)
    w = logistic(x, y, ridge=0.5)
    grad = np.hstack([x, np.ones((500, 1))]).T @ (sigmoid(x @ w[:-1] + w[-1]) - y) + np.append(0.5 * w[:-1], 1e-6 * w[-1])
    assert np.abs(grad).max() < 1e-5


def test_a_wide_fit_takes_little_memory():
    """Terms as bytes beside a column of doubles: the coefficients of one matrix of doubles, which would take 64 MB and each copy as much."""
    import tracemalloc

    rng = np.random.default_rng(2)
    terms, hits = (rng.random((20_000, 400)) < 0.01).astype(np.uint8), rng.random((20_000, 1))
    y = sigmoid(terms[:, :5].sum(axis=1) * 2.0 - 1)
    tracemalloc.start()
    w = logistic((terms, hits), y, ridge=2.0)
    z = linear((terms, hits), w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    x = np.hstack([terms, hits])
    assert np.allclose(z, x @ w[:-1] + w[-1], atol=1e-9)
    assert np.allclose(w, logistic(x, y, ridge=2.0), atol=1e-9)


def test_the_fit_of_toxicity_takes_little_memory(documents, labels, monkeypatch):
    """What the fit is given: terms and votes as bytes, not doubles."""
    given = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, **more: given.append(x) or logistic(x, y, **more))
    toxicity.fit(documents, labels)
    assert [p.dtype for p in given[0]] == [np.uint8, np.uint8, np.float64] and given[0][2].shape[1] == 1


def test_quality_scores_equal_a_loop(documents, labels):
    import zstandard

    model = quality.fit(documents, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[k]), level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) for k in ("good", "bad")]
    for r in quality.quality_scores(documents, labels).collect():
        text, sizes = texts[r.doc_id], [0, 0]
        for start in range(0, len(text), 1024):
            for k in (0, 1):
                sizes[k] += len(packers[k].compress(text[start : start + 1024]))
        d = (sizes[1] - sizes[0]) / len(text) if text else 0.0
        assert r.difference == pytest.approx(d, abs=1e-12)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model["slope"] * d + model["base"]))), abs=1e-12)
        assert r.predicted == (r.score >= 0.3)


def test_mined_terms_and_toxicity_scores_equal_a_loop(documents, labels):
    import math

    kinds = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    seen = {0: {}, 1: {}}
    for k, toxic in kinds.items():
        for t in {t for w in {w.strip(toxicity.EDGES) for w in texts[k].lower().split()} if w for t in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)]}:
            seen[toxic][t] = seen[toxic].get(t, 0) + 1
    n = [sum(v == c for v in kinds.values()) for c in (0, 1)]
    alike = {}
    for t, c in seen[1].items():
        strength = math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0].get(t, 0) + 0.5) / (n[0] + 1))
        if c >= toxicity.SUPPORT and strength >= math.log(20):
            key = (t.rstrip("*")[:4], c, seen[0].get(t, 0))
            alike[key] = min(alike.get(key, (99, "")), (len(t), t, -c * strength), key=lambda x: x[:2])
    mined = [t for _, t, _ in sorted(alike.values(), key=lambda x: (round(x[2], 9), x[0], x[1]))][: toxicity.TERMS]
    model = toxicity.fit(documents, labels)
    fixed = [w for kind in toxicity.LEXICONS.values() for w in kind.split()]
    assert model["terms"] == fixed + [t for t in mined if t not in fixed]
    groups, lexical, w = {t: int(v) for t, v in zip(model["terms"], model["voter"], strict=True)}, len(toxicity.LEXICONS), model["w"]
    for r in toxicity.toxicity_scores(documents, labels).collect():
        raw, low = texts[r.doc_id].split(), texts[r.doc_id].lower().split()
        hits = []
        for k, word in enumerate(low):
            word = word.strip(toxicity.EDGES)
            held = [t for t in [word, *(word[:m] + "*" for m in (4, 5, 6) if len(word) >= m)] if t in groups] if word else []
            if held:
                hits.append((k, held))
        votes = {groups[t] for _, held in hits for t in held}
        strong = [k for k, held in hits if any(groups[t] < lexical for t in held)]
        base = lexical + toxicity.GROUPS
        rules = [any(x in toxicity.SECOND_PERSON for k in strong for x in low[max(0, k - 3) : k]), len(hits) >= 3, bool(hits) and len(hits) * 50 >= len(low), any(raw[k].isupper() for k in strong)]
        votes |= {base + k for k, rule in enumerate(rules) if rule}
        z = w[-1] + sum(w[model["terms"].index(t)] for t in {t for _, held in hits for t in held}) + sum(w[len(model["terms"]) + v] for v in votes) + (w[-2] * math.log1p(len(hits)) if hits else 0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_label_model_reaches_the_direct_likelihood():
    """With voters that are independent within a class, no rates near the fitted ones make the votes likelier."""
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.3
    votes = np.array([np.where(y, rng.random(20_000) < b, rng.random(20_000) < a) for a, b in ((0.05, 0.8), (0.1, 0.7), (0.02, 0.6), (0.08, 0.75), (0.03, 0.65))]).T.astype(float)
    model = toxicity.label_model(votes, rounds=300)

    def likelihood(rates, prior):
        both = [np.log(p) + (votes * np.log(r) + (1 - votes) * np.log(1 - r)).sum(axis=1) for p, r in ((1 - prior, rates[0]), (prior, rates[1]))]
        return np.logaddexp(*both).mean()

    best = likelihood(model["rates"], model["prior"])
    assert model["prior"] == pytest.approx(0.3, abs=0.02)
    for _ in range(40):
        moved = np.clip(model["rates"] + rng.normal(scale=0.03, size=model["rates"].shape), 0.001, 0.999)
        assert likelihood(moved, model["prior"]) < best + 1e-4
