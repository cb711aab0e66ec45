import importlib.util
from collections import defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from mosaiq.llm import decontam, mix, neardup, pii, toxicity
from mosaiq.llm.queries import ORACLES


def sibling(name):
    """Another test module's brute force."""
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "personal-data", "mix"]


def test_each_stage_against_its_operator(spark, sf_dir, documents):
    """Every stage works on all that its predecessor kept, and its decisions take effect."""
    docs = documents
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = corpus_pipeline.toxic(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert out.schema == docs.schema and ids(out) == sorted(k for k, p in scores.items() if not p)
    docs = out
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == sorted(r.doc_id for r in neardup.near_duplicates(docs, 80).collect() if r.kept)
    docs = out
    out = corpus_pipeline.benchmark(spark, docs, sf_dir)
    bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert out.schema == docs.schema and ids(out) == [k for k in ids(docs) if k not in bad]
    docs = out
    out = corpus_pipeline.personal_data(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        found = [s for part in pii.spans_of(before[r.doc_id], pii.trained()) for s in part]
        assert r.text == pii.masked(before[r.doc_id], found) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)
    docs = out
    copies = {r.doc_id: r.copies for r in mix.mix_report(docs).collect()}
    rows = corpus_pipeline.mixture(spark, docs, sf_dir).collect()
    for k, n in copies.items():
        assert sorted(r.copy for r in rows if r.doc_id == k) == list(range(n))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_hard_and_empty_tables(spark, sf_dir, documents, k):
    _, stage = corpus_pipeline.STAGES[k]
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", None, 0), (2, "a b c " * 50_000, "en", "s", 1), (2, "a b c " * 50_000, "en", "s", 1)], documents.schema)
    rows = sorted(str(r.doc_id) for r in stage(spark, odd, sf_dir).collect())
    # Repeated rows are one group; the mix takes documents with words as often as their sources' targets say.
    assert set(rows) <= {"None", "1", "2"} if k == 4 else rows == (["1", "2", "None"] if k == 1 else ["1", "2", "2", "None"])
    assert stage(spark, spark.createDataFrame([], documents.schema), sf_dir).collect() == []


def contaminated(text, items, words):
    """Whether an item's windows on one diagonal of the text, by a dictionary of all windows, have a long enough consistent stretch."""
    ids, slot, raw = decontam.template(text.encode(), words)
    value, out = decontam.value, False
    windows = {}
    for width in {min(decontam.WIDTH, len(w)) for w, _, _ in items if len(w) >= decontam.LEAST}:
        for k in range(len(ids) - width + 1):
            windows.setdefault(tuple(ids[k : k + width].tolist()), []).append(k)
    for want, want_slot, want_raw in items:
        n, width = len(want), min(decontam.WIDTH, len(want))
        if n < decontam.LEAST:
            continue
        runs = defaultdict(set)
        for p in range(n - width + 1):
            if 2 * sum(want_slot[p : p + width]) < width:
                for k in windows.get(tuple(want[p : p + width].tolist()), ()):
                    runs[k - p] |= set(range(p, p + width))
        for shift, covered in runs.items():
            pairs = {p: (value(want_raw[p]), value(raw[p + shift])) for p in covered if want_slot[p]}
            out |= decontam.stretch(sorted(covered), pairs) >= max(width, min(decontam.ENOUGH, n / 2))
    return out


def test_run_equals_brute_force(spark, sf_dir, documents):
    """The whole run: scores of the classifier, all pairs of sets, all windows, base patterns by regular expressions, the mix in SQL."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity_scores(documents, labels).collect() if r.predicted}
    docs = {r.doc_id: r for r in documents.collect() if r.doc_id not in toxic}
    groups = sibling("test_neardup").brute([(k, r.text) for k, r in docs.items()], 80)
    docs = {k: r for k, r in docs.items() if groups[k][1] == k}
    words = decontam.Words()
    items = [decontam.template((r.text or "").encode(), words) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {k: r for k, r in docs.items() if not contaminated(r.text or "", items, words)}
    base, weights = sibling("test_pii").brute, pii.trained()
    texts = {}
    for k, r in docs.items():
        spans = base(r.text or "")
        texts[k] = pii.masked(r.text, spans + pii.decode(r.text, weights, spans)) if r.text else r.text
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": list(docs), "text": list(texts.values()), "source": [r.source for r in docs.values()]}))
    want = {r["doc_id"]: (r["copies"], r["position"]) for r in c.execute(ORACLES["op1_mix"]).df().to_dict("records")}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    copies = defaultdict(list)
    for r in rows:
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)
        copies[r.doc_id].append((r.copy, r.position))
    assert {k: len(v) for k, v in copies.items()} == {k: n for k, (n, _) in want.items() if n}
    assert all(min(v)[1] == pytest.approx(want[k][1], abs=1e-9) for k, v in copies.items())
    assert [r.position for r in rows] == sorted(r.position for r in rows)
