from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import mix


def level_fill(sizes, weights):
    """Targets by resharing the excess until none is above its cap."""
    total, out, left = sum(sizes.values()), {}, dict(sizes)
    rest = float(total)
    while left:
        whole = sum(weights[s] for s in left)
        full = [s for s in left if 3 * sizes[s] < rest * weights[s] / whole]
        if not full:
            return out | {s: rest * weights[s] / whole for s in left}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
            del left[s]
    return out


def test_targets_and_taken(spark, documents):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 41 == 0, "tiny").otherwise(F.col("source")))
    found = mix.mix_report(docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        s = texts[r.doc_id].source
        assert r.size == len((texts[r.doc_id].text or "").encode().split())
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = level_fill(dict(sizes), weights)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    assert all(r.source_size == sizes[texts[r.doc_id].source] for r in found)


def test_buckets_do_not_change_the_sums(documents, monkeypatch):
    whole = sorted(mix.mix_report(documents).collect())
    monkeypatch.setattr(mix, "PER_BUCKET", 3)
    again = sorted(mix.mix_report(documents).collect())
    assert [(r.doc_id, r.taken, r.position) for r in whole] == [(r.doc_id, r.taken, r.position) for r in again]


def test_curriculum_is_sorted_and_follows_its_schedule(documents):
    rows = mix.curriculum(documents).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    report = {r.doc_id: r.copies for r in mix.mix_report(documents).collect()}
    assert sum(report.values()) == len(rows)
    assert set(documents.columns) < set(rows[0].asDict())


@pytest.mark.parametrize("knots", mix.SCHEDULES)
def test_inverse_undoes_the_integral(spark, knots):
    shares = spark.createDataFrame([(k / 50,) for k in range(51)], "share double")
    for r in shares.select("share", mix.inverse(knots, F.col("share")).alias("t")).collect():
        assert mix.integral(knots, r.t) == pytest.approx(r.share, abs=1e-9)


def test_hard_inputs(hard, empty):
    found = mix.mix_report(hard).collect()
    assert len(found) == hard.count()
    assert all(r.size == 0 for r in found if r.doc_id in (2, 3, 4))
    assert mix.mix_report(empty).collect() == []
    wordless = mix.mix_report(hard.where("doc_id in (2, 3, 4)")).collect()
    assert [(r.target, r.taken) for r in wordless] == [(0.0, 0)] * 3
    order = mix.curriculum(hard)
    assert sorted(order.columns) == sorted(hard.columns) and all(r.size == 1 for r in order.collect())
    assert mix.curriculum(empty).collect() == []


def test_rows_without_ids_are_dealt_apart_and_reruns_agree(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(5)) for k in range(60)]
    rows = [(None, t, "s") for t in texts] + [(1, "a b c", "s"), (1, "a b c", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mix.assign(df)
    assert one.select("mark").distinct().count() == 61
    order = [(r.text, r.copy, r.position) for r in mix.curriculum(df).collect()]
    other = [(r.text, r.copy, r.position) for r in mix.curriculum(df.orderBy(F.desc("text")).repartition(7)).collect()]
    assert order == other and len({p for _, _, p in order}) == len(order)
