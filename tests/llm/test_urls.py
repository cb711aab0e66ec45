import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import urls
from mosaiq.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def rule_of(host, path):
    fit = [(len(h + p), h + p, allow) for h, p, allow in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


ODD = ["http://A.Example.ORG/en/1?x", "no scheme", "", None, "ftp://x", "a://b://c/d", "http://EXAMPLE.org/es/\n/x", "http://org/", "http://x.com", "http://x.com?/fr/", "://", "http://notexample.org/es/a"]


def test_hosts_paths_and_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit(1).alias("host"), F.lit("z").alias("text"))
    pages = pages.union(spark.createDataFrame([(1000 + k, u, 1, "z") for k, u in enumerate(ODD)], "page_id long, url string, host int, text string"))
    want = {r.page_id: r.url for r in pages.collect()}
    found = urls.url_verdicts(pages, URL_RULES).collect()
    assert len(found) == len(want)
    for r in found:
        host, path = split(want[r.page_id])
        rule, allow = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), want[r.page_id]
        assert r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == ("allow" if allow else "block")


def brute_gains(grams):
    """ln ratio of every window by recursion over its shorter contexts; grams: {gram: (good, bad)}."""
    def prob(side, ctx, c):
        if ctx is None:
            return 1 / (len({g[-1] for g in grams}) + 1)
        k = len(ctx)
        after = defaultdict(int)
        for g, n in grams.items():
            if g[-k - 1 : -1] == ctx or k == 0:
                after[g[-1]] += n[side]
        total, kinds = sum(after.values()), sum(n > 0 for n in after.values())
        shorter = prob(side, ctx[1:] if k else None, c)
        if k and not total:
            return shorter
        kinds = max(kinds, 1) if not k else kinds
        return (after[c] + kinds * shorter) / (total + kinds)

    return {g: math.log(prob(0, g[:-1], g[-1])) - math.log(prob(1, g[:-1], g[-1])) for g in grams}


def test_window_scores_against_recursion(spark):
    def cut(text):
        padded = urls.START * urls.ORDER + text + urls.END
        return [padded[k : k + urls.ORDER + 1] for k in range(len(text) + 1)]

    good, bad = Counter(), Counter()
    for t in ("abcab", "abd", "aab", "cabba"):
        good.update(cut(t))
    for t in ("xyxy", "xab", "yyx"):
        bad.update(cut(t))
    unseen = [g for t in ("axb", "zz") for g in cut(t)]
    grams = {g: (good[g], bad[g]) for g in {*good, *bad, *unseen}}
    df = spark.createDataFrame([(g, a, b) for g, (a, b) in grams.items()], "gram string, good long, bad long")
    want = brute_gains(grams)
    found = {r.gram: r.gain for r in urls.window_scores(df).collect()}
    assert found.keys() == want.keys()
    for g in want:
        assert found[g] == pytest.approx(want[g], abs=1e-9)


def test_model_tells_kinds_apart(spark):
    rows = [(k, f"http://news{k % 7}.site.net/en/{k}") for k in range(300)] + [(1000 + k, f"http://spam-farm{k % 5}.site.net/en/{k}") for k in range(60)]
    found = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert sum((r.verdict == "block") != (r.page_id >= 1000) for r in found) <= 3


def test_empty_and_one_kind(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_verdicts(none, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x", 1, "a"), (None, None, 2, "b"), (1, "http://a.net/x", 3, None)], "page_id long, url string, n int, gram string")
    assert [r.verdict for r in urls.url_verdicts(one, URL_RULES).collect()] == ["allow"] * 3


def test_main_path_is_native(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = urls.url_verdicts(pages, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_whole_url_is_judged(spark):
    base = "http://site1.example.net/en/1"
    texts = [base, base + "?go=casino-bets-viagra-xxx", base + "#casino-pills", "https" + base[4:], "not a url casino", "", None, "\x02\x03\x02", "\U0001f600://café.net/\U0001f600"]
    learn = [(100 + k, f"http://news{k % 7}.site.net/en/{k}") for k in range(200)] + [(1000 + k, f"http://casino-bets{k % 5}.site.net/viagra-xxx/{k}") for k in range(60)]
    pages = spark.createDataFrame([*enumerate(texts), *learn], "page_id long, url string")
    found = {r.page_id: r for r in urls.url_verdicts(pages, []).collect()}
    assert len({found[k].score for k in range(6)}) == 6 and found[5].score == found[6].score
    assert found[1].score < found[0].score and found[1].p_reject >= found[0].p_reject
    assert all(found[k].host == found[k].path == "" for k in (4, 5, 6, 7)) and found[8].host == "café.net"


def test_window_list_and_long_urls(spark):
    texts = ["", "a", "\U0001f600bé", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", urls.window_list(F.col("t")).alias("w"))
    for r in df.collect():
        padded = urls.START * urls.ORDER + texts[r.k] + urls.END
        assert r.w == [padded[k : k + urls.ORDER + 1] for k in range(len(texts[r.k]) + 1)]


def test_dealing_out_frequent_windows_changes_nothing(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = sorted(map(str, urls.url_verdicts(pages, URL_RULES).collect()))
    monkeypatch.setattr(urls, "PARTS", 1_000_000)
    assert sorted(map(str, urls.url_verdicts(pages, URL_RULES).collect())) == one
