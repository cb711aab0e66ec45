"""URL filters: rules first, then a character language-model ratio. DataFrame functions only.

Two variable-order Markov models of characters, of accepted and of rejected URLs, are smoothed order by order:
p_k(c | ctx) = (n(ctx, c) + d(ctx) * p_{k-1}(c | shorter ctx)) / (n(ctx) + d(ctx)), where d is the number of different
characters seen after ctx. A URL's score is the mean over its characters of ln p_accepted - ln p_rejected. Held-out URLs of
both kinds calibrate it: normal curves of one width about the two kinds' mean scores give the probability of rejection.

The model reads the whole URL: scheme, host, path, query and fragment. URLs to learn from: those whose host holds a word of a
seed list are rejected ones; those without such a word that no rule blocks are accepted ones. Counts cover all of them; one
fold of five only calibrates.

Plan: distinct URLs get a number and are cut once into windows of ORDER + 1 characters, which are written with that number;
windows are counted, and all lower orders are sums of those counts. Scores of distinct windows meet the written windows
again. A window that holds more than one PARTS-th of all of them is dealt into salted copies; there are at most PARTS of these.

Defined results: a null URL is judged as an empty one; a URL without :// has an empty host and path and no rule, and is
judged by all its characters; without URLs of both kinds the model allows all. The characters 2 and 3, which URLs cannot
hold, count as what pads a URL. Time is linear in a URL's length. Ids may have any type, be null and repeat: each row gets
a row. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import PARTS, discard, spread, written

ORDER = 4
#: Words of hosts that are taken as rejected to learn from.
SEEDS = ("spam", "pills", "casino", "adult", "porn", "xxx", "viagra", "bets", "ads-", "tracker", "malware", "phish", "warez")
#: Padding before and after a URL; both are characters that URLs cannot hold.
START, END = "\x02", "\x03"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host_col: Column, path_col: Column, rules: list[tuple[str, str, bool]]) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule (host, path, allow) that fits; null if none does."""
    name, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, allow in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == h) | F.endswith(host_col, F.lit(f".{h}"))) & F.startswith(path_col, F.lit(p))
        name, allowed = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(allow)).otherwise(allowed)
    return name, allowed


def window_list(text: Column) -> Column:
    """All windows of ORDER + 1 characters of a padded text. Characters are cut apart once, as to find the k-th takes k steps."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    letters = F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0))
    out = F.slice(letters, 1, F.length(text) + 1)
    for k in range(1, ORDER + 1):
        out = F.zip_with(out, F.slice(letters, k + 1, F.length(text) + 1), lambda x, y: F.concat(x, y))
    return out


def window_scores(windows: DataFrame) -> DataFrame:
    """gram -> ln p_accepted - ln p_rejected. windows: gram (distinct), good, bad (training counts, may be 0)."""
    letters = windows.select(F.substring("gram", ORDER + 1, 1).alias("gram"), "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    sums = letters.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count_if(F.col("good") > 0).alias("d_good"), F.count_if(F.col("bad") > 0).alias("d_bad"), F.count("*").alias("n")).first()
    floor = 1.0 / ((sums.n or 0) + 1)
    blend = lambda c, n, d, p: (F.col(c) + d * p) / (n + d)
    lower = letters.select("gram", *[blend(c, F.lit(sums[c] or 0), F.lit(max(sums[f"d_{c}"] or 0, 1)), F.lit(floor)).alias(f"p_{c}") for c in ("good", "bad")])
    for k in range(1, ORDER + 1):
        # Tables of order k hold only what windows of that order hold, so each is at most the table of windows.
        here = windows.select(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram"), "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        here = here.withColumn("ctx", F.substring("gram", 1, k)).withColumn("rest", F.substring("gram", 2, k))
        ctx = here.groupBy("ctx").agg(*[f(c) for c in ("good", "bad") for f in (lambda c: F.sum(c).alias(f"n_{c}"), lambda c: F.count_if(F.col(c) > 0).alias(f"d_{c}"))])
        both = here.join(ctx, "ctx").join(lower.withColumnRenamed("gram", "rest"), "rest")
        lower = both.select("gram", *[F.when(F.col(f"n_{c}") > 0, blend(c, F.col(f"n_{c}"), F.col(f"d_{c}"), F.col(f"p_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("good", "bad")])
    return lower.select("gram", (F.ln("p_good") - F.ln("p_bad")).alias("gain"))


def model_scores(urls: DataFrame) -> DataFrame:
    """n, score. urls: n (unique number), text, learn (may be counted), kind (true accepted, false rejected, null neither)."""
    cut = spread(urls).select("n", F.when(F.col("learn"), F.col("kind")).alias("kind"), F.explode(window_list(F.col("text"))).alias("gram"))
    cut = written(cut, "url-cut")
    counted = written(cut.groupBy("gram").agg(F.count_if("kind").alias("good"), F.count_if(~F.col("kind")).alias("bad"), F.count("*").alias("times")), "url-windows")
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    most = total // PARTS + 1
    gains = window_scores(counted).join(counted.select("gram", F.ceil(F.col("times") / most).cast("int").alias("copies")), "gram")
    gains = written(gains.withColumn("gain", F.round(F.col("gain") * 1_000_000).cast("long")), "url-gains")
    # At most PARTS windows are that frequent.
    hot = F.broadcast(gains.where("copies > 1").select("gram", "copies"))
    salted = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("gram", "salt", "gain")
    dealt = cut.join(hot, "gram", "left").select("n", "gram", F.pmod(F.xxhash64("n"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"))
    # Sums of fixed-point gains don't depend on the order of rows.
    summed = dealt.join(salted, ["gram", "salt"]).groupBy("n").agg(F.sum("gain").alias("gain"), F.count("*").alias("windows"))
    out = written(summed.select("n", (F.col("gain") / F.col("windows") / 1_000_000).alias("score")), "url-sums")
    discard(cut, counted, gains)
    return out


def rejection(scores: DataFrame) -> Column | None:
    """Probability of rejection as an expression of `score`, from the held-out rows (score, kind); None without both kinds."""
    stats = {r.kind: r for r in scores.groupBy("kind").agg(F.avg("score").alias("m"), F.var_pop("score").alias("v"), F.count("*").alias("n")).collect()}  # two rows
    if True not in stats or False not in stats:
        return None
    bad, good = stats[False], stats[True]
    spread = max((bad.v * bad.n + good.v * good.n) / (bad.n + good.n), 1e-4)
    odds = ((F.col("score") - good.m) ** 2 - (F.col("score") - bad.m) ** 2) / (2 * spread)
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(35.0)), F.lit(-35.0))))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, bool]], seeds: tuple[str, ...] = SEEDS, most: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score and p_reject of each row. A URL without a rule is blocked if p_reject > most."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("text"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, allowed = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("allowed", allowed)
    seed = F.lit(False)
    for s in seeds:
        seed = seed | F.contains(F.col("host"), F.lit(s))
    kind = F.when(seed, F.lit(False)).when(F.coalesce("allowed", F.lit(True)), F.lit(True))
    # Rules' and seeds' answers are functions of the text.
    urls = rows.select("text", kind.alias("kind")).groupBy("text").agg(F.bool_and("kind").alias("kind"))
    held_out = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0
    urls = written(urls.withColumn("learn", ~held_out).withColumn("n", F.monotonically_increasing_id()), "urls")
    scores = written(urls.join(model_scores(urls), "n"), "url-scores")
    p = rejection(scores.where(~F.col("learn") & F.col("kind").isNotNull()))
    scores = scores.withColumn("p_reject", F.lit(0.0) if p is None else p).select("text", "score", "p_reject")
    out = rows.join(scores, "text", "left")
    verdict = F.when(F.coalesce("allowed", F.coalesce("p_reject", F.lit(0.0)) <= most), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "p_reject")
