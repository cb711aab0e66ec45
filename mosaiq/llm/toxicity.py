"""Toxicity by weak supervision.

Voters look at a text's words: fixed lexicons by kind, patterns (an insult after "you", repetition, shouting), and groups
of terms mined from labelled rows (words, and word beginnings written `stem*`, that occur mostly in toxic ones). A
generative label model gives each voter its rates of voting in toxic and clean texts by expectation maximisation, without
labels. Voters that agree beyond what the class explains count as one: a voter's evidence is divided by the sum of its
residual correlations. The posteriors are the training labels of a linear classifier over terms and votes, whose output
is calibrated on labelled rows. Only rows that may be learned from are used; ids, languages and sources never are inputs.

Defined results: ids are integers; null and empty texts get the score of a text without any hit; without labelled rows of both classes the
lexicons alone decide; repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import MOST_WORDS, arrow_map, held, spread, train_fold
from mosaiq.llm.labelled import linear, logistic, sample, sigmoid

#: Everyday words of abuse by kind.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile fool dumbass jackass dimwit halfwit cretin dunce nitwit",
    "belittle": "stupid dumb pathetic worthless useless brainless clueless ridiculous laughable",
    "contempt": "scum trash garbage vermin filth disgusting disgrace parasite lowlife",
    "mock": "clown loser losers freak creep weirdo coward crybaby joke",
    "profane": "damn crap bastard bitch asshole shit fuck fucking piss whore slut",
    "threat": "kill murder hurt destroy strangle stab beat shoot hang",
}
SECOND_PERSON = {"you", "your", "you're", "youre", "ur", "u"}
#: Labelled rows of a class that are learned from; mined terms; toxic rows a term must occur in; groups of terms that vote.
PER_CLASS, TERMS, SUPPORT, GROUPS = 10_000, 400, 4, 16
PREFIXES = (4, 5, 6)
EDGES = "\"'`.,;:!?()[]{}<>|*#$%&@~_=+-/\\“”‘’«»…"


def stem_terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Terms(dict):
    """Raw lower-cased word -> ids of the terms that it contains (a tuple, mostly empty), remembered up to a bound."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.ids = {t: i for i, t in enumerate(terms)}

    def __missing__(self, raw: str) -> tuple[int, ...]:
        word = raw.strip(EDGES)
        out = tuple(self.ids[t] for t in stem_terms(word) if t in self.ids) if word else ()
        if len(self) < MOST_WORDS and len(raw) <= 64:
            self[raw] = out
        return out


def vocabulary(mined: list[str]) -> tuple[list[str], np.ndarray]:
    """Terms, lexicon words first, and the voter of each: lexicons, then groups of mined terms dealt in turn."""
    words = [w for kind in LEXICONS.values() for w in kind.split()]
    voter = [k for k, kind in enumerate(LEXICONS.values()) for _ in kind.split()]
    new = [t for t in mined if t not in set(words)]
    return words + new, np.array(voter + [len(LEXICONS) + k % GROUPS for k in range(len(new))])


PATTERNS = 4
VOTERS = len(LEXICONS) + GROUPS + PATTERNS


def features(text: str, terms: Terms, voter: np.ndarray) -> tuple[list[int], list[int], int]:
    """Distinct term ids, voters that vote, number of hits. Whole texts are read."""
    raw = text.split()
    low = text.lower().split() if len(raw) else []
    hits = [(k, ids) for k, ids in enumerate(map(terms.__getitem__, low)) if ids]
    if not hits:
        return [], [], 0
    found = {i for _, ids in hits for i in ids}
    votes = {int(voter[i]) for i in found}
    base, lexical = len(LEXICONS) + GROUPS, len(LEXICONS)
    strong = [k for k, ids in hits if any(voter[i] < lexical for i in ids)]
    if any(w in SECOND_PERSON for k in strong for w in low[max(0, k - 3) : k]):
        votes.add(base)
    if len(hits) >= 3:
        votes.add(base + 1)
    if len(hits) * 50 >= len(low):
        votes.add(base + 2)
    if len(raw) == len(low) and any(raw[k].isupper() for k in strong):
        votes.add(base + 3)
    return sorted(found), sorted(votes), len(hits)


def label_model(votes: np.ndarray, rounds: int = 50) -> dict:
    """Fit P(vote | class) and the share of the class without labels. votes: rows x voters of 0 / 1. Returns rates (2 x voters), share of each voter's
    evidence that counts, prior, and posteriors of the rows."""
    n, m = votes.shape
    any_vote = votes.any(axis=1)
    q = np.where(any_vote, 0.9, 0.02)
    share = np.ones(m)
    rates = np.full((2, m), 0.5)
    for _ in range(rounds):
        for y, p in ((0, 1 - q), (1, q)):
            rates[y] = (p @ votes + (0.02, 0.5)[y]) / (p.sum() + 1)
        prior = float(np.clip((q.sum() + 1) / (n + 2), 0.005, 0.6))
        # Agreement that the class doesn't explain, per pair of voters.
        z = votes - (q[:, None] * rates[1] + (1 - q)[:, None] * rates[0])
        c = z.T @ z / n
        sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
        share = 1 / np.maximum(np.clip(c / sd[:, None] / sd, 0, 1).sum(axis=0), 1)
        q = posterior(votes, rates, share, prior)
    return {"rates": rates, "share": share, "prior": prior, "posterior": q}


def posterior(votes: np.ndarray, rates: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    r = np.clip(rates, 1e-4, 1 - 1e-4)
    fired = np.log(r[1] / r[0])
    # Silence of a single voter says little: few texts hold the words of any one lexicon.
    silent = np.log((1 - r[1]) / (1 - r[0]))
    return sigmoid(votes @ (share * fired) + (1 - votes) @ (share * silent) + np.log(prior / (1 - prior)))


def mine(rows: DataFrame) -> list[str]:
    """Terms of toxic rows, by how surely they tell toxic from clean ones: at least 20 times as frequent there, and of those that
    begin alike and count alike the shortest. Counted and ranked by Spark; only the TERMS best come to the driver."""

    def tally(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(EDGES) for w in words_of(text or "")}
                seen.update((t, label) for t in {t for w in words if w for t in stem_terms(w)})
        # A term of one row of a partition can still reach the support elsewhere, so all are told.
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "label", "n"])

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    part = rows.select("text", "label").repartition(8).mapInArrow(tally, "term string, label int, n long")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0))
    counts = part.groupBy("term").agg(of(1).alias("toxic"), of(0).alias("clean")).where(F.col("toxic") >= SUPPORT)
    strength = F.ln((F.col("toxic") + 0.5) / (max(sizes.get(1, 0), 1) + 1)) - F.ln((F.col("clean") + 0.5) / (max(sizes.get(0, 0), 1) + 1))
    sure = counts.withColumn("strength", strength).where(F.col("strength") >= float(np.log(20)))
    alike = sure.groupBy(F.substring(F.rtrim("term", F.lit("*")), 1, 4), "toxic", "clean").agg(F.min(F.struct(F.length("term").alias("length"), "term")).alias("t"), F.max("strength").alias("strength"))
    return [r.term for r in alike.select("t.*", (F.col("toxic") * F.col("strength")).alias("weight")).orderBy(F.desc("weight"), "length", "term").limit(TERMS).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Terms, voters, and the linear classifier's coefficients: terms, votes, log of hits, intercept."""
    rows = sample(docs, labels, "toxic", per_class)
    terms, voter = vocabulary(mine(rows))

    def run(batch: pa.RecordBatch):
        known = held("toxicity terms", tuple(terms), lambda: Terms(terms))
        found = [features(x or "", known, voter) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.int64()), batch.column(1)], names=["terms", "votes", "hits", "label"])

    seen = sorted((r.label, r.hits, list(r.terms), list(r.votes)) for r in arrow_map(rows.select("text", "label"), run, "terms array<int>, votes array<int>, hits long, label int").collect())
    y = np.array([r[0] for r in seen], float)
    if len(set(y)) < 2:
        w = np.zeros(len(terms) + VOTERS + 2)
        w[-2], w[-1] = 4.0, -2.5
        return {"terms": terms, "voter": voter, "w": w}
    # Terms and votes are bytes: as doubles they and the fit's copies took hundreds of MB of the driver.
    occur, votes = np.zeros((len(seen), len(terms)), np.uint8), np.zeros((len(seen), VOTERS), np.uint8)
    for k, (_, _, ids, voted) in enumerate(seen):
        occur[k, ids] = 1
        votes[k, voted] = 1
    x = occur, votes, np.log1p([[float(r[1])] for r in seen])
    model = label_model(votes.astype(float))
    w = logistic(x, model["posterior"], ridge=2.0)
    slope, base = logistic(linear(x, w)[:, None], y, ridge=1e-3)
    return {"terms": terms, "voter": voter, "w": np.append(w[:-1] * max(slope, 1e-3), w[-1] * max(slope, 1e-3) + base)}


class Scorer:
    """Scores texts by a fitted model."""

    def __init__(self, model: dict):
        self.model = model

    def scores(self, texts: list[str | None]) -> np.ndarray:
        terms = held("toxicity terms", tuple(self.model["terms"]), lambda: Terms(self.model["terms"]))
        w, n, voter = self.model["w"], len(self.model["terms"]), self.model["voter"]
        z = []
        for text in texts:
            ids, votes, hits = features(text or "", terms, voter)
            z.append(w[-1] + w[ids].sum() + w[[n + v for v in votes]].sum() + w[-2] * np.log1p(hits) if hits else w[-1])
        return sigmoid(np.array(z, float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row."""
    scorer = Scorer(fit(docs, labels, per_class))

    def run(batch: pa.RecordBatch):
        score = scorer.scores(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), train_fold(F.col(id_col))[0].alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(spread(rows), run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    scorer, at = Scorer(fit(docs, labels, per_class)), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < threshold))

    return arrow_map(spread(docs), run, docs.schema)
