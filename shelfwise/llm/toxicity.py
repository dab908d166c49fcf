"""Toxic passages as maximum-scoring segments.

Each word carries a log-odds of toxic against clean documents under an informative Dirichlet prior,
less a drift, so that ordinary text scores below zero. One linear scan (Ruzzo and Tompa) finds all
maximal segments of a text. How high the best segment of a clean text of n words reaches follows an
extreme-value law, fitted to clean documents; a segment is significant by its probability under
that law, the evidence of all significant segments adds up, and the sum is turned into a
probability. Both are fitted crosswise: each half of the training documents is scored with the
log-odds of the other half, so no document vouches for itself. The log-odds in use come from both
halves.

A word that was not seen in training is judged by its first five, else its first four letters.
"""

from __future__ import annotations

from collections import Counter
from math import log, pi, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import fold, map_batches, texts, with_labels
from shelfwise.scale import written

FOLDS, HELD_OUT = 3, 1
HALVES = (0, 2)
STRIP = ".,;:!?\"'()[]"
#: Prior strength in uses, the least uses of a feature, and features that chance may keep.
PRIOR, LEAST_USES, CHANCE = 1000.0, 3, 10
DRIFT, MOST = 1.0, 6.0
#: A passage is significant when a clean text of its length reaches its score this rarely.
SIGNIFICANT = 0.01
EULER = 0.5772156649015329


def word_features(word: str) -> list[str]:
    """The word, then its beginnings, most telling first."""
    w = word.strip(STRIP)
    if not w:
        return []
    return [f"={w}", *[f"{n}{w[:n]}" for n in (5, 4) if len(w) >= n]]


def feature_counts(docs: DataFrame) -> DataFrame:
    """feature and, per half, documents that hold it: toxic0, clean0, toxic2, clean2."""
    names = [f"{kind}{half}" for half in HALVES for kind in ("clean", "toxic")]

    def run(batch):
        counts = [Counter() for _ in names]
        for raw, label, half in zip(texts(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = {f for w in set(raw.decode().lower().split()) for f in word_features(w)}
            counts[2 * HALVES.index(half) + bool(label)].update(found)
        keys = list(set().union(*counts))
        return {"feature": keys, **{n: [c[k] for k in keys] for n, c in zip(names, counts)}}

    found = map_batches(
        docs.select("text", "label", "half"), run, "feature string, " + ", ".join(f"{n} long" for n in names)
    )
    return found.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def log_odds(counts: DataFrame) -> dict[str, float]:
    """Log-odds of the features that tell toxic from clean documents; `counts` has toxic and clean.

    Of the many features tested, about CHANCE are kept by chance. What is kept is the evidence for
    toxic language, a few hundred features, which bounds what travels to the tasks.
    """
    tested = counts.where(F.col("toxic") + F.col("clean") >= LEAST_USES)
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return {}
    least = NormalDist().inv_cdf(1 - CHANCE / max(tested.count(), 10 * CHANCE))
    toxic, clean = map(float, sums)
    # the prior: a feature's share of all uses, in both classes alike
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / (toxic + clean) + 0.5
    share = toxic / (toxic + clean)
    y, z = F.col("toxic") + prior * share, F.col("clean") + prior * (1 - share)
    odds = F.log(y / (toxic + PRIOR * share)) - F.log(z / (clean + PRIOR * (1 - share)))
    kept = tested.select("feature", odds.alias("odds"), (odds / F.sqrt(1 / y + 1 / z)).alias("z"))
    return {r["feature"]: r["odds"] for r in kept.where(F.abs("z") >= least).toLocalIterator()}


class Scores(dict):
    """Word scores, filled as words are met; emptied when it grows beyond a task's share."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        value = next((self.odds[f] for f in word_features(word) if f in self.odds), 0.0)
        self[word] = value = min(value, MOST) - DRIFT
        return value


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: (score, first, end), in linear time.

    Every candidate keeps the index of the last earlier one whose left sum is smaller, so no candidate
    is walked over twice.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    lefts, rights = (total[at] - scores[at]).tolist(), total[at].tolist()
    low: list[float] = []  # sum before each candidate
    high: list[float] = []  # sum after it
    span: list[tuple[int, int]] = []
    smaller: list[int] = []  # the last earlier candidate with a smaller sum before it, or -1
    for i, left, right in zip(at.tolist(), lefts, rights):
        first, j = i, len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = smaller[j]
            if j < 0 or high[j] >= right:
                break
            # the candidate j and all after it become one segment
            left, first = low[j], span[j][0]
            back = smaller[j]
            del low[j:], high[j:], span[j:], smaller[j:]
            j = back
        low.append(left)
        high.append(right)
        span.append((first, i + 1))
        smaller.append(j)
    return [(r - lo, first, end) for lo, r, (first, end) in zip(low, high, span)]


def passage_scores(docs: DataFrame, odds: dict[str, float], keep: str) -> DataFrame:
    """`keep`, words, and the scores and word ranges of all maximal segments."""

    def run(batch, held={}):
        if "s" not in held:
            held["s"] = Scores(odds)
        of = held["s"].__getitem__
        words, found = [], []
        for raw in texts(batch, "text"):
            ws = raw.decode().lower().split()
            words.append(len(ws))
            found.append([
                {"score": s, "first": a, "end": b}
                for s, a, b in segments(np.fromiter(map(of, ws), float, len(ws)))
            ])
        return {keep: batch.column(0), "words": words, "found": found}

    kind = docs.schema[keep].dataType.simpleString()
    return map_batches(
        docs.select(keep, "text"), run, f"{keep} {kind}, words long, found array<struct<score:double,first:int,end:int>>"
    )


def extreme_value_law(rows: DataFrame) -> tuple[float, float]:
    """(lambda, log K): P(best of n words >= s) = 1 - exp(-K n exp(-lambda s)), by moments over clean rows."""
    s, n = F.coalesce(F.array_max("found.score"), F.lit(0.0)), F.log(F.greatest("words", F.lit(1)))
    m = rows.where("label = 0").agg(
        F.count("*"), F.avg(s), F.avg(n), F.var_samp(s), F.var_samp(n), F.covar_samp(s, n)
    ).first()
    if m[0] < 2:
        return 1.0, 0.0
    rate = 1.0
    for _ in range(100):
        spread = max(m[3] + m[4] / rate**2 - 2 * m[5] / rate, 1e-4)
        rate = 0.5 * rate + 0.5 * min(max(pi / sqrt(6 * spread), 0.2), 5.0)
    return rate, rate * (m[1] - m[2] / rate) - EULER


def platt(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 by evidence; rows of (evidence, label, count)."""
    x, y, w = (np.array(v, float) for v in zip(*rows)) if rows else (np.zeros(1),) * 3

    def value(a: float, b: float) -> float:
        z = a * x + b
        # a weak pull to slope 1 and offset 0 keeps separable classes finite
        return float((w * (y * z - np.logaddexp(0, z))).sum() - 0.05 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, h = w * (y - p), w * p * (1 - p)
        grad = np.array([(g * x).sum() - (a - 1) * 0.1, g.sum() - b * 0.1])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step, now = np.linalg.solve(hess, grad), value(a, b)
        while value(a + step[0], b + step[1]) < now and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def expected_hits(score, rate: float, log_k: float):
    """Segments of at least `score` that a clean text of so many words is expected to have."""
    return F.exp(F.lit(log_k) + F.log(F.greatest("words", F.lit(1))) - rate * score)


#: A segment is significant when at most so many as good are expected.
FEW_HITS = -log(1 - SIGNIFICANT)


def evidence(rate: float, log_k: float):
    """Sum over all significant passages of -log10 of their chance in a clean text.

    The chance is the extreme-value law's. A text without a significant passage has the evidence of its
    best segment, 0 without any.
    """

    def one(score):
        return -F.log10(F.greatest(-F.expm1(-expected_hits(score, rate, log_k)), F.lit(1e-30)))

    best = F.array_max("found.score")
    total = F.aggregate("found.score", F.lit(0.0), lambda t, s: t + F.when(
        expected_hits(s, rate, log_k) <= FEW_HITS, one(s)).otherwise(0.0))
    return F.when(best.isNull(), 0.0).when(total > 0, total).otherwise(one(best))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages.

    passages are the significant ones as `first:end` word ranges, comma-joined. `docs` needs
    doc_id and text, `labels` doc_id and toxic (null labels are ignored). Null and empty texts have
    no passages. Repeated rows come out each; a null doc_id is not held out and has no label. A
    label with no rows leaves every score at what calibration makes of no evidence.
    """
    f = fold(F.col("doc_id"), FOLDS)
    text = docs.select("doc_id", "text")
    known = with_labels(text, labels, "toxic", f != HELD_OUT).withColumn("half", f.cast("int"))
    counts = written(feature_counts(known))

    def odds_of(*halves: int) -> dict[str, float]:
        both = [sum((F.col(f"{kind}{h}") for h in halves), F.lit(0)).alias(kind) for kind in ("toxic", "clean")]
        return log_odds(counts.select("feature", *both))

    first, last = HALVES
    apart = written(
        passage_scores(known.where(F.col("half") == last), odds_of(first), "label").unionAll(
            passage_scores(known.where(F.col("half") == first), odds_of(last), "label")
        )
    )
    odds = odds_of(*HALVES)
    rate, log_k = extreme_value_law(apart)
    grid = apart.groupBy(F.round(evidence(rate, log_k), 2).alias("e"), "label").count().collect()
    slope, offset = platt([(r["e"], r["label"], r["count"]) for r in grid])
    found = passage_scores(text, odds, "doc_id")
    score = 1 / (1 + F.exp(-(slope * evidence(rate, log_k) + offset)))
    passages = F.filter("found", lambda s: expected_hits(s["score"], rate, log_k) <= FEW_HITS)
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.7).cast("int").alias("predicted"),
        F.array_join(F.transform(passages, lambda s: F.concat_ws(":", s["first"], s["end"])), ",").alias("passages"),
    )
