"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are. Training sees a bounded sample of labelled rows'
statistics (numbers only), binned by quantile; each tree is grown level by level from histograms of
gradients. The forest is flattened into arrays, one row per tree in heap order, which numpy walks
for a whole batch at once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.host_rules import text_stats
from shelfwise.llm.text import fold, map_batches, texts, with_labels

FOLDS, HELD_OUT = 4, 2
#: Labelled rows to train on at most; more are thinned evenly by a hash of their id.
SAMPLE = 50_000
BINS, TREES, DEPTH, RATE, SHRINK, LEAST = 64, 80, 4, 0.15, 1.0, 10.0
PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]")
STATISTICS = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks",
    "exclamations", "bars", "line_words", "short_words", "long_words", "ends_with_mark",
)


def statistics(raw: bytes) -> list[float]:
    """STATISTICS of one text; all shares are of its words, lines or characters (at least one)."""
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat = text_stats(raw)
    words = raw.split()
    w, chars = max(n_words, 1), max(word_chars, 1)
    sizes = [len(x) for x in words]
    return [
        float(np.log1p(n_words)),
        word_chars / w,
        n_symbols / w,
        n_dup / max(n_lines, 1),
        n_repeat / w,
        len(set(words)) / w,
        (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / chars,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / chars,
        len(PUNCTUATION.findall(raw)) / w,
        raw.count(b"!") / w,
        raw.count(b"|") / w,
        n_words / max(n_lines, 1),
        sum(s <= 2 for s in sizes) / w,
        sum(s >= 14 for s in sizes) / w,
        float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


class Forest:
    """Complete binary trees: node i has children 2i+1 and 2i+2; leaves are the last level."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows walk each tree together."""
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting on the logistic loss."""
    inner = 2**DEPTH - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    # side="left": bin b holds values in (cut[b-1], cut[b]], so "x > cut[b]" is "bin > b"
    n, width = x.shape
    offset = np.arange(width) * BINS
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * BINS) + offset + binned).ravel()
            hist = np.stack([
                np.bincount(slot, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (g, h)
            ])
            left = hist.cumsum(axis=3)
            total = left[:, :, :, -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - total[0] ** 2 / (total[1] + SHRINK)
            gain[(left[1] < LEAST / 4) | (right[1] < LEAST / 4)] = 0.0
            for k in range(count):
                best = int(gain[k].argmax())
                f, b = divmod(best, BINS)
                if gain[k].flat[best] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SHRINK)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most about `sample` training documents."""
    f = fold(F.col("doc_id"), FOLDS)
    rows = with_labels(docs.select("doc_id", "text"), labels, "quality", f != HELD_OUT)
    known = labels.where(F.col("quality").isNotNull() & (f != HELD_OUT)).count()
    if known > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / known))

    def run(batch):
        return {"x": [statistics(t) for t in texts(batch)], "label": batch.column(1)}

    got = map_batches(rows.select("text", "label"), run, "x array<double>, label int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(got["label"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same forest whatever order rows arrive in
    return x[order], y[order]


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    `docs` needs doc_id and text, `labels` doc_id and quality (null labels are ignored). Null and
    empty texts have statistics of zero and are scored like any other. Repeated rows come out each;
    a null doc_id is not held out. Without labelled rows every score is 0.5.
    """
    forest = train(*labelled_sample(docs, labels, sample))

    def run(batch):
        x = np.array([statistics(t) for t in texts(batch)], float).reshape(-1, len(STATISTICS))
        score = forest.predict(x)
        return {"doc_id": batch.column(0), "score": score, "predicted": (score >= 0.7).astype(np.int32)}

    found = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
