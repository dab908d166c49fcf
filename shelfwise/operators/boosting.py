"""Boosted trees on Spark: quantile, logistic, squared and list-wise ranking losses.

Features are cut into at most BINS bins once and stored. A level of a tree is one pass: every task adds up
gradient and curvature per (model, node, feature, bin) of its rows, Spark adds the tasks' sums, and
the driver, which sees only these sums, picks the splits. Scores are recomputed from the trees so far,
so a round keeps no state in executors; every REWRITE rounds they are stored beside the bins.

Held-out rows are scored in the first pass of each round: training ends when the loss has not
fallen by a hundredth for `patience` rounds, or is below a twentieth of the constant's; the best round is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.scale import exact_quantiles, written

BINS = 64
#: Least relative fall of the held-out loss that counts as progress, and share of the first loss that is enough.
PROGRESS, ENOUGH = 0.01, 0.05
REWRITE = 10
#: Gain of relevance 0, 1, 2.
LABEL_GAIN = (0.0, 1.0, 3.0)


# ---------------------------------------------------------------- losses


@dataclass(frozen=True)
class Pinball:
    """One model per quantile; a round's leaves are reset to the exact quantile of their residuals."""

    quantiles: tuple[float, ...]

    @property
    def models(self) -> int:
        return len(self.quantiles)

    def start(self, rows: DataFrame) -> list[float]:
        at = exact_quantiles(rows.select(F.explode("y").alias("y")), [], "y", {f"q{i}": q for i, q in enumerate(self.quantiles)}).first()
        return [0.0 if at is None else float(at[f"q{i}"]) for i in range(self.models)]

    def gradients(self, y, s, sizes):
        q = np.array(self.quantiles)
        return np.where(y[:, None] > s, q, q - 1.0), np.ones_like(s)

    def loss(self, y, s, sizes):
        q, e = np.array(self.quantiles), y[:, None] - s
        return np.maximum(q * e, (q - 1.0) * e).sum(axis=0), len(y)


@dataclass(frozen=True)
class Squared:
    models: int = 1

    def start(self, rows: DataFrame) -> list[float]:
        return [rows.select(F.explode("y").alias("y")).agg(F.avg("y")).first()[0] or 0.0]

    def gradients(self, y, s, sizes):
        return y[:, None] - s, np.ones_like(s)

    def loss(self, y, s, sizes):
        return ((y[:, None] - s) ** 2).sum(axis=0), len(y)


@dataclass(frozen=True)
class Logistic:
    """Log-odds of label 1."""

    models: int = 1

    def start(self, rows: DataFrame) -> list[float]:
        share = rows.select(F.explode("y").alias("y")).agg(F.avg("y")).first()[0]
        share = min(max(0.5 if share is None else share, 1e-4), 1 - 1e-4)
        return [float(np.log(share / (1 - share)))]

    def gradients(self, y, s, sizes):
        p = 1 / (1 + np.exp(-s))
        return y[:, None] - p, np.maximum(p * (1 - p), 1e-6)

    def loss(self, y, s, sizes):
        return np.logaddexp(0, np.where(y[:, None] > 0, -s, s)).sum(axis=0), len(y)


@dataclass(frozen=True)
class Lambda:
    """List-wise ranking: the gain in NDCG of swapping two rows of a group weighs their pair."""

    k: int = 10
    gains: tuple[float, ...] = LABEL_GAIN
    models: int = 1

    def start(self, rows: DataFrame) -> list[float]:
        return [0.0]

    def _group(self, y, s):
        gain = np.array(self.gains)[np.clip(y, 0, len(self.gains) - 1).astype(int)]
        discount = np.where(np.arange(len(y)) < self.k, 1 / np.log2(np.arange(len(y)) + 2.0), 0.0)
        place = np.empty(len(y), int)
        place[np.lexsort((np.arange(len(y)), -s))] = np.arange(len(y))
        return gain, discount[place], (np.sort(gain)[::-1] * discount).sum()

    def gradients(self, y, s, sizes):
        g, h = np.zeros_like(s), np.full_like(s, 1e-6)
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            gain, disc, ideal = self._group(y[a:b], s[a:b, 0])
            if ideal <= 0:
                continue
            better = gain[:, None] > gain[None, :]
            # the step between neighbours counts too, so that ties in discount still move
            swap = np.abs(gain[:, None] - gain[None, :]) * np.abs(disc[:, None] - disc[None, :]) / ideal
            rho = 1 / (1 + np.exp(s[a:b, 0][:, None] - s[a:b, 0][None, :]))
            pull, curve = better * rho * swap, better * rho * (1 - rho) * swap
            g[a:b, 0] += pull.sum(axis=1) - pull.sum(axis=0)
            h[a:b, 0] += curve.sum(axis=1) + curve.sum(axis=0)
        return g, h

    def loss(self, y, s, sizes):
        """1 - NDCG, summed over groups with a relevant row."""
        lost, n = 0.0, 0
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            gain, disc, ideal = self._group(y[a:b], s[a:b, 0])
            if ideal > 0:
                lost, n = lost + 1 - (gain * disc).sum() / ideal, n + 1
        return np.array([lost]), n


# ---------------------------------------------------------------- model


@dataclass
class Tree:
    """A complete binary tree in heap order; a node without a split sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    #: value of every node: leaves' own, above them the mean of the training rows below
    value: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 1

    def leaves(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Heap index of each row's node at a depth."""
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(self.depth if depth is None else depth):
            node = 2 * node + 1 + (bins[row, self.feature[node]] > self.cut[node])
        return node


@dataclass
class Boosted:
    """Trees of one or several models over the same binned features."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    base: list[float]
    rate: float
    trees: list[list[Tree]]
    #: held-out loss of every round tried, round 0 being the constant, per model
    losses: list[list[float]] = field(default_factory=list)
    #: rounds kept, per model
    rounds: list[int] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value; missing values have bin 0, below all others."""
        out = np.zeros(x.shape, np.uint8)
        for i, cuts in enumerate(self.cuts):
            known = ~np.isnan(x[:, i])
            out[known, i] = 1 + np.searchsorted(cuts, x[known, i], side="left")
        return out

    def scores(self, bins: np.ndarray, since: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        s = np.tile(np.array(self.base, float), (len(bins), 1)) if start is None else start.copy()
        for m, trees in enumerate(self.trees):
            for t in trees[since:]:
                s[:, m] += self.rate * t.value[t.leaves(bins)]
        return s

    def contributions(self, bins: np.ndarray, model: int = 0) -> np.ndarray:
        """Per row: the base, then what each feature's splits add along the row's paths. Sums to the score."""
        out = np.zeros((len(bins), 1 + len(self.features)))
        out[:, 0] = self.base[model]
        row = np.arange(len(bins))
        for t in self.trees[model]:
            out[:, 0] += self.rate * t.value[0]
            node = np.zeros(len(bins), np.int64)
            for _ in range(t.depth):
                f = t.feature[node]
                after = 2 * node + 1 + (bins[row, f] > t.cut[node])
                out[row, 1 + f] += self.rate * (t.value[after] - t.value[node])
                node = after
        return out


def _inputs(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), width)


def predict(model: Boosted, features: Sequence[str] | None = None) -> Column:
    """Scores of all models, array<double>, for the model's feature columns."""
    names = list(features or model.features)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(model.scores(model.bins(_matrix(x, len(names))))))

    return score(_inputs(names))


def explain(model: Boosted, which: int = 0) -> Column:
    """Base and contribution of each feature, array<double>; adds up to the score of `predict`."""

    @F.pandas_udf("array<double>")
    def parts(x: pd.Series) -> pd.Series:
        return pd.Series(list(model.contributions(model.bins(_matrix(x, len(model.features))), which)))

    return parts(_inputs(model.features))


# ---------------------------------------------------------------- training


def _split(g, h, n, min_rows: int, ridge: float):
    """Best (feature, bin) of one node's histograms; None when no split gains."""
    gl, hl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h, n))
    total = [v[0].sum() for v in (g, h, n)]
    gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total[0] ** 2 / (total[1] + ridge)
    gain = np.where((nl >= min_rows) & (nr >= min_rows), gain, -np.inf)
    best = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(best[0]), int(best[1])) if gain[best] > 1e-9 else None


def fit(
    frame: DataFrame, features: Sequence[str], label: str, loss, is_train: str = "is_train", group: Sequence[str] = (),
    iterations: int = 300, depth: int = 4, rate: float = 0.3, patience: int = 4, min_rows: int = 20, ridge: float = 1.0,
) -> Boosted:
    """Boosted trees for `label`; rows with a false `is_train` only say when to stop.

    Missing features are allowed, rows without a label are left out. With `group` (list-wise losses),
    the rows of one group are held in one record: groups must be small, such as one catalogue's products.
    Without held-out rows all `iterations` rounds are kept; without rows the model is the constant.
    """
    names = tuple(features)
    rows = frame.where(F.col(label).isNotNull())
    probs = [i / BINS for i in range(1, BINS)]
    at = rows.where(is_train).agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"c{i}") for i, c in enumerate(names)]).first()
    # bin 0 is for missing values, so at most BINS - 1 cuts leave BINS + 1 bins
    cuts = [np.unique(np.array([v for v in at[i] or [] if v is not None and not np.isnan(v)], float)) for i in range(len(names))]
    model = Boosted(names, cuts, [0.0] * loss.models, rate, [[] for _ in range(loss.models)])
    width = len(names)

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([b.tobytes() for b in model.bins(_matrix(x, width))])

    one = rows.select(*group, packed(_inputs(names)).alias("bins"), F.col(label).cast("double").alias("y"), F.col(is_train).alias("train"))
    if group:
        kept = one.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bins", "y"))).alias("r"), F.max("train").alias("train"))
        one = kept.select(F.col("r.bins").alias("bins"), F.col("r.y").alias("y"), "train")
    else:
        one = one.select(F.array("bins").alias("bins"), F.array("y").alias("y"), "train")
    data = written(one)
    model.base = loss.start(data.where("train"))
    if data.where("train").isEmpty():
        model.rounds = [0] * loss.models
        return model
    stored, active = 0, list(range(loss.models))
    best = [(np.inf, 0)] * loss.models
    mark = [(np.inf, 0)] * loss.models
    model.losses = [[] for _ in range(loss.models)]
    models, bins_per = loss.models, BINS + 1

    def unpack(batch):
        names_ = batch.schema.names
        y = batch.column(names_.index("y"))
        sizes = y.value_lengths().to_numpy(zero_copy_only=False)
        own = np.frombuffer(b"".join(batch.column(names_.index("bins")).flatten().to_pylist()), np.uint8).reshape(-1, width)
        train = np.repeat(batch.column(names_.index("train")).to_numpy(zero_copy_only=False).astype(bool), sizes)
        start = None
        if "scores" in names_:
            start = batch.column(names_.index("scores")).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, models)
        return own, y.flatten().to_numpy(zero_copy_only=False), sizes, train, start

    def histograms(growing: list[Tree | None], level: int):
        """Sums per (model, node, feature, bin) of training rows; with level 0, held-out losses too."""
        now, since = model, stored
        shape = (models, 1 << level, width, bins_per)

        def run(batches):
            sums, lost = np.zeros((3, *shape)), np.zeros((models, 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, y, sizes, train, start = unpack(batch)
                s = now.scores(own, since, start)
                if level == 0 and not train.all():
                    # a record is wholly training or wholly held out
                    out = ~np.repeat(train[np.cumsum(sizes) - sizes], 1)
                    value, n = loss.loss(y[~train], s[~train], sizes[out])
                    lost += np.stack([value, np.full(models, float(n))], axis=1)
                g, h = loss.gradients(y, s, sizes)
                own, g, h = own[train], g[train], h[train]
                for m, tree in enumerate(growing):
                    if tree is None:
                        continue
                    node = tree.leaves(own, level) - ((1 << level) - 1)
                    at = ((node[:, None] * width + np.arange(width)) * bins_per + own).ravel()
                    for k, v in enumerate((g[:, m], h[:, m], np.ones(len(own)))):
                        sums[k, m] += np.bincount(at, np.repeat(v, width), minlength=sums[k, m].size).reshape(shape[1:])
            flat = sums.reshape(3, -1)
            used = np.flatnonzero(flat[2])
            key = np.r_[used, -1 - np.arange(models)]
            a, b, c = np.r_[flat[0, used], lost[:, 0]], np.r_[flat[1, used], lost[:, 1]], np.r_[flat[2, used], np.zeros(models)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(c)], names=["key", "g", "h", "n"])

        parts = data.mapInArrow(run, "key long, g double, h double, n double").groupBy("key").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        flat, lost = np.zeros((3, int(np.prod(shape)))), np.zeros((models, 2))
        for key, g, h, n in parts.collect():
            if key >= 0:
                flat[:, key] = g, h, n
            else:
                lost[-1 - key] = g, h
        return flat.reshape(3, *shape), lost

    def residual_quantiles(growing: list[Tree | None]):
        """The loss's quantile of y - score per model and leaf, exactly."""
        now, since = model, stored

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, y, _, train, start = unpack(batch)
                rest = (y[:, None] - now.scores(own, since, start))[train]
                own = own[train]
                for m, tree in enumerate(growing):
                    if tree is not None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), m, np.int32)), pa.array(tree.leaves(own)), pa.array(rest[:, m])], names=["m", "leaf", "r"])

        found = exact_quantiles(data.mapInArrow(run, "m int, leaf long, r double"), ["m", "leaf"], "r", {f"q{i}": q for i, q in enumerate(loss.quantiles)})
        return {(r["m"], r["leaf"]): r[f"q{r['m']}"] for r in found.collect()}

    def store_scores():
        """Scores so far go beside the bins, so that a pass walks only the newest trees."""
        nonlocal data, stored
        now, since = model, stored

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, _, sizes, _, start = unpack(batch)
                s = now.scores(own, since, start)
                ends = np.cumsum(sizes)
                nested = pa.array([[list(map(float, r)) for r in s[b - n:b]] for b, n in zip(ends, sizes)], pa.list_(pa.list_(pa.float64())))
                keep = [batch.column(batch.schema.get_field_index(c)) for c in ("bins", "y", "train")]
                yield pa.RecordBatch.from_arrays([*keep, nested], names=["bins", "y", "train", "scores"])

        data = written(data.mapInArrow(run, "bins array<binary>, y array<double>, train boolean, scores array<array<double>>"))
        stored = max(map(len, model.trees))

    def empty_tree() -> Tree:
        inner = (1 << depth) - 1
        return Tree(np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(2 * inner + 1))

    for turn in range(iterations + 1):
        growing = [empty_tree() if m in active else None for m in range(models)]
        count = np.zeros((models, 2 * ((1 << depth) - 1) + 1))
        for level in range(depth):
            sums, lost = histograms(growing, level)
            if level == 0:
                for m in list(active):
                    if lost[m, 1]:
                        now_loss = lost[m, 0] / lost[m, 1]
                        model.losses[m].append(float(now_loss))
                        if now_loss < best[m][0]:
                            best[m] = (now_loss, turn)
                        if now_loss < mark[m][0] * (1 - PROGRESS):
                            mark[m] = (now_loss, turn)
                        if turn - mark[m][1] >= patience or now_loss <= ENOUGH * model.losses[m][0]:
                            active.remove(m)
                            growing[m] = None
                    else:
                        best[m] = (np.inf, turn)
                if turn == iterations or not active:
                    break
            first = (1 << level) - 1
            for m, tree in enumerate(growing):
                if tree is None:
                    continue
                for node in range(1 << level):
                    g, h, n = sums[:, m, node]
                    at = first + node
                    if n[0].sum() == 0:
                        continue
                    if level == 0:
                        count[m, 0] = n[0].sum()
                    split = _split(g, h, n, min_rows, ridge)
                    left = slice(None)
                    if split is not None:
                        tree.feature[at], tree.cut[at] = split
                        left = slice(0, split[1] + 1)
                    f = int(tree.feature[at])
                    for child, part in ((2 * at + 1, left), (2 * at + 2, slice(split[1] + 1, None) if split else slice(0, 0))):
                        count[m, child] = n[f, part].sum()
                        tree.value[child] = g[f, part].sum() / (h[f, part].sum() + ridge)
        else:
            if isinstance(loss, Pinball):
                for (m, leaf), q in residual_quantiles(growing).items():
                    growing[m].value[leaf] = q
            for m, tree in enumerate(growing):
                # models that have stopped keep in step with trees that add nothing
                tree = empty_tree() if tree is None else tree
                for at in range((1 << depth) - 2, -1, -1):
                    a, b = count[m, 2 * at + 1], count[m, 2 * at + 2]
                    tree.value[at] = (a * tree.value[2 * at + 1] + b * tree.value[2 * at + 2]) / (a + b) if a + b else 0.0
                model.trees[m].append(tree)
            if len(model.trees[0]) - stored >= REWRITE:
                store_scores()
            continue
        break
    model.rounds = [b[1] for b in best]
    model.trees = [trees[: b[1]] for trees, b in zip(model.trees, best)]
    return model
