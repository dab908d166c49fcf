"""Refutations of the price response in many replicates, with p-values.

A replicate is a column of weights or draws computed from a row's hash, so nothing is resampled or
stored. Every task adds up the products that a regression needs for all replicates at once (matrix
products over batches of rows) and hands on one row per replicate; the regressions are solved from
the totals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import windows as w
from shelfwise.operators.price import CONFOUNDERS, response_rows, slope_of_moments
from shelfwise.schema import SERIES_KEYS

#: Draws are (h * a + b) mod PRIME, over PRIME, for a row's 28-bit hash h.
PRIME = 2**31 - 1
REGRESSORS = ("x", *CONFOUNDERS, "z_random")
P = len(REGRESSORS)
#: Products are kept for the constant, the regressors and y.
CELLS = [(i, j) for i in range(P + 2) for j in range(i, P + 2)]
VARIANTS = ("estimate", "placebo", "random_cause", "subset_80", "bootstrap")
SHARE = 0.8
#: Rows handled at once; with 200 replicates a matrix of draws then takes 6 MB.
BLOCK = 4096


def draw_constants(replicates: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) per replicate, from the seed alone."""
    def number(tag: str) -> int:
        return int(hashlib.md5(f"{tag}|{seed}".encode()).hexdigest()[:12], 16) % (PRIME - 1) + 1

    return [(number(f"a{r}"), number(f"b{r}")) for r in range(replicates)]


def poisson_steps() -> list[float]:
    """Chances of at most 0, 1, .. draws at a mean of 1, up to what 31-bit draws can tell apart."""
    out, total, n = [], 0.0, 0
    while total < 1 - 1 / PRIME:
        total += math.exp(-1) / math.factorial(n)
        out.append(total)
        n += 1
    return out


def replicate_sums(x: np.ndarray, z: np.ndarray, y: np.ndarray, h: np.ndarray, start: np.ndarray,
                   constants: np.ndarray) -> np.ndarray:
    """Sums of products [variant, replicate, cell] of whole series; `start` marks each series' first row.

    The estimate is in replicate 0 alone. Rows of a series are in order of time.
    """
    n, reps = len(x), len(constants)
    v = (h[None, :] * constants[:, :1] + constants[:, 1:]) % PRIME
    u = v / PRIME
    base = np.column_stack([np.ones(n), x, z, np.zeros(n), y])
    left, right = (np.array(k) for k in zip(*CELLS))
    products = base[:, left] * base[:, right]
    out = np.zeros((len(VARIANTS), reps, len(CELLS)))
    out[0, 0] = products.sum(axis=0)
    # prices change places within their series, in order of the draws
    order = np.argsort((np.cumsum(start) - 1)[None, :] * (PRIME + 1) + v, axis=1, kind="stable")
    out[1] = _swapped(base, products, x[order], 1)
    out[2] = _swapped(base, products, u, P)
    out[3] = (u < SHARE).astype(float) @ products
    out[4] = np.searchsorted(poisson_steps(), u, side="left").astype(float) @ products
    return out


def _swapped(base: np.ndarray, products: np.ndarray, values: np.ndarray, column: int) -> np.ndarray:
    """The sums when `column` takes `values` (a row per replicate)."""
    total = np.broadcast_to(products.sum(axis=0), (len(values), len(CELLS))).copy()
    cross, square = values @ base, (values * values).sum(axis=1)
    for c, (i, j) in enumerate(CELLS):
        if i == j == column:
            total[:, c] = square
        elif column in (i, j):
            total[:, c] = cross[:, i + j - column]
    return total


def replicate_rows(prices: DataFrame) -> DataFrame:
    """Rows of the response in order of series and week: hash, first of its series, x, confounders, y."""
    key = F.concat_ws("|", *SERIES_KEYS, F.col("week").cast("string"))
    number = F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")
    rows = response_rows(prices).select("week", *SERIES_KEYS, "y", "x", *CONFOUNDERS).na.drop(
        subset=["y", "x", *CONFOUNDERS])
    # the window keeps a series in one partition; the sort states the order the tasks rely on
    first = F.row_number().over(w.series()) == 1
    return rows.select("*", number.alias("h"), first.alias("start")).sortWithinPartitions(*SERIES_KEYS, "week").select(
        "h", "start", "x", *CONFOUNDERS, "y")


def refute_replicated(prices: DataFrame, replicates: int = 200, seed: int = 42, min_rows: int = 20,
                      block: int = BLOCK) -> DataFrame:
    """The price effect refitted in `replicates` draws of four refutations.

    placebo: prices change places within their series. random_cause: one more, random, regressor.
    subset_80: rows drawn with 80 percent. bootstrap: Poisson(1) weights. One row per variant: rows,
    replicates (with a slope), estimate (the effect itself), mean_effect, sd_effect; p_value, two-sided, of
    the value that should be in the spread of the replicates (0 for the placebo, else the estimate), and
    p_effect, for the placebo only: how often shuffled prices do at least as well as the real ones.
    """
    constants = np.array(draw_constants(replicates, seed), dtype=np.int64).reshape(-1, 2)
    names = [f"c{k}" for k in range(len(CELLS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(VARIANTS), replicates, len(CELLS)))
        held: list[np.ndarray] = []  # rows of complete series, then of the one that may go on
        met = False

        def add(rows: np.ndarray):
            total[...] += replicate_sums(rows[:, 2], rows[:, 3:3 + len(CONFOUNDERS)], rows[:, -1],
                                         rows[:, 0].astype(np.int64), rows[:, 1] > 0, constants)

        for batch in batches:
            met = met or batch.num_rows > 0
            held.append(np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows = np.concatenate(held)
            heads = np.flatnonzero(rows[:, 1])
            done = 0
            while len(heads) and heads[-1] > done:
                # the last head within a block, or the next one when a series is longer than a block
                k = np.searchsorted(heads, done + block, side="right") - 1
                end = heads[k] if heads[k] > done else heads[k + 1]
                add(rows[done:end])
                done = int(end)
            held = [rows[done:]]
        if met:
            add(held[0])
            for i, name in enumerate(VARIANTS):
                kept = total[i, :1] if name == "estimate" else total[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(kept)), pa.array(range(len(kept)), pa.int32())]
                    + [pa.array(kept[:, c]) for c in range(len(CELLS))], names=["variant", "replicate", *names])

    rows = replicate_rows(prices).select(
        F.col("h"), F.col("start").cast("int").alias("start"), "x", *CONFOUNDERS, "y")
    sums = rows.mapInArrow(run, "variant string, replicate int, " + ", ".join(f"{n} double" for n in names)).groupBy(
        "variant", "replicate").agg(*[F.sum(n).alias(n) for n in names])
    cell = {ij: F.col(n) for ij, n in zip(CELLS, names)}
    size = cell[0, 0]
    # sums about the means; the constant is index 0
    moments = sums.where(size >= min_rows).select("variant", "replicate", size.alias("n"), *[
        (cell[i, j] - cell[0, i] * cell[0, j] / size).alias(f"s{i - 1}_{j - 1}") for i, j in CELLS if i > 0])
    return _verdicts(slope_of_moments(moments, ["variant", "replicate"], P))


def _verdicts(slopes: DataFrame) -> DataFrame:
    """One row per variant from the slopes of all replicates (a few hundred rows)."""
    estimate = slopes.where("variant = 'estimate'").select(F.col("coef").alias("estimate"), F.col("n").alias("rows"))
    # replicates without a slope are left out by the counts: a filter on coef would be pushed through the
    # elimination's projections and repeat all its expressions
    sims = slopes.where("variant <> 'estimate'").join(F.broadcast(estimate))
    target = F.when(F.col("variant") == "placebo", 0.0).otherwise(F.col("estimate"))
    r = F.count("coef")

    def tail(hit: Column) -> Column:
        return (F.count_if(hit) + 1) / (r + 1)

    low, high = tail(F.col("coef") <= target), tail(F.col("coef") >= target)
    return sims.groupBy("variant", "estimate", "rows").agg(
        r.alias("replicates"), F.avg("coef").alias("mean_effect"), F.stddev_samp("coef").alias("sd_effect"),
        F.least(2 * F.least(low, high), F.lit(1.0)).alias("p_value"),
        F.when(F.col("variant") == "placebo", tail(F.abs("coef") >= F.abs("estimate"))).alias("p_effect"),
    ).withColumn("rows", F.col("rows").cast("bigint"))
