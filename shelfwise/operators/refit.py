"""Forecast models fitted anew at every cutpoint.

A ridge regression of log units on lags, for all series together. Its normal equations are sums over
rows, so one pass adds them up per week; the weeks before any cutpoint then give that cutpoint's fit.
The weeks between the end of training and the cutpoint choose the penalty. Inside the horizon lags
are the forecasts themselves, a fold over each series' history, which holds one row per week.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.schema import SERIES_KEYS

TERMS = ("one", "lag1", "mean4", "lag13", "sin_year", "cos_year")
LONGEST = 13
#: Ridge penalties per training row that the validation weeks choose from.
PENALTIES = (1e-6, 1e-4, 1e-2, 1.0)
PAIRS = [(i, j) for i in range(len(TERMS)) for j in range(i, len(TERMS))]
#: The sums a fit needs, in the order of the arrays `train` and `valid`.
SUMS = [f"a_{i}_{j}" for i, j in PAIRS] + [f"b_{i}" for i in range(len(TERMS))] + ["yy", "n"]


def _log_units(v: Column) -> Column:
    return F.log1p(F.greatest(v.cast("double"), F.lit(0.0)))


def _season(week: Column) -> list[Column]:
    turn = F.dayofyear(week) * (2 * math.pi / 365.25)
    return [F.sin(turn), F.cos(turn)]


def lag_rows(panel: DataFrame, c: str = "base_units") -> DataFrame:
    """week, log units `y` and the TERMS, for rows with 13 rows of their series before them.

    Lags count rows, not weeks. Rows with null units are left out first; negative units count as zero.
    """
    order = Window.partitionBy(*SERIES_KEYS).orderBy("week")
    y = F.col("y")
    sin, cos = _season(F.col("week"))
    return panel.where(F.col(c).isNotNull()).select("week", *SERIES_KEYS, _log_units(F.col(c)).alias("y")).select(
        "week", "y", F.lit(1.0).alias("one"), F.lag(y, 1).over(order).alias("lag1"),
        F.avg(y).over(order.rowsBetween(-4, -1)).alias("mean4"), F.lag(y, LONGEST).over(order).alias("lag13"),
        sin.alias("sin_year"), cos.alias("cos_year")).where(F.col("lag13").isNotNull())


def weekly_sums(rows: DataFrame) -> DataFrame:
    """The normal equations' sums per week: one row a week, combined before the shuffle."""
    x = [F.col(t) for t in TERMS]
    return rows.groupBy("week").agg(
        *[F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i, j in PAIRS],
        *[F.sum(x[i] * F.col("y")).alias(f"b_{i}") for i in range(len(TERMS))],
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).cast("double").alias("n"))


def cutpoint_sums(weekly: DataFrame, cutpoints: Sequence[date], gap_weeks: int = 8) -> DataFrame:
    """cutpoint, train, valid: sums of the weeks before the gap and of the weeks in it, in order of SUMS.

    No week at or after a cutpoint enters. Cutpoints without training rows have no row.
    """
    cut = F.explode(F.array(*[F.lit(d) for d in sorted(set(cutpoints))])).alias("cutpoint")
    early = F.col("week") < F.date_sub("cutpoint", 7 * gap_weeks)

    def part(inside: Column) -> Column:
        return F.array(*[F.sum(F.when(inside, F.col(s)).otherwise(0.0)) for s in SUMS])

    return weekly.select("*", cut).where(F.col("week") < F.col("cutpoint")).groupBy("cutpoint").agg(
        part(early).alias("train"), part(~early).alias("valid")).where(F.element_at("train", -1) > 0)


def _unpack(sums) -> tuple[np.ndarray, np.ndarray, float, float]:
    p = len(TERMS)
    a = np.zeros((p, p))
    for (i, j), v in zip(PAIRS, sums):
        a[i, j] = a[j, i] = v
    return a, np.array(sums[len(PAIRS):len(PAIRS) + p]), sums[-2], sums[-1]


def solve_ridge(train, valid) -> tuple[float, list[float]]:
    """Penalty and weights whose squared error on `valid` is least (the smallest penalty of equal ones)."""
    a, b, _, n = _unpack(train)
    va, vb, vyy, _ = _unpack(valid)
    shrink = np.diag([0.0] + [1.0] * (len(TERMS) - 1))
    best = None
    for penalty in PENALTIES:
        w = np.linalg.solve(a / n + penalty * shrink, b / n)
        loss = vyy - 2 * w @ vb + w @ va @ w
        if best is None or loss < best[0]:
            best = (loss, penalty, w)
    return best[1], [float(v) for v in best[2]]


def fit_cutpoints(panel: DataFrame, cutpoints: Sequence[date], gap_weeks: int = 8, c: str = "base_units") -> DataFrame:
    """cutpoint, n_train, n_valid, penalty and weights: one fit per cutpoint, all from one pass over the panel."""

    @F.pandas_udf("penalty double, weights array<double>")
    def solve(train: pd.Series, valid: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([solve_ridge(list(t), list(v)) for t, v in zip(train, valid)], columns=["penalty", "weights"])

    sums = cutpoint_sums(weekly_sums(lag_rows(panel, c)), cutpoints, gap_weeks)
    return sums.withColumn("_f", solve("train", "valid")).select(
        "cutpoint", F.element_at("train", -1).alias("n_train"), F.element_at("valid", -1).alias("n_valid"),
        "_f.penalty", "_f.weights")


def forecast_paths(panel: DataFrame, fits: DataFrame, use: Sequence[tuple[date, str, date]], horizon: int = 13,
                   c: str = "base_units") -> DataFrame:
    """Recursive forecasts: series, cutpoint, model, history (week, v) and path (week, actual, pred).

    `use` lists (cutpoint, model name, cutpoint of the fit). The history ends before the cutpoint; the
    path holds the rows of the `horizon` weeks from it on. Series with fewer than 13 known rows or no
    row in the horizon have none.
    """
    stop = F.date_add("cutpoint", 7 * horizon)
    series = panel.where(F.col(c).isNotNull()).groupBy(*SERIES_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("week", F.col(c).cast("double").alias("v")))).alias("_s"))
    runs = F.explode(F.array(*[F.struct(F.lit(d).alias("cutpoint"), F.lit(m).alias("model"), F.lit(f).alias("_fit"))
                               for d, m, f in use])).alias("_u")
    fitted = fits.select(F.col("cutpoint").alias("_fit"), F.col("weights").alias("_w"))
    # one row per cutpoint of the list, so its size is known
    rows = series.select("*", runs).select(*SERIES_KEYS, "_s", "_u.*").join(F.broadcast(fitted), "_fit")
    rows = rows.select(
        *SERIES_KEYS, "cutpoint", "model", "_w", F.filter("_s", lambda r: r["week"] < F.col("cutpoint")).alias("history"),
        F.filter("_s", lambda r: (r["week"] >= F.col("cutpoint")) & (r["week"] < stop)).alias("_t"),
    ).where((F.size("history") >= LONGEST) & (F.size("_t") > 0))
    start = F.transform(F.slice("history", -LONGEST, LONGEST), lambda r: _log_units(r["v"]))

    def step(h: Column, r: Column) -> Column:
        back = [F.element_at(h, -k) for k in (1, 2, 3, 4)]
        x = [F.lit(1.0), back[0], (back[0] + back[1] + back[2] + back[3]) / 4, F.element_at(h, -LONGEST),
             *_season(r["week"])]
        value = sum((F.element_at("_w", i + 2) * x[i + 1] for i in range(len(TERMS) - 1)), F.element_at("_w", 1) * x[0])
        return F.concat(h, F.array(F.greatest(value, F.lit(0.0))))

    # the fold's own result is what is kept of the array: the known part is cut off at its end
    preds = F.aggregate("_t", start, step, lambda h: F.transform(
        F.slice(h, LONGEST + 1, F.size(h) - LONGEST), lambda v: F.expm1(v)))
    return rows.select(*SERIES_KEYS, "cutpoint", "model", "history", F.zip_with(
        "_t", preds, lambda r, p: F.struct(r["week"].alias("week"), r["v"].alias("actual"), p.alias("pred"))).alias("path"))


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, r: s + of(r))


def refit_cv(panel: DataFrame, cutpoints: Sequence[date], min_train: int = 52, min_test: int = 10, horizon: int = 13,
             gap_weeks: int = 8, c: str = "base_units") -> DataFrame:
    """L3 with a fit per cutpoint: error per series and cutpoint against the last training value.

    Training ends `gap_weeks` before the cutpoint, the gap chooses the penalty, and lags start from what is
    known at the cutpoint. Series need `min_train` rows of training and `min_test` rows of the horizon.
    """
    fits = fit_cutpoints(panel, cutpoints, gap_weeks, c)
    paths = forecast_paths(panel, fits, [(d, "ridge", d) for d in sorted(set(cutpoints))], horizon, c)
    learned = F.filter("history", lambda r: r["week"] < F.date_sub("cutpoint", 7 * gap_weeks))
    rows = paths.select("*", F.size(learned).alias("n_train"), F.element_at(learned.getField("v"), -1).alias("_last")).where(
        (F.col("n_train") >= min_train) & (F.size("path") >= min_test))
    size = _total(F.col("path"), lambda r: F.abs(r["actual"]))
    return rows.select(
        *SERIES_KEYS, "cutpoint", "n_train", F.size("path").alias("n_test_rows"),
        _total(F.col("path"), lambda r: r["actual"]).alias("test_units"),
        (100 * F.try_divide(_total(F.col("path"), lambda r: F.abs(r["actual"] - r["pred"])), size)).alias("wmape"),
        (100 * F.try_divide(_total(F.col("path"), lambda r: F.abs(r["actual"] - F.greatest("_last", F.lit(0.0)))), size)
         ).alias("naive_wmape"),
    ).where(F.col("wmape").isNotNull())


def refit_rollforward(panel: DataFrame, quarters: Sequence[date], horizon: int = 13, gap_weeks: int = 8,
                      stale_weeks: int = 13, c: str = "base_units") -> DataFrame:
    """L5 with models: refitted at the quarter against fitted `stale_weeks` before, and the mean of four rows.

    All three see the same history up to the quarter and are scored on the same rows.
    """
    quarters = sorted(set(quarters))
    before = {d: d - timedelta(weeks=stale_weeks) for d in quarters}
    fits = fit_cutpoints(panel, [*quarters, *before.values()], gap_weeks, c)
    use = [(d, "retrained", d) for d in quarters] + [(d, "stale", before[d]) for d in quarters]
    paths = forecast_paths(panel, fits, use, horizon, c)
    mean4 = _total(F.slice("history", -4, 4), lambda r: r["v"]) / 4
    scored = paths.select("cutpoint", F.explode(F.when(F.col("model") == "retrained", F.array(
        F.struct(F.lit("retrained").alias("model"), F.lit(False).alias("_flat")),
        F.struct(F.lit("ma4").alias("model"), F.lit(True).alias("_flat")),
    )).otherwise(F.array(F.struct(F.lit("stale").alias("model"), F.lit(False).alias("_flat"))))).alias("_m"),
        "path", mean4.alias("_mean4"))
    pred = lambda r: F.when(F.col("_m._flat"), F.col("_mean4")).otherwise(r["pred"])
    return scored.select(
        "cutpoint", "_m.model", F.size("path").alias("_n"), _total(F.col("path"), lambda r: F.abs(r["actual"])).alias("_a"),
        _total(F.col("path"), lambda r: F.abs(r["actual"] - pred(r))).alias("_e"),
    ).groupBy("cutpoint", "model").agg(
        F.sum("_n").alias("n"), (100 * F.try_divide(F.sum("_e"), F.sum("_a"))).alias("wmape"))
