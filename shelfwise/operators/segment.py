"""Change points by optimal partitioning (J21): the segmentation of least squared error plus penalty."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.schema import SERIES_KEYS


def noise_level(x: np.ndarray) -> float:
    """Standard deviation of the noise from the median step; level shifts hardly touch it."""
    if len(x) < 2:
        return 0.0
    return float(np.median(np.abs(np.diff(x)))) / (0.6744897501960817 * math.sqrt(2)) or float(np.std(np.diff(x))) / math.sqrt(2)


def segment_starts(x: np.ndarray, penalty: float, min_rows: int) -> list[int]:
    """First index of each segment of the least sum of squared errors plus `penalty` per change.

    Dynamic programme over segment ends. A start that does no better than starting anew at some end t
    never will, and is dropped once t can start a segment, so a flat series takes linear time. Of equal
    segmentations the one whose last segments start first. Fewer than twice `min_rows` values are one segment.
    """
    n = len(x)
    if n < 2 * min_rows or not n:
        return [0] if n else []
    x = x - x.mean()
    one, two = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    least, origin = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    least[0] = -penalty
    starts, until = np.empty(0, int), np.empty(0, int)
    for t in range(min_rows, n + 1):
        if least[t - min_rows] < np.inf:
            starts, until = np.append(starts, t - min_rows), np.append(until, n + min_rows + 1)
        keep = until > t
        starts, until = starts[keep], until[keep]
        part = one[t] - one[starts]
        total = least[starts] + np.maximum(two[t] - two[starts] - part * part / (t - starts), 0.0)
        best = int(np.argmin(total))
        least[t], origin[t] = total[best] + penalty, starts[best]
        # t can start a segment that ends at t + min_rows
        until = np.where(total >= least[t], np.minimum(until, t + min_rows), until)
    out, t = [], n
    while t > 0:
        t = int(origin[t])
        out.append(t)
    return out[::-1]


def change_segments(panel: DataFrame, min_rows: int = 8, strength: float = 3.0, c: str = "base_units") -> DataFrame:
    """The segments of constant level of each series, in order of time.

    segment (from 1), first_week, last_week, n_rows, level (mean) and shift (level less the one before, null for
    the first). The penalty per change is `strength` times the noise variance times the log of the series' length;
    a series without noise is cut at every shift. Null values are left out; a series is one row per week, so its
    array is bounded.
    """

    @F.pandas_udf("array<int>")
    def starts(values: pd.Series) -> pd.Series:
        def of(v) -> list[int]:
            x = np.asarray(v, float)
            return segment_starts(x, strength * noise_level(x) ** 2 * math.log(max(len(x), 2)) + 1e-9, min_rows)

        return values.map(of)

    series = panel.where(F.col(c).isNotNull()).groupBy(*SERIES_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("week", F.col(c).cast("double").alias("v")))).alias("_s"))
    cut = series.withColumn("_b", starts(F.col("_s").getField("v")))
    rows = cut.select(*SERIES_KEYS, "_s", "_b", F.posexplode("_b").alias("_i", "_first"))
    end = F.coalesce(F.try_element_at("_b", F.col("_i") + 2), F.size("_s"))
    part = rows.select(*SERIES_KEYS, F.col("_i"), F.slice("_s", F.col("_first") + 1, end - F.col("_first")).alias("_p"),
                       F.when(F.col("_i") > 0, F.slice("_s", F.element_at("_b", F.greatest("_i", F.lit(1))) + 1,
                              F.col("_first") - F.element_at("_b", F.greatest("_i", F.lit(1))))).alias("_before"))

    def mean(p: str):
        return F.aggregate(p, F.lit(0.0), lambda t, r: t + r["v"]) / F.size(p)

    return part.select(
        *SERIES_KEYS, (F.col("_i") + 1).alias("segment"), F.element_at("_p", 1)["week"].alias("first_week"),
        F.element_at("_p", -1)["week"].alias("last_week"), F.size("_p").alias("n_rows"), mean("_p").alias("level"),
        F.when(F.col("_before").isNotNull(), mean("_p") - mean("_before")).alias("shift"))
