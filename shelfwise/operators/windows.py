"""Series windows (group E) and launch-aligned window aggregates.

Every window here is partitioned by a series, which holds one row per week, so a task never sees
more than a few hundred rows per key. All of them share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shelfwise.config import Z_EXTREME, Z_OUTLIER, Z_WATCH
from shelfwise.functions.scalar import case, clamp, pct_change, safe_div, week_of_year
from shelfwise.schema import SERIES_KEYS

#: Any Monday before the data; turns a date into an integer for RANGE frames.
EPOCH = "1970-01-05"


def series(keys: Sequence[str] = SERIES_KEYS, order: str = "week") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def latest_first(keys: Sequence[str] = SERIES_KEYS, order: str = "week") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc(order))


def last_rows(n: int, keys: Sequence[str] = SERIES_KEYS) -> WindowSpec:
    """The current row and the n - 1 before it (rows, not calendar weeks)."""
    return series(keys).rowsBetween(-(n - 1), 0)


def prior_rows(n: int, keys: Sequence[str] = SERIES_KEYS) -> WindowSpec:
    """The n rows before the current one."""
    return series(keys).rowsBetween(-n, -1)


def day_number(c: str = "week") -> Column:
    return F.datediff(F.col(c), F.lit(EPOCH).cast("date"))


# ---------------------------------------------------------------- E1, E10, E11


def wow_features(panel: DataFrame) -> DataFrame:
    """Previous row, delta and relative change of the main measures."""
    w = series()
    lagged = panel.select(
        "*", *[F.lag(c).over(w).alias(f"{c}_lag_1") for c in ("units", "base_units", "tdp", "arp")]
    )
    return lagged.select(
        "*",
        *[
            (F.col(c) - F.col(f"{c}_lag_1")).alias(f"{c}_wow_delta")
            for c in ("units", "base_units", "tdp", "arp")
        ],
        *[
            pct_change(c, f"{c}_lag_1").alias(f"{c}_wow_pct")
            for c in ("units", "base_units", "tdp")
        ],
        (F.col("units") - F.col("base_units")).alias("promo_gap_units"),
    )


def add_lags(panel: DataFrame, c: str, lags: Sequence[int] = (1, 2, 3, 4, 8, 13, 52)) -> DataFrame:
    """Earlier rows of one measure."""
    return panel.select("*", *[F.lag(c, k).over(series()).alias(f"{c}_lag{k}") for k in lags])


def add_diffs(panel: DataFrame, c: str, steps: Sequence[int] = (1, 4)) -> DataFrame:
    """Difference to the k-th earlier row."""
    return panel.select(
        "*", *[(F.col(c) - F.lag(c, k).over(series())).alias(f"{c}_diff{k}") for k in steps]
    )


# ---------------------------------------------------------------- E2, E3

#: measure -> (short output name, window lengths)
ROLLING = {
    "base_units": ("base_units", (4, 8, 13)),
    "avg_weekly_units_spm": ("velocity_spm", (8, 13)),
    "tdp": ("tdp", (8, 13)),
}


def rolling_stats(panel: DataFrame) -> DataFrame:
    """Trailing mean and sample deviation, current row included."""
    cols = []
    for c, (name, lengths) in ROLLING.items():
        for n in lengths:
            cols += [
                F.avg(c).over(last_rows(n)).alias(f"{name}_roll{n}_avg"),
                F.stddev_samp(c).over(last_rows(n)).alias(f"{name}_roll{n}_std"),
            ]
    w = series()
    return panel.select(
        "*",
        *cols,
        (F.col("base_units") - F.lag("base_units").over(w)).alias("base_units_wow_delta"),
        (F.col("avg_weekly_units_spm") - F.lag("avg_weekly_units_spm").over(w)).alias(
            "velocity_spm_wow_delta"
        ),
    )


def outlier_class(z: str | Column, missing: str | None = None) -> Column:
    """Class of |z|; `missing` names the class of an unknown z."""
    a = F.abs(F.col(z) if isinstance(z, str) else z)
    branches = [(a >= Z_EXTREME, "EXTREME_OUTLIER"), (a >= Z_OUTLIER, "OUTLIER"),
                (a >= Z_WATCH, "WATCH")]
    if missing is not None:
        branches.insert(0, (a.isNull(), missing))
    return case(branches, "NORMAL")


def zscores(rolled: DataFrame) -> DataFrame:
    """Z-scores (0 without spread), classes on the 13-row score, direction on the 8-row one."""

    def z(c: str, name: str, n: int) -> Column:
        std = F.col(f"{name}_roll{n}_std")
        return F.when(std > 0, (F.col(c) - F.col(f"{name}_roll{n}_avg")) / std).otherwise(0.0)

    scored = rolled.select(
        "*",
        *[z(c, name, n).alias(f"{name}_z{n}") for c, (name, _) in ROLLING.items() for n in (8, 13)],
    )
    strict = F.when(F.col("base_units_roll8_std") > 0, F.col("base_units_z8"))
    return scored.select(
        "*",
        outlier_class("base_units_z13").alias("base_units_outlier_class"),
        outlier_class("velocity_spm_z13").alias("velocity_spm_outlier_class"),
        outlier_class(strict, "INSUFFICIENT_DATA").alias("base_units_outlier_class_8w"),
        F.when(strict > 0, "UP").otherwise("DOWN").alias("base_units_outlier_dir"),
    )


def event_detection(panel: DataFrame) -> DataFrame:
    return zscores(rolling_stats(panel))


# ---------------------------------------------------------------- E7, E9, E12-E16, E19, E20


def rolling_prior(c: str, n: int, min_rows: int, fn=F.avg) -> Column:
    """Mean (or other aggregate) of the n previous rows, NULL below `min_rows` values."""
    w = prior_rows(n)
    return F.when(F.count(c).over(w) >= min_rows, fn(c).over(w))


def cannibal_pressure(
    panel: DataFrame, focal: str = "base_units", donors: str = "donor_sum_units",
    long: int = 8, short: int = 4, min_rows: int = 5,
) -> DataFrame:
    """Negated rolling correlation of focal and donor units, and its acceleration."""
    d = F.coalesce(F.col(donors), F.lit(0.0))

    def neg_corr(n: int) -> Column:
        w = last_rows(n)
        enough = F.count(focal).over(w) >= min(min_rows, n)
        # corr() itself fails on a constant window under ANSI rules
        spread = F.stddev_samp(focal).over(w) * F.stddev_samp(d).over(w)
        return F.when(
            enough & (spread > 0),
            -F.try_divide(F.covar_samp(F.col(focal), d).over(w), spread),
        )

    out = panel.select(
        "*", neg_corr(long).alias("rolling_cannibal_pressure"), neg_corr(short).alias("_short")
    )
    return out.withColumn(
        "rolling_cannibal_trend", F.col("_short") - F.col("rolling_cannibal_pressure")
    ).drop("_short")


def rolling_elasticity(
    panel: DataFrame, n: int = 13, min_rows: int = 5, price_range: float = 0.05,
    clip: tuple[float, float] = (-5.0, 3.0),
) -> DataFrame:
    """Trailing log-log slope of base units on price, where price per unit really moved."""
    ok = (F.col("arp") > 0) & (F.col("base_units") > 0) & (F.col("pack_count") > 0)
    usable = panel.select(
        "*",
        F.when(ok, F.log1p("arp")).alias("_x"),
        F.when(ok, F.log1p("base_units")).alias("_y"),
        F.when(ok, safe_div("arp", "pack_count")).alias("_bar"),
    )
    w = last_rows(n)
    enough = (F.count("_x").over(w) >= min_rows) & (
        F.max("_bar").over(w) - F.min("_bar").over(w) >= price_range
    )
    slope = F.when(enough, F.regr_slope("_y", "_x").over(w))
    return (
        usable.withColumn("rolling_elasticity", clamp(slope, *clip))
        .withColumn(
            "rolling_elas_valid", F.when(F.col("rolling_elasticity").isNotNull(), 1).otherwise(0)
        )
        .drop("_x", "_y", "_bar")
    )


def tail_n(panel: DataFrame, n: int, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """The n newest rows of every key; Spark prunes to n per key before the shuffle."""
    return (
        panel.withColumn("_r", F.row_number().over(latest_first(keys)))
        .where(F.col("_r") <= n)
        .drop("_r")
    )


def with_age(panel: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Row number counted back from the newest row (1 = newest)."""
    return panel.withColumn("rows_back", F.row_number().over(latest_first(keys)))


def growth_rates(panel: DataFrame) -> DataFrame:
    """Last-13 mean and growth of the last 8 rows over the 8 before, per series."""
    r = F.col("rows_back")

    def mean(c: str, lo: int, hi: int) -> Column:
        return F.avg(F.when(r.between(lo, hi), F.col(c)))

    out = with_age(panel).where(r <= 16).groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        mean("base_units", 1, 13).alias("last13_base_units"),
        *[mean(c, 1, 8).alias(f"_{c}_new") for c in ("tdp", "avg_weekly_units_spm")],
        *[mean(c, 9, 16).alias(f"_{c}_old") for c in ("tdp", "avg_weekly_units_spm")],
    )
    full = F.col("n_rows") >= 16
    return out.select(
        *SERIES_KEYS,
        "last13_base_units",
        (100 * F.when(full, pct_change("_tdp_new", "_tdp_old"))).alias("tdp_growth_pct"),
        (100 * F.when(
            full, pct_change("_avg_weekly_units_spm_new", "_avg_weekly_units_spm_old")
        )).alias("vel_growth_pct"),
    )


def min_history(panel: DataFrame, n: int, c: str = "base_units") -> DataFrame:
    """Rows of series with at least n values of `c`."""
    w = Window.partitionBy(*SERIES_KEYS)
    return panel.withColumn("_n", F.count(c).over(w)).where(F.col("_n") >= n).drop("_n")


def trailing_weeks(first: int, last: int, keys: Sequence[str] = SERIES_KEYS) -> WindowSpec:
    """Calendar frame: weeks first..last relative to the row (0 = its own week)."""
    return Window.partitionBy(*keys).orderBy(day_number()).rangeBetween(7 * first, 7 * last)


# ---------------------------------------------------------------- D1, D2, D3


@dataclass(frozen=True)
class Span:
    """Weeks relative to an origin, both ends included."""

    name: str
    first: int
    last: int

    def of(self, offset: str | Column) -> Column:
        o = F.col(offset) if isinstance(offset, str) else offset
        return o.between(self.first, self.last)


PRE4, POST4 = Span("pre_4w", -4, -1), Span("post_4w", 0, 3)
PRE13, POST13 = Span("pre_13w", -13, -1), Span("post_13w", 0, 12)
PRIOR13 = Span("prior_13w", -26, -14)
PRE26, POST26 = Span("pre_26w", -26, -1), Span("post_26w", 0, 25)

#: Output names of the averaged measures.
AVERAGED = {
    "velocity_spm": "avg_weekly_units_spm",
    "velocity_store_selling": "avg_weekly_units_per_store_selling_per_item",
    "pct_stores_selling": "pct_stores_selling",
    "arp": "arp",
    "units_pct_promo": "units_pct_promo",
    "arp_discount": "arp_pct_discount_any_promo",
}


def sum_in(span: Span, c: str, offset: str) -> Column:
    """Sum inside a span; 0 when the span is empty."""
    return F.sum(F.when(span.of(offset), F.col(c)).otherwise(0))


def avg_in(span: Span, c: str, offset: str) -> Column:
    """Mean inside a span; NULL when the span is empty."""
    return F.avg(F.when(span.of(offset), F.col(c)))


def count_in(span: Span, offset: str) -> Column:
    return F.count(F.when(span.of(offset), 1))


def span_measures(
    offset: str, spec: Sequence[tuple[Span, Sequence[str], Sequence[str]]], prefix: str = ""
) -> list[Column]:
    """Aggregates for (span, summed measures, averaged measures), named prefix+span+measure."""
    out = []
    for span, sums, avgs in spec:
        out += [sum_in(span, c, offset).alias(f"{prefix}{span.name}_{c}") for c in sums]
        out += [avg_in(span, AVERAGED[a], offset).alias(f"{prefix}{span.name}_{a}") for a in avgs]
        out.append(count_in(span, offset).alias(f"{prefix}{span.name}_weeks_count"))
    return out


def calendar_measures(offset: str, year_match: Column, prefix: str = "") -> list[Column]:
    """Year-to-date twins around the origin."""
    out = []
    for name, side in (("pre", F.col(offset) < 0), ("post", F.col(offset) >= 0)):
        inside = year_match & side
        out += [
            F.sum(F.when(inside, F.col("base_units")).otherwise(0)).alias(
                f"{prefix}{name}_ytd_base_units"),
            F.count(F.when(inside, 1)).alias(f"{prefix}{name}_ytd_weeks_count"),
        ]
    return out


# ---------------------------------------------------------------- calendar features


def fourier(woy: Column | None = None) -> tuple[Column, Column]:
    """Annual sine and cosine of the ISO week."""
    woy = week_of_year() if woy is None else woy
    angle = woy * F.lit(2.0 * 3.141592653589793 / 52.178)
    return F.sin(angle), F.cos(angle)
