"""Column expressions shared by the operators. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct_change(new: str | Column, old: str | Column) -> Column:
    return safe_div(col(new) - col(old), old)


def clamp(c: str | Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (greatest/least would skip it)."""
    c = col(c)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def flag(cond: Column) -> Column:
    """1 when the condition is true, else 0 (unknown counts as 0)."""
    return F.when(cond, 1).otherwise(0)


def case(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching branch wins."""
    out = None
    for cond, value in branches:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def bands(c: str | Column, edges: Iterable[tuple[float, str]], default: str) -> Column:
    """Label of the first upper edge (inclusive) that `c` does not exceed."""
    return case([(col(c) <= e, label) for e, label in edges], default)


def weeks_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole weeks, rounded toward minus infinity."""
    return F.floor(F.datediff(col(later), col(earlier)) / 7).cast("int")


def weighted_avg(x: str | Column, w: str | Column) -> Column:
    """Aggregate: weights of NULL values do not count in the denominator."""
    x, w = col(x), col(w)
    return safe_div(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def week_of_year(c: str | Column = "week") -> Column:
    return F.weekofyear(col(c))


# ---------------------------------------------------------------- labels


def pack_bucket(pack: str | Column, style: str = "exact") -> Column:
    """Pack label: `exact` names only the standard sizes, `range` folds neighbours together."""
    p = col(pack)
    if style == "exact":
        return case(
            [(p == 1, "1ct")] + [(p == n, f"{n}pk") for n in (4, 8, 12, 16, 18, 24)], "other"
        )
    edges = [(3, "2-3pk"), (5, "4pk"), (9, "8pk"), (14, "12pk"), (17, "16pk"), (20, "18pk")]
    return (
        F.when(p.isNull(), F.lit(None))
        .when(p == 1, F.lit("1ct"))
        .otherwise(
            F.coalesce(bands(p, edges, None), F.concat(p.cast("string"), F.lit("pk")))
        )
    )


def pack_band(pack: str | Column) -> Column:
    edges = [(1, "single"), (4, "2 to 4"), (8, "5 to 8"), (12, "9 to 12")]
    return F.when(col(pack).isNotNull(), bands(pack, edges, "13 plus"))


def segment_labels(scheme: str, c: str | Column) -> Column:
    """Segment labels used by the audits; `scheme` names one of the variants."""
    x = col(c)
    if scheme == "maturity":
        return case([(x < 13, "new"), (x < 52, "growing")], "mature")
    if scheme == "maturity_fine":
        return case([(x < 13, "new"), (x < 26, "ramping"), (x < 52, "growing")], "mature")
    if scheme == "pack_format":
        return case([(x.isNull() | (x == 1), "single"), (x <= 12, "multipack")], "bulk")
    if scheme == "quarter":
        return case([(x <= 13, "Q1"), (x <= 26, "Q2"), (x <= 39, "Q3")], "Q4")
    if scheme == "stage":
        return case([(x <= 26, "New"), (x <= 52, "Expanding")], "Mature")
    raise ValueError(f"unknown segment scheme {scheme!r}")


def maturity_tier(post_weeks: str | Column) -> Column:
    """FULL from 13 post-launch weeks, PARTIAL from 8, else EARLY."""
    w = col(post_weeks)
    return case([(w >= 13, "FULL"), (w >= 8, "PARTIAL")], "EARLY")


def promo_depth_bucket(discount: str | Column) -> Column:
    d = col(discount)
    return case(
        [(d >= 0.30, "30pct_plus"), (d >= 0.20, "20_30pct"), (d >= 0.10, "10_20pct"),
         (d > 0, "0_10pct")],
        "no_promo",
    )


def protein_tier(text: str | Column) -> Column:
    """Tier by the first number in a nutrition-range text; no number means UNKNOWN."""
    grams = F.regexp_extract(col(text), "([0-9]+)", 1)
    n = F.when(grams != "", grams.cast("bigint"))
    return case(
        [(n >= 20, "HIGH_PROTEIN_20g_plus"), (n >= 15, "MID_PROTEIN_15_19g"),
         (n >= 10, "LOW_PROTEIN_10_14g")],
        "UNKNOWN",
    )
