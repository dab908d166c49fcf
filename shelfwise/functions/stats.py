"""Distribution functions as column expressions (Spark SQL has no erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.scalar import col

# Abramowitz-Stegun 7.1.26, absolute error below 1.5e-7.
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_sf2(z: str | Column) -> Column:
    """Two-sided normal tail probability P(|Z| > |z|)."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + _P * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def student_sf2(t: str | Column, df: str | Column) -> Column:
    """Two-sided Student tail probability by Hill's normalising transform.

    Absolute error is below 1e-3 from df = 3 on and falls quickly with df.
    """
    t, n = col(t), col(df)
    a = n - 0.5
    b = 48.0 * a * a
    y = a * F.log1p(t * t / n)
    corr = ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b
    return normal_sf2((corr + 1.0) * F.sqrt(y))


def kolmogorov_sf(d: str | Column, n1: str | Column, n2: str | Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value (20 terms, Stephens' small-n correction)."""
    ne = F.sqrt(col(n1) * col(n2) / (col(n1) + col(n2)))
    lam = (ne + 0.12 + 0.11 / ne) * col(d)
    total = F.lit(0.0)
    for k in range(1, 21):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def one_sample_t(mean: str | Column, std: str | Column, n: str | Column) -> Column:
    """t statistic against 0; NULL without spread."""
    return F.try_divide(col(mean), col(std) / F.sqrt(col(n)))
