"""The incomplete beta function against sums and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import beta


def test_against_binomial_sums():
    for a, b in ((1, 1), (2, 3), (1, 9), (40, 7), (300, 500)):
        for x in (0.001, 0.1, 0.37, 0.5, 0.81, 0.999):
            n = a + b - 1
            want = math.fsum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
            assert beta.regularised_beta(x, a, b) == pytest.approx(want, abs=1e-12)
    # large parameters: symmetric, so half lies below the middle
    assert beta.regularised_beta(0.5, 1e6, 1e6) == pytest.approx(0.5, abs=1e-9)
    assert list(beta.regularised_beta(np.array([-1.0, 0.0, 1.0, 2.0]), 2, 3)) == [0, 0, 1, 1]


def test_inverse():
    a, b = np.array([1.0, 2.0, 0.5, 30.0, 5000.0]), np.array([1.0, 3.0, 0.5, 1.0, 7000.0])
    for p in (0.025, 0.5, 0.975):
        assert np.allclose(beta.regularised_beta(beta.beta_inverse(p, a, b), a, b), p, atol=1e-11)
        assert beta.beta_inverse(p, a, b)[0] == pytest.approx(p)
        assert beta.beta_inverse(p, a, b)[2] == pytest.approx(math.sin(math.pi * p / 2) ** 2, abs=1e-10)


def test_columns(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 1.0), (0.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(beta.beta_quantile(0.5, "a", "b")).collect()]
    assert got[0] == pytest.approx(0.385727568, abs=1e-8) and got[1:] == [None, None]
    t = spark.createDataFrame([(1.0, 1.0), (-2.0, 2.0), (0.0, 5.0), (3.0, 0.0)], "t double, n double")
    got = [r[0] for r in t.select(beta.student_tail("t", "n")).collect()]
    # closed forms of one and two degrees of freedom
    assert got[0] == pytest.approx(0.5, abs=1e-12)
    assert got[1] == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert got[2] == 1.0 and got[3] is None
    assert t.limit(0).select(beta.student_tail("t", F.col("n"))).count() == 0
