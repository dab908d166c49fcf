"""Change points against every possible segmentation."""

import datetime as dt
import itertools
import time

import numpy as np
import pytest

from shelfwise.operators import segment
from shelfwise.schema import SERIES_KEYS


def cost(x, starts, penalty):
    ends = [*starts[1:], len(x)]
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(starts, ends)) + penalty * (len(starts) - 1)


def exhaustive(x, penalty, least):
    best = None
    for k in range(len(x) // least):
        for inner in itertools.combinations(range(1, len(x)), k):
            starts = [0, *inner]
            if all(b - a >= least for a, b in zip(starts, [*inner, len(x)])):
                c = cost(x, starts, penalty)
                best = c if best is None else min(best, c)
    return best


def test_equals_the_exhaustive_optimum():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, least = int(rng.integers(1, 13)), int(rng.integers(1, 4))
        x = np.round(rng.normal(0, 1, n) + 3 * rng.integers(0, 2, n).cumsum() * rng.integers(0, 2), 1)
        penalty = float(rng.choice([0.1, 0.5, 2.0]))
        starts = segment.segment_starts(x, penalty, least)
        ends = [*starts[1:], n]
        assert starts[0] == 0 and (n < 2 * least or min(b - a for a, b in zip(starts, ends)) >= least)
        if n >= 2 * least:
            assert cost(x, starts, penalty) == pytest.approx(exhaustive(x, penalty, least), abs=1e-9)


def test_flat_series_takes_linear_time():
    begin = time.process_time()
    assert segment.segment_starts(np.full(100_000, 7.0), 1.0, 8) == [0]
    assert time.process_time() - begin < 20


def test_planted_shifts(spark):
    rng = np.random.default_rng(4)
    start = dt.date(2020, 1, 6)
    levels = {"shift": [50] * 60 + [80] * 40 + [65] * 30, "flat": [40] * 120, "short": [5, 9], "step": [3] * 20 + [4] * 20}
    rows = []
    for name, values in levels.items():
        noise = 0 if name == "step" else 2
        rows += [(start + dt.timedelta(weeks=i), *[name] * len(SERIES_KEYS), float(v + noise * rng.normal()))
                 for i, v in enumerate(values)]
    rows.append((start, *["none"] * len(SERIES_KEYS), None))
    panel = spark.createDataFrame(rows, "week date, " + ", ".join(f"{k} string" for k in SERIES_KEYS) + ", base_units double")
    got = {}
    for r in segment.change_segments(panel).orderBy("segment").collect():
        got.setdefault(r["upc"], []).append(r)
    assert {k: [r["n_rows"] for r in v] for k, v in got.items()} == {
        "shift": [60, 40, 30], "flat": [120], "short": [2], "step": [20, 20]}
    a, b, c = got["shift"]
    values = {r[1]: [] for r in rows}
    for r in rows:
        values[r[1]].append(r[-1])
    x = np.array(values["shift"])
    assert a["shift"] is None and b["first_week"] == start + dt.timedelta(weeks=60) and c["last_week"] == start + dt.timedelta(weeks=129)
    assert b["level"] == pytest.approx(x[60:100].mean()) and b["shift"] == pytest.approx(x[60:100].mean() - x[:60].mean())
    assert c["shift"] == pytest.approx(x[100:].mean() - x[60:100].mean())
    assert segment.change_segments(panel.limit(0)).count() == 0
