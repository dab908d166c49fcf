"""Fits per cutpoint against a plain numpy regression and a row-by-row recursion."""

import datetime as dt
import math

import numpy as np
import pytest

from shelfwise.operators import refit
from shelfwise.schema import SERIES_KEYS

START = dt.date(2020, 1, 6)
CUTS = [START + dt.timedelta(weeks=w) for w in (80, 93)]
SCHEMA = "week date, " + ", ".join(f"{k} string" for k in SERIES_KEYS) + ", base_units double"


def series(seed, n, skip=()):
    rng = np.random.default_rng(seed)
    level = 50 + 20 * seed
    return [(START + dt.timedelta(weeks=w), max(0.0, round(level * (1 + 0.3 * math.sin(w / 8)) + rng.normal(0, 5), 2)))
            for w in range(n) if w not in skip]


DATA = {f"p{i}": series(i, 110 - 10 * (i == 3), skip=(30, 31, 85) if i == 2 else ()) for i in range(5)}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(w, *[p] * len(SERIES_KEYS), v) for p, s in DATA.items() for w, v in s]
    rows += [(START, *["nulls"] * len(SERIES_KEYS), None), (START, *["short"] * len(SERIES_KEYS), 3.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def terms(history, week):
    turn = week.timetuple().tm_yday * 2 * math.pi / 365.25
    return [1.0, history[-1], sum(history[-4:]) / 4, history[-13], math.sin(turn), math.cos(turn)]


def plain_fit(cut, gap=8):
    train, valid = [], []
    for s in DATA.values():
        y = [math.log1p(v) for _, v in s]
        for i in range(13, len(s)):
            if s[i][0] < cut:
                (train if s[i][0] < cut - dt.timedelta(weeks=gap) else valid).append((terms(y[:i], s[i][0]), y[i]))
    x, t = np.array([r[0] for r in train]), np.array([r[1] for r in train])
    vx, vt = np.array([r[0] for r in valid]), np.array([r[1] for r in valid])
    best = None
    for penalty in refit.PENALTIES:
        # ridge as least squares on rows extended by the penalty
        extra = np.diag([0.0] + [math.sqrt(penalty * len(x))] * 5)
        w = np.linalg.lstsq(np.vstack([x, extra]), np.concatenate([t, np.zeros(6)]), rcond=None)[0]
        loss = ((vt - vx @ w) ** 2).sum()
        if best is None or loss < best[0]:
            best = (loss, penalty, w)
    return len(x), len(vx), best[1], best[2]


def plain_path(s, cut, w):
    h = [math.log1p(v) for d, v in s if d < cut]
    out = []
    for d, v in s:
        if cut <= d < cut + dt.timedelta(weeks=13):
            h.append(max(float(np.dot(w, terms(h, d))), 0.0))
            out.append((d, v, math.expm1(h[-1])))
    return out


def test_fits(panel):
    got = {r["cutpoint"]: r for r in refit.fit_cutpoints(panel, CUTS).collect()}
    assert set(got) == set(CUTS)
    for cut in CUTS:
        n, nv, penalty, w = plain_fit(cut)
        r = got[cut]
        assert (r["n_train"], r["n_valid"], r["penalty"]) == (n, nv, penalty)
        assert np.allclose(r["weights"], w, atol=1e-7)


def test_no_row_at_or_after_the_cutpoint_matters(panel):
    from pyspark.sql import functions as F

    late = panel.withColumn("base_units", F.when(F.col("week") >= CUTS[0], 1e6).otherwise(F.col("base_units")))
    a, b = (refit.fit_cutpoints(p, CUTS[:1]).first() for p in (panel, late))
    assert a == b


def test_recursive_paths(panel):
    fits = refit.fit_cutpoints(panel, CUTS)
    got = refit.forecast_paths(panel, fits, [(d, "m", d) for d in CUTS]).collect()
    seen = set()
    for r in got:
        want = plain_path(DATA[r["upc"]], r["cutpoint"], plain_fit(r["cutpoint"])[3])
        assert [(p["week"], p["actual"]) for p in r["path"]] == [(d, v) for d, v, _ in want]
        assert np.allclose([p["pred"] for p in r["path"]], [p for *_, p in want], atol=1e-5)
        seen.add((r["upc"], r["cutpoint"]))
    assert seen == {(p, d) for p in DATA for d in CUTS}


def test_cv_and_rollforward(panel):
    cv = {(r["upc"], r["cutpoint"]): r for r in refit.refit_cv(panel, CUTS).collect()}
    # p3 has 7 rows after the second cutpoint, fewer than min_test
    assert set(cv) == {(p, d) for p in DATA for d in CUTS} - {("p3", CUTS[1])}
    r = cv["p2", CUTS[0]]
    path = plain_path(DATA["p2"], CUTS[0], plain_fit(CUTS[0])[3])
    last = [v for d, v in DATA["p2"] if d < CUTS[0] - dt.timedelta(weeks=8)]
    size = sum(v for _, v, _ in path)
    assert (r["n_train"], r["n_test_rows"]) == (len(last), 12)
    assert r["wmape"] == pytest.approx(100 * sum(abs(v - p) for _, v, p in path) / size, abs=1e-4)
    assert r["naive_wmape"] == pytest.approx(100 * sum(abs(v - last[-1]) for _, v, _ in path) / size, abs=1e-9)

    roll = {(r["cutpoint"], r["model"]): r for r in refit.refit_rollforward(panel, CUTS).collect()}
    assert set(roll) == {(d, m) for d in CUTS for m in ("retrained", "stale", "ma4")}
    for name, fitted in (("retrained", CUTS[1]), ("stale", CUTS[0])):  # the cutpoints are 13 weeks apart
        w = plain_fit(fitted)[3]
        rows = [x for s in DATA.values() for x in plain_path(s, CUTS[1], w)]
        want = 100 * sum(abs(v - p) for _, v, p in rows) / sum(v for _, v, _ in rows)
        assert roll[CUTS[1], name]["wmape"] == pytest.approx(want, abs=1e-4)
        assert roll[CUTS[1], name]["n"] == len(rows)


def test_empty_panel(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert refit.refit_cv(none, CUTS).count() == 0
    assert refit.refit_rollforward(none, CUTS).count() == 0
