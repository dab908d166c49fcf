"""Replicated refutations against a regression on the rows of each draw."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import refute
from shelfwise.schema import SERIES_KEYS

START = dt.date(2020, 1, 6)


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in range(9):
        for i in range(3 + 12 * p):
            price = float(np.round(rng.uniform(2, 6), 2))
            units = float(np.exp(4 - 0.9 * np.log(price) + 0.2 * rng.normal() + 0.01 * i))
            rows.append((START + dt.timedelta(weeks=i), *[f"p{p}"] * len(SERIES_KEYS), 0, price, units,
                         float(10 + p + rng.integers(5)), START, 1 + p % 3, 1 + i % 52))
    rows.append((START, *["lost"] * len(SERIES_KEYS), 0, 3.0, 5.0, None, START, 1, 1))
    return spark.createDataFrame(rows, "week date, " + ", ".join(f"{k} string" for k in SERIES_KEYS) + """,
      promo_confounded int, arp double, base_units double, tdp double, first_week_selling date, pack_count int,
      week_of_year int""").repartition(4)


def plain(rows, constants):
    """Slope of x per variant and replicate, by least squares on the rows themselves."""
    x, z, y = (np.array([r[k] for r in rows], float) for k in ("x", "z", "y"))
    h = np.array([r["h"] for r in rows], dtype=object)
    sid = np.array([r["sid"] for r in rows])

    def slope(x, extra, w):
        m = np.column_stack([x, np.ones(len(x)), z, *extra]) * np.sqrt(w)[:, None]
        return np.linalg.lstsq(m, y * np.sqrt(w), rcond=None)[0][0]

    one, out = np.ones(len(x)), {}
    out["estimate"] = [slope(x, [], one)]
    for a, b in constants:
        v = [(int(k) * a + b) % refute.PRIME for k in h]
        u = np.array(v, float) / refute.PRIME
        swapped = x.copy()
        for s in set(sid):
            at = np.flatnonzero(sid == s)
            swapped[at] = x[sorted(at, key=lambda i: v[i])]
        draws = np.array([sum(q > t for t in refute.poisson_steps()) for q in u], float)
        for name, value in (("placebo", slope(swapped, [], one)), ("random_cause", slope(x, [u], one)),
                            ("subset_80", slope(x, [], (u < 0.8).astype(float))), ("bootstrap", slope(x, [], draws))):
            out.setdefault(name, []).append(value)
    return out


def test_replicates(prices):
    rows = refute.replicate_rows(prices).withColumn("z", F.array(*refute.CONFOUNDERS)).collect()
    rows = [r.asDict() for r in rows]
    sid = 0
    for r in rows:
        sid += r["start"]
        r["sid"] = sid
    assert sid == 9
    want = plain(rows, refute.draw_constants(30, 42))
    # blocks shorter than a series, of a few series and of all
    for block in (1, 64, 4096):
        got = {r["variant"]: r for r in refute.refute_replicated(prices, 30, block=block).collect()}
        assert set(got) == set(want) - {"estimate"}
        for name, r in got.items():
            sims, est = np.array(want[name]), want["estimate"][0]
            assert (r["rows"], r["replicates"]) == (len(rows), 30)
            assert r["estimate"] == pytest.approx(est, abs=1e-8)
            assert r["mean_effect"] == pytest.approx(sims.mean(), abs=1e-8)
            assert r["sd_effect"] == pytest.approx(sims.std(ddof=1), abs=1e-8)
            target = 0 if name == "placebo" else est
            tails = [(1 + (sims <= target).sum()) / 31, (1 + (sims >= target).sum()) / 31]
            assert r["p_value"] == pytest.approx(min(1, 2 * min(tails)))
    assert got["placebo"]["p_effect"] == pytest.approx(1 / 31)


def test_no_rows(prices):
    assert refute.refute_replicated(prices.limit(0), 5).count() == 0
