"""Controls of price events: all pairs are judged, in tiles, and a choice by rules loses none."""

import datetime as dt
import random

import numpy as np
import pytest

from shelfwise.operators import causal

START = dt.date(1999, 1, 4)
SERIES = "upc string, channel_outlet string, retail_account string, geography_raw string, "


def week(i):
    return START + dt.timedelta(days=7 * i)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    series, events = {}, []
    for upc in ("u1", "u2"):
        for a in range(9):
            for geo in (["g", "h", None] if a == 4 else ["g"]):
                units = [20 + 6 * np.sin(i / (1 + a % 3)) + 3 * rng.random() for i in range(30)]
                series[upc, "c", f"a{a}", geo] = {
                    i: (None if rng.random() < 0.05 else float(u) if a else 7.0, rng.choice([2.0, 2.0, 2.05, 2.3]))
                    for i, u in enumerate(units) if rng.random() < 0.93}
            events.append((upc, "c", f"a{a}", "g", rng.randrange(24, 30), -0.2, rng.choice([10, 12]), rng.choice([5, 9])))
    # one series has no event, one event no series
    events = [e for e in events if e[2] != "a7"] + [("u1", "c", "zz", "g", 28, 0.1, 12, 6)]
    panel = spark.createDataFrame(
        [(*k, week(i), u, p) for k, v in series.items() for i, (u, p) in v.items()], SERIES + "week date, base_units double, arp double")
    ev = spark.createDataFrame(
        [(*e[:4], week(e[4]), *e[5:]) for e in events],
        SERIES + "event_week date, price_pct_chg double, pre_weeks int, post_weeks int")
    return series, events, panel, ev


def by_hand(series, events, min_weeks=8):
    """(event series, control) -> correlation and price drift, one pair at a time."""
    out = {}
    for *key, at, _, pre, post in events:
        mine, cut = series.get(tuple(key), {}), at - post
        for other, theirs in series.items():
            if other[:2] != tuple(key[:2]) or other[2] == key[2]:
                continue
            both = [(mine[i][0], theirs[i][0]) for i in range(cut - 1 - pre, cut)
                    if i in mine and i in theirs and mine[i][0] is not None and theirs[i][0] is not None]
            prices = [theirs[i][1] for i in range(cut - 1 - pre, at + 1) if i in theirs]
            if len(both) >= min_weeks and len(prices) >= 2:
                x, y = np.array(both).T
                r = np.corrcoef(x, y)[0, 1] if x.std() and y.std() else None
                out[(*key, *other[2:])] = (r, abs(prices[-1] - prices[0]) / prices[0])
    return out


def found(pairs):
    return {(r.upc, r.channel_outlet, r.retail_account, r.geography_raw, r.control_account, r.control_geography):
            (r.pre_corr, r.control_price_drift) for r in pairs.collect()}


@pytest.mark.parametrize("tile", [(512, 8192, 512 * 512), (3, 2, 6)])
def test_all_pairs_are_judged_whatever_the_tiles(planted, monkeypatch, tile):
    series, events, panel, ev = planted
    monkeypatch.setattr(causal, "TILE_CONTROLS", tile[0])
    monkeypatch.setattr(causal, "TILE_EVENTS", tile[1])
    monkeypatch.setattr(causal, "TILE_PAIRS", tile[2])
    want, got = by_hand(series, events), found(causal.control_pairs(panel, ev))
    assert got.keys() == want.keys() and len(want) > 100
    for k, (r, drift) in want.items():
        assert got[k] == (None if r is None else pytest.approx(r, abs=1e-9), pytest.approx(drift))


@pytest.mark.parametrize("tile", [(512, 8192), (3, 2)])
def test_pairs_by_rules_hold_every_choice(planted, monkeypatch, tile):
    _, _, panel, ev = planted
    every = causal.control_pairs(panel, ev)
    monkeypatch.setattr(causal, "TILE_CONTROLS", tile[0])
    monkeypatch.setattr(causal, "TILE_EVENTS", tile[1])
    few = causal.control_pairs(panel, ev, rules=causal.SENSITIVITY)
    assert few.count() < every.count()
    for rule in causal.SENSITIVITY:
        keys = [*causal.EVENT_KEYS, "control_account", "control_geography", "control_rank"]
        want = causal.select_controls(every, *rule).select(*keys).collect()
        assert sorted(causal.select_controls(few, *rule).select(*keys).collect(), key=repr) == sorted(want, key=repr)
    impact = [causal.event_impact(p).orderBy(*causal.EVENT_KEYS).collect() for p in (every, few)]
    assert impact[0] and impact[0] == impact[1]
    text = [causal.impact_sensitivity(p).orderBy(*causal.EVENT_KEYS).select("narrative").collect() for p in (every, few)]
    assert text[0] and text[0] == text[1]
