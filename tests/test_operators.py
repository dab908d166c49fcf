"""Operators on small hand-made frames, mostly against a brute-force computation."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise import scale
from shelfwise.config import RetailConfig
from shelfwise.functions import flavor, scalar, stats
from shelfwise.operators import (
    causal, enrich, evaluate, forecast, ingest, launch, panel as panel_ops, pool, price, ranking,
    transfer, windows, wins,
)
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS, assert_columns, normalize_header

CFG = RetailConfig(own_brands=("ME",), own_parent="ME", subcategory="BARS", brand_tiers={"RIVAL": 1})
D0 = dt.date(2024, 1, 1)


def week(i: int) -> dt.date:
    return D0 + dt.timedelta(weeks=i)


def frame(spark, values, upc="u1", account="a1", weeks=None, **cols):
    """One series of base units; `cols` are constants or lists."""
    weeks = weeks or range(len(values))
    rows = []
    for j, (i, v) in enumerate(zip(weeks, values)):
        extra = {k: (x[j] if isinstance(x, list) else x) for k, x in cols.items()}
        rows.append({"week": week(i), "upc": upc, "channel_outlet": "c", "retail_account": account,
                     "geography_raw": "g", "base_units": float(v), **extra})
    return spark.createDataFrame(rows)


# ---------------------------------------------------------------- scale helpers


def test_exact_quantiles_with_ties_and_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([rng.randint(0, 50), rng.random() * 1000]))) for _ in range(30_000)]
    rows += [("small", float(rng.randint(0, 3))) for _ in range(7)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in scale.exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in ("hot", "small", "one"):
        vals = [v for k, v in rows if k == key]
        for n, p in probs.items():
            assert got[key][n] == pytest.approx(np.percentile(vals, 100 * p), abs=1e-9), (key, n)
    whole = scale.exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median([v for _, v in rows]))


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.randint(0, 9)) for i in rng.sample(range(10**6), 5000)] + [("b", 1, 3)]
    df = spark.createDataFrame(rows, "k string, x long, n long")
    got = {(r.k, r.x): r.c for r in scale.running_totals(df, ["k"], "x", {"c": "n"}, buckets=16).collect()}
    for key in ("a", "b"):
        total = 0
        for k, x, n in sorted(r for r in rows if r[0] == key):
            total += n
            assert got[(k, x)] == total


def test_lookup_is_hinted_only_when_small(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(scale.config_lookup(spark, [("a", 1)], "k string, v int")).lower()
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 1)
    big = scale.config_lookup(spark, [("a", 1), ("b", 2)], "k string, v int")
    assert "broadcast" not in plan(big).lower()


def test_distribution_tails(spark):
    r = spark.range(1).select(
        stats.normal_sf2(F.lit(1.959964)).alias("z"), stats.student_sf2(F.lit(2.228), F.lit(10.0)).alias("t"),
        stats.student_sf2(F.lit(3.182), F.lit(3.0)).alias("t3"),
        stats.kolmogorov_sf(F.lit(1.36 / math.sqrt(5000)), F.lit(10000.0), F.lit(10000.0)).alias("k")).first()
    assert r.z == pytest.approx(0.05, abs=1e-4)
    assert r.t == pytest.approx(0.05, abs=1e-3)
    assert r.t3 == pytest.approx(0.05, abs=1e-3)
    assert r.k == pytest.approx(0.05, abs=3e-3)


# ---------------------------------------------------------------- windows and labels


def test_row_windows_skip_missing_weeks_and_the_spine_fills_them(spark):
    df = frame(spark, [1, 2, 3, 4], weeks=[0, 1, 5, 6], tdp=1.0)
    rows = windows.add_lags(df, "base_units", (1,)).orderBy("week").collect()
    assert [r.base_units_lag1 for r in rows] == [None, 1, 2, 3]
    spine = forecast.weekly_spine(df, ["base_units"]).orderBy("week").collect()
    assert [r.base_units for r in spine] == [1, 2, 2, 2, 2, 3, 4]
    assert sum(r.is_filled for r in spine) == 3


def test_zscore_is_zero_without_spread_and_has_its_ceiling(spark):
    flat = frame(spark, [5] * 14, avg_weekly_units_spm=1.0, tdp=2.0)
    assert {r.base_units_z13 for r in windows.event_detection(flat).collect()} == {0.0}
    spike = frame(spark, [5] * 12 + [50], avg_weekly_units_spm=1.0, tdp=2.0)
    last = windows.event_detection(spike).orderBy(F.desc("week")).first()
    assert last.base_units_z13 == pytest.approx(12 / math.sqrt(13))
    assert last.base_units_outlier_class == "EXTREME_OUTLIER"


@pytest.mark.parametrize("donor, focal, label", [
    (-0.12, 0.05, "CANNIBALIZING"), (-0.05, 0.01, "WATCH"), (-0.01, 0.5, "INCREMENTAL"),
    (-0.05, -0.01, "NEUTRAL"), (-0.12, None, "NEUTRAL"), (0.02, None, "INCREMENTAL")])
def test_labels_keep_unknowns(spark, donor, focal, label):
    c = lambda x: F.lit(x).cast("double")
    assert spark.range(1).select(transfer.label_deterministic(c(donor), c(focal)).alias("l")).first().l == label


def products(spark):
    """(upc, brand, specific flavor, flavor, pack)"""
    items = [("m1", "ME", "s1", "f1", 1), ("m2", "ME", "s1", "f1", 4), ("m3", "ME", "s1", "f1", 4),
             ("m4", "ME", "s2", "f1", 4), ("m5", "ME", "s3", "f2", 1), ("m6", "ME", None, None, 1),
             ("r1", "RIVAL", "s1", "f1", 1), ("r2", "RIVAL", "s9", "f2", 1), ("r3", "RIVAL", None, None, 8),
             ("x1", "OTHER", "s9", "f9", 1)]
    base = dict(channel_outlet="c", retail_account="a", geography_raw="g", geography_level="RMA", arp=2.0,
                base_arp=2.0, promo_weeks=0, units_pct_promo=0.0, base_units=1.0, base_units_yago=1.0, units=1.0,
                incr_units=0.0, tdp=1.0, avg_weekly_units_spm=1.0, avg_weekly_units_per_store_selling_per_item=1.0,
                store_count=1, stores_selling=1, pct_stores_selling=1.0, arp_pct_discount_any_promo=0.0,
                units_lift_tpr=0.0, units_lift_any_display=0.0, units_lift_any_feature=0.0, market_excluded_flag=0,
                size_oz=1.0, first_week_selling=D0)
    schema = ("week date, upc string, description string, parent_brand string, source_brand string, brand_line string, "
              "specific_flavor_normalized string, flavor string, pack_count bigint")
    rows = [(week(i), u, u, b, b, b, s, f, p) for i in range(2) for u, b, s, f, p in items]
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(v).alias(k) for k, v in base.items()]), items


def test_pool_equals_the_direct_definition(spark):
    df, items = products(spark)
    got = {(r.focal_upc, r.candidate_upc): r.relationship_distance
           for r in pool.comparison_pool(df, CFG).where(F.col("week") == week(0)).collect()}
    want = {}
    for a in items:
        for b in items:
            eq = lambda i: a[i] is not None and a[i] == b[i]  # noqa: B023, E731
            if a[0] != b[0] and "ME" in (a[1], b[1]) and (eq(2) or eq(3) or (a[1] == b[1] == "ME")):
                known = a[2] is not None and b[2] is not None
                fam = a[3] is not None and b[3] is not None
                brand = a[1] == b[1]
                want[(a[0], b[0])] = (
                    1 if eq(2) and brand and a[4] != b[4] else 2 if eq(2) and not brand
                    else 3 if eq(3) and brand and known and a[2] != b[2] else 4 if eq(3) and not brand
                    else 5 if fam and a[3] != b[3] and brand else 6)
    assert got == want
    assert got[("m2", "m3")] == 6  # same brand, flavor and pack falls through every branch
    assert pool.comparison_pool(df, CFG).count() == 2 * len(want)
    assert all((b, a) in got for a, b in got)


def test_ladder_norms_and_price_guard(spark):
    e = [(week(i), "m1", 2.0 + (0.01 if i > 12 else 0.0), 10.0) for i in range(26)]
    df = spark.createDataFrame(e, "week date, upc string, price_per_unit double, base_units double").select(
        "*", *[F.lit("x").alias(c) for c in MARKET_KEYS], F.lit("d").alias("description"), F.lit(1).alias("pack_count"),
        F.lit("f").alias("flavor"), F.lit("s").alias("specific_flavor_normalized"), F.lit(1.0).alias("avg_weekly_units_spm"),
        F.lit(0.0).alias("arp_pct_discount_any_promo"), F.lit(1.0).alias("tdp"), F.lit(0).alias("promo_weeks"))
    win = price.price_windows(df)
    scored = price.elasticity_score(price.elasticity_frame(win, guard=False).withColumn("predicted_log_unit_change", F.lit(-0.1)))
    assert {r.elasticity_band for r in scored.collect()} == {"Insufficient Price Variation"}
    assert price.elasticity_frame(win).count() == 0


def test_inferred_promotion(spark):
    df = frame(spark, [10] * 10, arp=[2.0] * 9 + [1.94], total_units=10.0, units_promo=0.0, incr_units=0.0)
    p = panel_ops.promo_signals(df.withColumn("arp_roll8_avg", windows.rolling_prior("arp", 8, 2)))
    last = p.orderBy(F.desc("week")).first()
    assert last.promo_source == "arp_inferred" and last.is_promo_week == 1


def test_win_flags_unknown_without_baseline(spark):
    df = frame(spark, [1, 2], avg_weekly_units_spm=[1.0, 2.0], dollars=1.0, tdp=1.0, promo_weeks=[1, 0], incr_units=0.0)
    first, second = wins.win_flags(df).orderBy("week").collect()
    assert first.sku_week_win_flag is None and second.sku_week_win_flag is True


# ---------------------------------------------------------------- text


def test_flavor_rules(spark):
    text = ["Acme Pnt Bttr Brwn Prtn Br 1.7 oz (12 ct)", "ACME sour peach puff 2oz", "Acme Vrty Pck", "Acme Mint & Cream (new)"]
    df = spark.createDataFrame([(t,) for t in text], "d string").withColumn("raw", flavor.extract_flavor("d", ("acme",)))
    df = df.withColumn("name", flavor.normalize_flavor("raw")).withColumn("review", flavor.needs_review("raw", "name"))
    got = {r.d: (r.name, r.review) for r in df.collect()}
    assert got[text[0]] == ("Peanut Butter Brownie", False)
    assert got[text[1]] == ("Peach", False)
    assert got[text[2]] == ("Variety Pack", False)
    assert got[text[3]] == ("Mint and Cream", False)
    bad = spark.createDataFrame([("Choc Prtn",), ("",)], "raw string")
    assert all(r.x for r in bad.select(flavor.needs_review("raw", flavor.normalize_flavor("raw")).alias("x")).collect())


# ---------------------------------------------------------------- forecasting


def test_recursion_matches_a_loop_and_the_model_variant(spark):
    rng = random.Random(3)
    hist = [10 + 5 * math.sin(i / 8) + rng.random() for i in range(70)]
    df = frame(spark, hist)
    got = [r.forecast_units_base for r in forecast.recursive_forecast(
        df, forecast.lag_rule({1: 0.5, 4: 0.3, 13: 0.2})).orderBy("forecast_week_number").collect()]
    h = hist[-65:]
    yoy = min(2.0, max(0.5, h[-1] / h[-52]))
    n0, want = len(h), []
    for k in range(1, 14):
        base = 0.5 * h[-1] + 0.3 * h[-4] + 0.2 * h[-13]
        v = 0.6 * base + 0.4 * h[n0 - 53 + k] * yoy
        want.append(v)
        h.append(v)
    assert got == pytest.approx(want)

    def predict(f):
        base = 0.5 * F.col("lag1") + 0.3 * F.col("lag4") + 0.2 * F.col("lag13")
        return f.select("*", base.alias("base"), (base * 0.8).alias("low"), (base * 1.2).alias("high"))

    stepped = [r.forecast_units_base for r in forecast.recursive_model_forecast(df, predict).orderBy("forecast_week_number").collect()]
    assert stepped == pytest.approx(want)


def test_totals_never_fall_below_base(spark):
    df = frame(spark, [10] * 60, arp=2.0, units=[12.0] * 59 + [1.0])
    rule = forecast.lag_rule({1: 1.0})
    base, total = forecast.recursive_forecast(df, rule), forecast.recursive_forecast(df, rule, target="units")
    rows = forecast.coherent_total(base, total).collect()
    assert len(rows) == 13
    assert all(r.forecast_total_units_base >= r.forecast_units_base for r in rows)
    assert {r.forecast_dollars_base for r in rows} == {20.0}


def test_holt_finds_a_straight_line(spark):
    rows = forecast.holt_forecast(frame(spark, [3 + 2 * i for i in range(20)])).orderBy("forecast_week_number").collect()
    assert [r.holt_units for r in rows] == pytest.approx([3 + 2 * (19 + k) for k in range(1, 14)])


def test_portfolio_constraint_conserves_units_and_caps(spark):
    cols = "upc string, channel_outlet string, retail_account string, geography_raw string, forecast_week_number int, forecast_units_base double, weeks_since_launch int"
    f = spark.createDataFrame([("f1", "c", "a", "g", 1, 40.0, 0), ("f2", "c", "a", "g", 1, 20.0, 13), ("f3", "c", "a", "g", 1, 5.0, 0),
                               *[(f"d{i}", "c", "a", "g", 1, 100.0, 99) for i in range(3)]], cols)
    pairs = spark.createDataFrame([(fo, d, "c", "a", "g", p) for fo, d, p in (
        ("f1", "d0", 0.9), ("f2", "d0", 0.8), ("f1", "d1", 0.7), ("f1", "d2", 0.6), ("f3", "d0", 0.9), ("f2", "d2", 0.2))],
        "focal_upc string, donor_upc string, channel_outlet string, retail_account string, geography_raw string, transfer_prob double")
    out = {r.upc: r for r in forecast.portfolio_constraint(f, pairs).collect()}
    assert sum(r.portfolio_adj_delta for r in out.values()) == pytest.approx(0)
    assert out["f1"].portfolio_adj_delta == pytest.approx(20)  # half of its own forecast
    assert all(-20 - 1e-9 <= out[f"d{i}"].portfolio_adj_delta <= 0 for i in range(3))
    assert out["f3"].portfolio_adj_type == "NONE"  # below the presence floor
    assert out["f2"].portfolio_adj_delta == 0  # its donor was spent on the stronger claim


def test_dtw_matches_brute_force(spark):
    rng = random.Random(4)
    a, b = [rng.random() for _ in range(6)], [rng.random() for _ in range(8)]
    got = spark.range(1).select(launch.dtw_distance(
        F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("d")).first().d
    cost = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost[0][0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = abs(x - y) + min(cost[i - 1][j], cost[i][j - 1], cost[i - 1][j - 1])
    assert got == pytest.approx(cost[-1][-1])


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    x, z1, z2 = rng.normal(size=200), rng.normal(size=200), rng.normal(size=200)
    y = 1 - 2 * x + 0.5 * z1 + 3 * z2 + rng.normal(size=200) * 0.3
    df = spark.createDataFrame([("k", *map(float, r)) for r in zip(y, x, z1, z2)], "k string, y double, x double, z1 double, z2 double")
    r = price.ols_slope2(df, ["k"], "y", "x", ["z1", "z2"], 20).first()
    m = np.column_stack([np.ones(200), x, z1, z2])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    se = math.sqrt(rss[0] / (200 - 4) * np.linalg.inv(m.T @ m)[1, 1])
    assert (r.coef, r.se) == (pytest.approx(beta[1]), pytest.approx(se))


# ---------------------------------------------------------------- causal


def _event_panel(spark, lift):
    rng = random.Random(6)
    wave = [20 + 5 * math.sin(i / 3) + rng.random() for i in range(26)]
    out = frame(spark, [v * (1 + lift if i >= 13 else 1) for i, v in enumerate(wave)], arp=[2.0] * 13 + [1.5] * 13)
    for k, acct in enumerate(("a2", "a3")):
        out = out.unionByName(frame(spark, [2 * v + k + rng.random() for v in wave], account=acct, arp=3.0))
    ev = spark.createDataFrame([("u1", "c", "a1", "g", week(25), -0.25, 12, 12)],
                               "upc string, channel_outlet string, retail_account string, geography_raw string, event_week date, price_pct_chg double, pre_weeks int, post_weeks int")
    return causal.control_pairs(out, ev)


def test_planted_step_is_found_and_its_absence_too(spark):
    hit = causal.event_impact(_event_panel(spark, 0.2)).first()
    assert hit.causal_verdict == "SIGNIFICANT" and hit.n_control_series == 2
    assert hit.causal_impact_pct == pytest.approx(20, abs=4)
    none = causal.event_impact(_event_panel(spark, 0.0)).first()
    assert abs(none.causal_impact_pct) < 4
    s = causal.impact_sensitivity(_event_panel(spark, 0.2)).first()
    assert s.robust_verdict == "ROBUST" and s.direction_consistent and "held in all 9" in s.narrative


def test_ramps_meet_on_the_weeks_the_launch_has_had(spark):
    def product(upc, start, speeds):
        speeds = [float(v) for v in speeds]
        return frame(spark, speeds, upc=upc, weeks=range(start, start + len(speeds)), parent_brand="ME",
                     market_excluded_flag=0, avg_weekly_units_spm=speeds, arp=2.0, pack_count=4, flavor="x",
                     first_week_selling=week(start))

    ramp = [1, 2, 4, 7, 8]
    rows = product("new", 0, ramp).unionByName(
        product("grew", -1500, [3 * v for v in ramp] + [60, 80, 90])
    ).unionByName(product("faded", -1500, [8, 8, 7, 8, 8] + [0.1] * 8))
    got = {r.analog_upc: r for r in launch.ramp_match(rows, CFG).collect()}
    # what the analogs did later plays no part, and neither is compared with the other
    assert {r.upc for r in got.values()} == {"new"} and set(got) == {"grew", "faded"}
    assert got["grew"].match_rank == 1 and got["grew"].dtw == pytest.approx(0)


def test_donor_weights_are_optimal(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((12, 20)) * 10, rng.random(20) * 10
    fitted = causal.simplex_weights(x, y, np.eye(12)[0], 1e-9)
    slope = x @ (fitted @ x - y)
    assert fitted.min() >= 0 and fitted.sum() == pytest.approx(1)
    # no donor lowers the error: the condition of an optimum on the simplex
    assert slope @ fitted - slope.min() < 1e-6


def test_quantiles_and_running_sums_keep_the_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r.k: r.m for r in scale.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}
    sums = {(r.k, r.v): r.s for r in scale.running_totals(df, ["k"], "v", {"s": "v"}).collect()}
    assert sums == {(None, 1.0): 1.0, (None, 3.0): 4.0, ("a", 5.0): 5.0}


def test_synthetic_control_recovers_a_mixture(spark):
    rng = random.Random(7)
    d = {f"d{k}": [rng.random() * 10 for _ in range(30)] for k in range(4)}
    y = [0.6 * a + 0.4 * b + (3 if i >= 20 else 0) for i, (a, b) in enumerate(zip(d["d0"], d["d1"]))]
    df = frame(spark, y, upc="t", arp=1.0)
    for k, v in d.items():
        df = df.unionByName(frame(spark, v, upc=k, arp=1.0))
    focal, others = causal.treated_panel(df, {"upc": "t"}, week(0), week(20), week(29))
    donors = causal.donor_pool(others, focal, min_donors=1, min_corr=-1.0)
    w, lift = causal.synthetic_control(others, focal, donors)
    got = {r.upc: r.weight for r in w.collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert got["d0"] == pytest.approx(0.6, abs=0.1)
    assert lift.first().incremental_units == pytest.approx(30, abs=4)


# ---------------------------------------------------------------- ingest and audits


def test_header_and_guard(spark):
    assert normalize_header("Units,  % Promo ") == "units % promo"
    with pytest.raises(ValueError, match="missing columns"):
        assert_columns(spark.range(1), "filtered_weekly")
    raw = spark.createDataFrame([("2024-01-01", "12", "n/a")], "`TIME` string, `PACK COUNT` string, `Units` string")
    r = ingest.normalize_extract(raw).first()
    assert (r.source_pack_count, r.units, r.department) == (12, None, None)


def test_replace_weeks_is_idempotent_and_bounded(spark, tmp_path):
    path = str(tmp_path / "t")
    df = frame(spark, [1] * 12)
    ingest.rebuild(df, path)
    new = df.where(F.col("week") != week(6)).withColumn("base_units", F.lit(9.0))
    for _ in range(2):
        ingest.replace_weeks(new, path, dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    got = {r.week: r.base_units for r in spark.read.parquet(path).collect()}
    assert week(6) not in got and got[week(7)] == 9 and got[week(0)] == 1 and len(got) == 11
    ingest.replace_weeks(new.limit(0), path, dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert spark.read.parquet(path).where("month(week) = 2").count() == 0
    with pytest.raises(ValueError):
        ingest.replace_weeks(df, path, dt.date(2024, 2, 2), dt.date(2024, 3, 1))


def test_late_deliveries_restate_their_month(spark, tmp_path):
    from shelfwise.streaming.restate import weekly_deliveries

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = frame(spark, [1, 2, 3]).withColumn("delivered_at", F.lit(1))
    late = frame(spark, [7], weeks=[1]).withColumn("delivered_at", F.lit(2))
    for part in (first, late, late):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(first.schema).parquet(src)
        q = weekly_deliveries(stream, out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.week: r.base_units for r in spark.read.parquet(out).collect()}
    assert got == {week(0): 1.0, week(1): 7.0, week(2): 3.0}


def test_ingest_checks_catch_violations(spark):
    cols = dict(units=1.0, source_brand="ME")
    before = frame(spark, [1] * 6, **cols)
    good = frame(spark, [1] * 8, **cols)
    bad = frame(spark, [1] * 8, weeks=[0, 1, 2, 3, 4, 4, 7, 8], **cols)
    ok = {r.check_name: r.verdict for r in ingest.ingest_checks(before, good, week(5), CFG).collect()}
    assert set(ok.values()) == {"PASS"}
    ko = {r.check_name: r.verdict for r in ingest.ingest_checks(before, bad, week(5), CFG).collect()}
    assert ko["no_duplicate_rows"] == ko["weekly_cadence"] == "FAIL"


def test_dedup_has_no_window(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(500)] + [("j", 1, 1.0)], "k string, t int, v double")
    out = ingest.dedup_latest(df, ["k"], ["t"])
    assert {r.k: r.v for r in out.collect()} == {"k": 499.0, "j": 1.0}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_audits_flag_planted_problems(spark):
    rng = random.Random(8)
    rows = [(week(i % 40), f"u{i % 5}", float(rng.random() + (0.5 if i % 40 >= 20 else 0)), rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "week date, upc string, moved double, stable double").select(
        "*", *[F.lit("x").alias(c) for c in MARKET_KEYS])
    ks = {r.feature: r for r in evaluate.ks_shift(df, ["moved", "stable"], week(20)).collect()}
    assert ks["moved"].material and ks["moved"].direction == "higher" and not ks["stable"].material
    cuts = [D0 + dt.timedelta(days=91 * i) for i in range(5)]
    err = [(s, c, 10.0 * (1 + (i if s == "bad" else 0))) for i, c in enumerate(cuts) for s in ("a", "b", "c", "bad")]
    drift = {r.seg: r.is_drifting for r in evaluate.segment_drift(
        spark.createDataFrame(err, "seg string, cutpoint date, wmape double"), cuts).collect()}
    assert drift == {"a": False, "b": False, "c": False, "bad": True}


def test_asof_join(spark):
    left, right = frame(spark, [0] * 5), frame(spark, [10, 20], weeks=[1, 3])
    got = [r.asof_base_units for r in ranking.asof_join(left, right, "base_units").orderBy("week").collect()]
    assert got == [None, 10, 10, 20, 20]


def test_tier_and_rollup_filters(spark):
    df = spark.createDataFrame([("RIVAL", "TOTAL US - MULO", "RMA"), ("NEW", "Shop", "National"), ("RIVAL", "Shop", "RMA")],
                               "source_brand string, geography_raw string, geography_level string")
    assert enrich.exclude_rollups(df, CFG).count() == 1
    tiers = {r.source_brand: r.tier for r in enrich.attach_tier(df, CFG, "source_brand", "tier").collect()}
    assert tiers == {"RIVAL": 1, "NEW": None}


def test_pack_labels(spark):
    df = spark.createDataFrame([(p,) for p in (1, 3, 5, 12, 20, 24, None)], "p int")
    got = [r.b for r in df.select(scalar.pack_bucket("p", "range").alias("b")).collect()]
    assert got == ["1ct", "2-3pk", "4pk", "12pk", "18pk", "24pk", None]


def test_series_keys_cover_market():
    assert SERIES_KEYS == ["upc", *MARKET_KEYS]


def test_year_ranges_hold_every_week(spark):
    weeks = [dt.date(1989, 12, 25), dt.date(1996, 5, 6), dt.date(2007, 1, 1)]
    ranges = ingest.year_ranges(spark.createDataFrame([(w,) for w in weeks], "week date"))
    assert all(sum(a <= w < b for a, b in ranges) == 1 for w in weeks)
    with pytest.raises(ValueError):
        ingest.year_ranges(spark.createDataFrame([(weeks[0],), (None,)], "week date"))


def test_ladder_takes_the_model_where_history_reaches(spark):
    rows = frame(spark, [10.0 + i % 7 for i in range(60)], upc="SKU-03").unionByName(
        frame(spark, [10.0 + i % 7 for i in range(45)], upc="SKU-04"))
    model = forecast.with_history(forecast.recursive_forecast(rows, forecast.lag_rule({1: 1.0})), rows)
    got = forecast.forecast_ladder(
        model, forecast.holt_forecast(rows, min_rows=40), forecast.baselines(rows)
    ).groupBy("upc", "forecast_source").count().collect()
    assert sorted(map(tuple, got)) == [("SKU-03", "model", 13), ("SKU-04", "ets", 13)]
