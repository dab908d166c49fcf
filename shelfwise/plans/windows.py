"""Queries of the series windows (group E) and weekly wins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.scalar import safe_div
from shelfwise.operators import wins as wi
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored
from shelfwise.plans.registry import query
from shelfwise.plans.transfer import _cols, pairs, pool, prepost
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS, SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"
MW = f"week, {MARKET}"
W = f"WINDOW w AS (PARTITION BY {SERIES} ORDER BY week)"


@query("E1_wow_features", f"""
SELECT week, {SERIES}, units_lag_1, base_units_lag_1, tdp_lag_1, arp_lag_1,
  units - units_lag_1 AS units_wow_delta, base_units - base_units_lag_1 AS base_units_wow_delta,
  tdp - tdp_lag_1 AS tdp_wow_delta, arp - arp_lag_1 AS arp_wow_delta,
  units / nullif(units_lag_1, 0) - 1 AS units_wow_pct,
  base_units / nullif(base_units_lag_1, 0) - 1 AS base_units_wow_pct,
  tdp / nullif(tdp_lag_1, 0) - 1 AS tdp_wow_pct, units - base_units AS promo_gap_units
FROM (SELECT *, lag(units) OVER w AS units_lag_1, lag(base_units) OVER w AS base_units_lag_1,
    lag(tdp) OVER w AS tdp_lag_1, lag(arp) OVER w AS arp_lag_1 FROM c_filtered {W}) x
""")
def _(t):
    out = w.wow_features(t.filtered)
    return out.select("week", *SERIES_KEYS, *out.columns[len(t.filtered.columns):])


_ROLL = [f"{n}_roll{k}_{s}" for n, ks in (("base_units", (4, 8, 13)), ("velocity_spm", (8, 13)),
                                          ("tdp", (8, 13))) for k in ks for s in ("avg", "std")]


@query("E2_rolling_stats", f"SELECT week, {SERIES}, {', '.join(_ROLL)}, base_units_wow_delta, "
       "velocity_spm_wow_delta FROM c_rolling")
def _(t):
    return w.rolling_stats(t.enriched).select(
        "week", *SERIES_KEYS, *_ROLL, "base_units_wow_delta", "velocity_spm_wow_delta")


@query("E3_zscores", f"""
SELECT week, {SERIES}, base_units_z8, base_units_z13, velocity_spm_z8, velocity_spm_z13, tdp_z8,
  tdp_z13, base_units_outlier_class, velocity_spm_outlier_class,
  CASE WHEN NOT coalesce(base_units_roll8_std > 0, FALSE) THEN 'INSUFFICIENT_DATA'
    WHEN abs(base_units_z8) >= 3 THEN 'EXTREME_OUTLIER' WHEN abs(base_units_z8) >= 2 THEN 'OUTLIER'
    WHEN abs(base_units_z8) >= 1.5 THEN 'WATCH' ELSE 'NORMAL' END AS base_units_outlier_class_8w,
  CASE WHEN base_units_z8 > 0 THEN 'UP' ELSE 'DOWN' END AS base_units_outlier_dir
FROM c_events
""")
def _(t):
    return w.event_detection(t.enriched).select(
        "week", *SERIES_KEYS, "base_units_z8", "base_units_z13", "velocity_spm_z8",
        "velocity_spm_z13", "tdp_z8", "tdp_z13", "base_units_outlier_class",
        "velocity_spm_outlier_class", "base_units_outlier_class_8w", "base_units_outlier_dir")


@query("E4_running_peak", f"""
SELECT week, {SERIES}, max(tdp) OVER (w ROWS UNBOUNDED PRECEDING) AS peak_tdp,
  tdp / max(tdp) OVER (w ROWS UNBOUNDED PRECEDING) AS tdp_ratio_to_peak,
  tdp - lag(tdp, 4) OVER w AS tdp_4w_change FROM c_filtered {W}
""")
def _(t):
    from pyspark.sql import Window

    so_far = w.series().rowsBetween(Window.unboundedPreceding, 0)
    return t.filtered.select(
        "week", *SERIES_KEYS, F.max("tdp").over(so_far).alias("peak_tdp"),
        safe_div("tdp", F.max("tdp").over(so_far)).alias("tdp_ratio_to_peak"),
        (F.col("tdp") - F.lag("tdp", 4).over(w.series())).alias("tdp_4w_change"))


@query("E5_first_rows", f"""
SELECT {SERIES}, week, units FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week)
  AS rn FROM c_filtered) x WHERE rn = 1
""")
def _(t):
    return t.filtered.withColumn("_r", F.row_number().over(w.series())).where("_r = 1").select(
        *SERIES_KEYS, "week", "units")


_FLAGS = ["velocity_win_flag", "base_units_win_flag", "dollars_win_flag", "distribution_jump_flag",
          "promo_confounded_flag", "sku_week_win_flag", "quality_win_flag"]


@query("E7_trailing_baseline", f"""
SELECT week, {SERIES}, tv AS trailing_4w_avg_velocity, tb AS trailing_4w_avg_base_units,
  tt AS trailing_4w_avg_tdp FROM c_flags
""")
def _(t):
    return wi.win_flags(t.enriched).select(
        "week", *SERIES_KEYS, "trailing_4w_avg_velocity", "trailing_4w_avg_base_units",
        "trailing_4w_avg_tdp")


@query("E9_rolling_prior", f"""
SELECT week, {SERIES}, CASE WHEN count(arp) OVER p >= 4 THEN avg(arp) OVER p END AS arp_roll13_prior
FROM c_filtered WINDOW p AS (PARTITION BY {SERIES} ORDER BY week
  ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)
""")
def _(t):
    return t.filtered.select("week", *SERIES_KEYS,
                             w.rolling_prior("arp", 13, 4).alias("arp_roll13_prior"))


@query("E10_lags", f"SELECT week, {SERIES}, " + ", ".join(
    f"lag(base_units, {k}) OVER w AS base_units_lag{k}" for k in (1, 2, 3, 4, 8, 13, 52))
    + f" FROM c_filtered {W}")
def _(t):
    out = w.add_lags(t.filtered, "base_units")
    return out.select("week", *SERIES_KEYS, *out.columns[len(t.filtered.columns):])


@query("E11_diffs", f"""
SELECT week, {SERIES}, tdp - lag(tdp) OVER w AS tdp_diff1, tdp - lag(tdp, 4) OVER w AS tdp_diff4
FROM c_filtered {W}
""")
def _(t):
    return w.add_diffs(t.filtered, "tdp").select("week", *SERIES_KEYS, "tdp_diff1", "tdp_diff4")


def _donor_sums(t):
    """Units of all other products in the market-week, per own row."""
    total = t.enriched.groupBy(*MARKET_WEEK_KEYS).agg(F.sum("base_units").alias("_all"))
    return own_scored(t.enriched, t.cfg).join(total, MARKET_WEEK_KEYS).withColumn(
        "donor_sum_units", F.col("_all") - F.col("base_units"))


@query("E12_cannibal_pressure", f"""
WITH d AS (
  SELECT o.*, a.s - o.base_units AS donor FROM c_own o
  JOIN (SELECT {MW}, sum(base_units) AS s FROM c_enriched GROUP BY ALL) a
    USING (week, channel_outlet, retail_account, geography_raw)
), r AS (
  SELECT week, {SERIES},
    CASE WHEN count(base_units) OVER w8 >= 5 AND stddev_samp(base_units) OVER w8 > 0
      AND stddev_samp(donor) OVER w8 > 0 THEN -corr(base_units, donor) OVER w8 END AS p8,
    CASE WHEN count(base_units) OVER w4 >= 4 AND stddev_samp(base_units) OVER w4 > 0
      AND stddev_samp(donor) OVER w4 > 0 THEN -corr(base_units, donor) OVER w4 END AS p4
  FROM d WINDOW w8 AS (PARTITION BY {SERIES} ORDER BY week ROWS 7 PRECEDING),
    w4 AS (PARTITION BY {SERIES} ORDER BY week ROWS 3 PRECEDING)
)
--
SELECT week, {SERIES}, p8 AS rolling_cannibal_pressure, p4 - p8 AS rolling_cannibal_trend FROM r
""")
def _(t):
    return w.cannibal_pressure(_donor_sums(t)).select(
        "week", *SERIES_KEYS, "rolling_cannibal_pressure", "rolling_cannibal_trend")


@query("E13_rolling_elasticity", f"""
WITH u AS (
  SELECT week, {SERIES}, CASE WHEN ok THEN ln(1 + arp) END AS x,
    CASE WHEN ok THEN ln(1 + base_units) END AS y, CASE WHEN ok THEN arp / pack_count END AS bar
  FROM (SELECT *, arp > 0 AND base_units > 0 AND pack_count > 0 AS ok FROM c_own) q
), r AS (
  SELECT week, {SERIES}, CASE WHEN count(x) OVER p >= 5 AND max(bar) OVER p - min(bar) OVER p >= 0.05
    THEN regr_slope(y, x) OVER p END AS slope
  FROM u WINDOW p AS (PARTITION BY {SERIES} ORDER BY week ROWS 12 PRECEDING)
)
--
SELECT week, {SERIES}, CASE WHEN slope < -5 THEN -5 WHEN slope > 3 THEN 3 ELSE slope END
    AS rolling_elasticity, CASE WHEN slope IS NULL THEN 0 ELSE 1 END AS rolling_elas_valid FROM r
""")
def _(t):
    return w.rolling_elasticity(own_scored(t.enriched, t.cfg)).select(
        "week", *SERIES_KEYS, "rolling_elasticity", "rolling_elas_valid")


@query("E14_tail_rows", f"""
SELECT week, {SERIES}, units FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES}
  ORDER BY week DESC) AS rn FROM c_filtered) x WHERE rn <= 13
""")
def _(t):
    return w.tail_n(t.filtered, 13).select("week", *SERIES_KEYS, "units")


def _mean(c, lo, hi):
    return f"avg({c}) FILTER (WHERE rb BETWEEN {lo} AND {hi})"


@query("E15_growth_rates", f"""
SELECT {SERIES}, {_mean('base_units', 1, 13)} AS last13_base_units,
  CASE WHEN count(*) >= 16 THEN 100 * ({_mean('tdp', 1, 8)} / {_mean('tdp', 9, 16)} - 1) END
    AS tdp_growth_pct,
  CASE WHEN count(*) >= 16 THEN 100 * ({_mean('avg_weekly_units_spm', 1, 8)}
    / {_mean('avg_weekly_units_spm', 9, 16)} - 1) END AS vel_growth_pct
FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb
  FROM c_filtered) x WHERE rb <= 16 GROUP BY ALL
""")
def _(t):
    return w.growth_rates(t.filtered)


@query("E16_row_bands", f"""
SELECT {SERIES}, {_mean('base_units', 1, 13)} AS now_units, {_mean('base_units', 53, 65)} AS ago_units
FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb
  FROM c_filtered) x GROUP BY ALL
""")
def _(t):
    r = F.col("rows_back")
    return w.with_age(t.filtered).groupBy(*SERIES_KEYS).agg(
        F.avg(F.when(r.between(1, 13), F.col("base_units"))).alias("now_units"),
        F.avg(F.when(r.between(53, 65), F.col("base_units"))).alias("ago_units"))


@query("E19_range_windows", f"""
SELECT w.week, w.upc, w.channel_outlet, w.retail_account, w.geography_raw,
  avg(p.arp) FILTER (WHERE p.week >= w.week - 84) AS post_13w_arp,
  avg(p.arp) FILTER (WHERE p.week <= w.week - 91) AS pre_13w_arp,
  count(*) FILTER (WHERE p.week >= w.week - 84) AS post_13w_weeks,
  count(*) FILTER (WHERE p.week <= w.week - 91) AS pre_13w_weeks
FROM c_own w JOIN c_own p ON p.upc = w.upc AND p.channel_outlet = w.channel_outlet
  AND p.retail_account = w.retail_account AND p.geography_raw = w.geography_raw
  AND p.week BETWEEN w.week - 175 AND w.week
GROUP BY ALL
""")
def _(t):
    post, pre = w.trailing_weeks(-12, 0), w.trailing_weeks(-25, -13)
    return own_scored(t.enriched, t.cfg).select(
        "week", *SERIES_KEYS,
        F.avg("arp").over(post).alias("post_13w_arp"), F.avg("arp").over(pre).alias("pre_13w_arp"),
        F.count("week").over(post).alias("post_13w_weeks"),
        F.count("week").over(pre).alias("pre_13w_weeks"))


@query("E20_min_history", f"""
SELECT week, {SERIES}, base_units FROM (SELECT *, count(base_units) OVER (PARTITION BY {SERIES})
  AS n FROM c_filtered) x WHERE n >= 120
""")
def _(t):
    return w.min_history(t.filtered, 120).select("week", *SERIES_KEYS, "base_units")


# ---------------------------------------------------------------- wins


@query("H9_win_flags", f"SELECT week, {SERIES}, {', '.join(_FLAGS)} FROM c_flags")
def _(t):
    return wi.win_flags(t.enriched).select("week", *SERIES_KEYS, *_FLAGS)


@query("H10_group_wins", f"""
SELECT {MW}, specific_flavor_normalized, flavor, parent_brand,
  count(sku_week_win_flag) AS active_sku_count,
  count(*) FILTER (WHERE sku_week_win_flag) AS weekly_win_count,
  count(*) FILTER (WHERE NOT sku_week_win_flag) AS weekly_loss_count,
  count(*) FILTER (WHERE sku_week_win_flag) / nullif(count(sku_week_win_flag), 0) AS weekly_win_pct,
  sum(units) AS group_units, sum(dollars) AS group_dollars, sum(base_units) AS group_base_units,
  avg(avg_weekly_units_spm) AS group_avg_velocity, sum(tdp) AS group_tdp
FROM c_flags GROUP BY ALL
""")
def _(t):
    return wi.group_wins(wi.win_flags(t.enriched))


def assoc(t):
    return wi.win_association(pool(t), wi.win_flags(t.enriched))


@query("H11_win_association", "SELECT * FROM c_assoc")
def _(t):
    return assoc(t)


@query("C11_two_alias_join", f"""
SELECT comparison_type, sum(active_pair_weeks) AS pair_weeks, sum(co_win_weeks) AS co_win_weeks
FROM c_assoc GROUP BY 1
""")
def _(t):
    return assoc(t).groupBy("comparison_type").agg(
        F.sum("active_pair_weeks").alias("pair_weeks"), F.sum("co_win_weeks").alias("co_win_weeks"))


HEALTH_SQL = f"""
WITH g AS (
  SELECT {MW}, count(sku_week_win_flag) AS active_sku_count,
    count(*) FILTER (WHERE sku_week_win_flag) AS weekly_win_count,
    count(*) FILTER (WHERE sku_week_win_flag) / nullif(count(sku_week_win_flag), 0)
      AS weekly_win_pct,
    sum(units) AS u, sum(base_units) AS b, sum(tdp) AS tt
  FROM c_flags GROUP BY ALL
), h AS (
  SELECT g.*, c.win_concentration_ratio, c.related_loss_pct,
    coalesce(c.focal_won, FALSE) AS focal_won,
    b / nullif(lag(b) OVER m, 0) - 1 AS demand_change,
    tt / nullif(lag(tt) OVER m, 0) - 1 AS tdp_change,
    (u / tt) / nullif(lag(u / tt) OVER m, 0) - 1 AS units_tdp_change
  FROM g JOIN c_conc c USING (week, channel_outlet, retail_account, geography_raw)
  WINDOW m AS (PARTITION BY {MARKET} ORDER BY week)
), p AS (
  SELECT * EXCLUDE (u, b, tt), CASE
    WHEN focal_won AND related_loss_pct >= 0.5 AND demand_change <= 0.02
      THEN 'Possible Cannibalization'
    WHEN demand_change > 0 AND tdp_change > 0.15 AND weekly_win_pct < 0.5
      THEN 'Distribution-Led Growth'
    WHEN demand_change > 0 AND weekly_win_pct >= 0.7 THEN 'Broad Growth'
    WHEN demand_change > 0 AND weekly_win_pct >= 0.5 THEN 'Healthy Mix'
    WHEN demand_change > 0 THEN 'Concentrated Growth'
    WHEN demand_change < 0 AND weekly_win_pct < 0.5 THEN 'Portfolio Decline'
    ELSE 'Mixed' END AS pattern FROM h
)
--
"""


def health(t):
    return wi.pool_health(wi.win_flags(t.enriched), "SKU-05", t.cfg)


@query("H12_pool_pattern", HEALTH_SQL + "SELECT pattern, count(*) AS n FROM p GROUP BY 1")
def _(t):
    return health(t).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("H13_concentration", "SELECT * FROM c_conc")
def _(t):
    return wi.concentration(wi.win_flags(t.enriched), "SKU-05")


_CELL = """CASE WHEN tv IS NULL THEN '.' WHEN promo THEN 'P' WHEN distribution_jump_flag THEN 'D'
  WHEN abs(avg_weekly_units_spm - tv) <= 0.02 * tv THEN '0' WHEN avg_weekly_units_spm > tv THEN '+'
  ELSE '-' END"""
_WEEKS = [dt.date(1999, 1, 4) + dt.timedelta(weeks=i) for i in range(8)]


@query("H14_win_matrix", f"SELECT {SERIES}, " + ", ".join(
    f"min({_CELL}) FILTER (WHERE week = DATE '{d}') AS \"{d}\"" for d in _WEEKS)
    + f" FROM c_flags WHERE week BETWEEN DATE '{_WEEKS[0]}' AND DATE '{_WEEKS[-1]}' GROUP BY ALL")
def _(t):
    return wi.win_matrix(wi.win_flags(t.enriched), _WEEKS)


@query("H15_relation_map", f"""
SELECT focal_upc, comparison_upc, {MARKET}, CASE WHEN active_pair_weeks < 8 THEN 'Watch'
  WHEN opposition_rate >= 0.30 AND conditional_loss_lift > 1.1 THEN 'Pressure'
  WHEN comparison_loss_given_focal_win >= 0.60 AND conditional_loss_lift > 1.0 THEN 'Donates?'
  WHEN co_win_rate >= 0.30 THEN 'Co-wins'
  WHEN opposition_rate < 0.10 AND co_win_rate < 0.10 THEN 'Low' ELSE 'Neutral' END AS relation
FROM c_assoc
""")
def _(t):
    return wi.relation_map(assoc(t)).select("focal_upc", "comparison_upc", *MARKET_KEYS, "relation")


@query("H16_win_interval", """
WITH RECURSIVE wl AS (
  SELECT week, flavor, 1 + count(*) FILTER (WHERE sku_week_win_flag) AS a,
    1 + count(*) FILTER (WHERE NOT sku_week_win_flag) AS b FROM c_flags GROUP BY ALL
), hv AS (
  SELECT a, b, p, 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  FROM (SELECT DISTINCT a, b FROM wl) d, (VALUES (0.025), (0.975)) q(p)
  UNION ALL
  SELECT a, b, p, step + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
    SELECT *, list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j)
      + j * ln(mid) + (a + b - 1 - j) * ln(1 - mid)))) < p AS below
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM hv WHERE step < 40) m) h
), qt AS (SELECT a, b, p, (lo + hi) / 2 AS x FROM hv WHERE step = 40)
--
SELECT week, flavor, a / (a + b) AS win_rate_mean, l.x AS win_rate_low, h.x AS win_rate_high
FROM wl JOIN qt l USING (a, b) JOIN qt h USING (a, b) WHERE l.p < 0.5 AND h.p > 0.5
""")
def _(t):
    return wi.win_interval(wi.group_wins(wi.win_flags(t.enriched), ["week", "flavor"])).select(
        "week", "flavor", "win_rate_mean", "win_rate_low", "win_rate_high")


@query("H16_win_posterior", f"""
WITH x AS (
  SELECT week, flavor, 1.0 + count(*) FILTER (WHERE sku_week_win_flag) AS a,
    1.0 + count(*) FILTER (WHERE NOT sku_week_win_flag) AS b FROM c_flags GROUP BY ALL
), y AS (
  SELECT week, flavor, a / (a + b) AS m, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS s FROM x
)
--
SELECT week, flavor, m AS win_rate_mean, greatest(0, m - 1.959964 * s) AS win_rate_low,
  least(1, m + 1.959964 * s) AS win_rate_high FROM y
""")
def _(t):
    return wi.win_posterior(wi.group_wins(wi.win_flags(t.enriched), ["week", "flavor"])).select(
        "week", "flavor", "win_rate_mean", "win_rate_low", "win_rate_high")


@query("H24_competitor_pressure", f"""
SELECT focal_upc, {MW}, count(*) AS competitor_count,
  sum(1 / relationship_distance) AS weighted_competitor_count,
  sum(candidate_tdp / relationship_distance) AS weighted_competitor_tdp,
  sum(candidate_units_pct_promo / relationship_distance) / sum(1 / relationship_distance)
    AS weighted_promo_intensity,
  sum(candidate_arp / relationship_distance) / sum(1 / relationship_distance)
    AS weighted_competitor_price,
  min(candidate_arp) AS min_competitor_price,
  max(CASE WHEN datediff('day', candidate_first_week_selling, week) < 91 THEN 1 ELSE 0 END)
    AS competitor_new_launch_flag
FROM c_pool WHERE focal_brand = 'OWN' AND candidate_brand <> 'OWN' GROUP BY ALL
""")
def _(t):
    return wi.competitor_pressure(pool(t), t.cfg)


@query("H24_co_presence", f"""
SELECT focal_upc, candidate_upc, {MARKET}, count(*) AS co_presence_weeks FROM c_pool GROUP BY ALL
""")
def _(t):
    from shelfwise.operators.pool import co_present_weeks

    return co_present_weeks(pool(t))


@query("H25_view_metrics", f"""
WITH v AS (
  SELECT {SERIES}, post_13w_base_units - pre_13w_base_units AS change_abs,
    post_13w_base_units / nullif(pre_13w_base_units, 0) - 1 AS b,
    post_13w_tdp / nullif(pre_13w_tdp, 0) - 1 AS r,
    (post_13w_base_units / nullif(post_13w_tdp, 0))
      / nullif(pre_13w_base_units / nullif(pre_13w_tdp, 0), 0) - 1 AS p FROM u_prepost
)
--
SELECT {SERIES}, change_abs, b AS base_units_change_pct, r AS tdp_change_pct,
  p AS units_tdp_change_pct, CAST(sign(b) AS DOUBLE) AS demand_signal,
  CAST(sign(r) AS DOUBLE) AS reach_signal, CAST(sign(p) AS DOUBLE) AS productivity_signal,
  CASE WHEN b > 0 AND p > 0 THEN 'Green' WHEN b > 0 AND r > 0 THEN 'Yellow'
    WHEN b IS NULL THEN 'No data' ELSE 'Red' END AS scorecard FROM v
""", trim_launch=False)
def _(t):
    return wi.view_metrics(prepost(t))


@query("H25_incrementality_proxy", f"""
SELECT focal_upc, {MARKET}, max(focal_base_units_pct_chg) AS focal_base_units_pct_chg,
  avg(donor_base_units_pct_chg) AS avg_donor_base_units_pct_chg,
  max(focal_base_units_pct_chg) - avg(donor_base_units_pct_chg) AS incrementality_proxy
FROM u_pairs GROUP BY ALL
""", trim_launch=False)
def _(t):
    return wi.incrementality_proxy(pairs(t))


@query("H26_derived_families", f"""
SELECT week, {SERIES}, units / nullif(units_yago, 0) - 1 AS units_yoy_pct,
  base_units / nullif(base_units_yago, 0) - 1 AS base_units_yoy_pct,
  tdp / nullif(tdp_yago, 0) - 1 AS tdp_yoy_pct,
  avg_weekly_units_spm / nullif(avg_weekly_units_spm_yago, 0) - 1 AS velocity_yoy_pct,
  dollars / nullif(dollars_yago, 0) - 1 AS dollars_yoy_pct,
  max_acv - avg_acv AS acv_gap, incr_units / units AS incr_units_share,
  greatest(units_lift_tpr, units_lift_any_display, units_lift_any_feature) AS promo_lift_max,
  CASE WHEN units_lift_any_display > 0 OR units_lift_any_feature > 0 THEN 1 ELSE 0 END
    AS display_or_feature_flag,
  1 - arp / base_arp AS discount_depth, arp / pack_count AS price_per_pack_unit,
  dollars / tdp AS dollars_per_tdp,
  CASE WHEN units < units_yago AND dollars > dollars_yago THEN 1 ELSE 0 END
    AS unit_loss_but_dollar_gain_flag
FROM c_enriched
""")
def _(t):
    return wi.derived_families(t.enriched)


@query("H27_pool_health", HEALTH_SQL + "SELECT * FROM p")
def _(t):
    return health(t)
