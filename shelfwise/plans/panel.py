"""Queries of groups D, F and J that run on the panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.scalar import weeks_between
from shelfwise.operators import aggregates as ag
from shelfwise.operators import forecast as fo
from shelfwise.operators import panel as pa
from shelfwise.operators import price as pr
from shelfwise.operators import ranking as ra
from shelfwise.operators import segment as sg
from shelfwise.operators import wins as wi
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored
from shelfwise.operators.transfer import rank_donors, rate_weekly
from shelfwise.plans import transfer as tp
from shelfwise.plans.price import LIFT_SQL, EV_SQL, detectors, rule_elasticity
from shelfwise.plans.registry import query
from shelfwise.plans.transfer import RATE_SQL, RULE_SCORED_SQL
from shelfwise.scale import written
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"
MW = f"week, {MARKET}"


def own(t):
    return own_scored(t.enriched, t.cfg)


def known_weeks(t):
    """Own rows but for the newest 13 weeks, which forecasts are held against; each series ends at its own last week."""
    rows = own(t)
    newest = rows.agg(F.max("week").alias("w")).select("w").scalar()
    return rows.withColumn("_newest", newest).where(F.col("week") <= F.date_sub("_newest", 91)).drop("_newest")


def flat_forecast(t):
    """A constant 13-week forecast from the last 13 weeks of `known_weeks`."""
    rows = w.with_age(known_weeks(t))
    r = F.col("rows_back")
    a = rows.groupBy(*SERIES_KEYS).agg(
        F.max("week").alias("anchor_week"),
        F.avg(F.when(r <= 13, F.col("base_units"))).alias("m"),
        F.max(F.when(r == 1, F.col("arp"))).alias("arp"),
        F.max(F.when(r == 1, F.col("base_units"))).alias("anchor_value"),
        F.max(weeks_between("week", "first_week_selling")).alias("wsl"))
    return a.select("*", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("forecast_week_number")).select(
        *SERIES_KEYS, F.date_add("anchor_week", F.col("forecast_week_number") * 7).alias("week"),
        "forecast_week_number", "anchor_week", (F.col("m") * 0.8).alias("forecast_units_low"),
        F.col("m").alias("forecast_units_base"), (F.col("m") * 1.2).alias("forecast_units_high"),
        "arp", (F.col("wsl") + F.col("forecast_week_number")).alias("weeks_since_launch"),
        "anchor_value")


# ---------------------------------------------------------------- D


@query("D11_category_share", f"""
SELECT o.week, o.upc, o.channel_outlet, o.retail_account, o.geography_raw, category_tdp_sum,
  category_units_sum, least(1, o.tdp / category_tdp_sum) AS own_tdp_share
FROM c_own o JOIN (SELECT {MW}, sum(tdp) AS category_tdp_sum, sum(base_units) AS category_units_sum
  FROM c_filtered GROUP BY ALL) c USING ({MW})
""")
def _(t):
    return ag.category_share(own(t), t.filtered).select(
        "week", *SERIES_KEYS, "category_tdp_sum", "category_units_sum", "own_tdp_share")


_DONOR_SQL = RULE_SCORED_SQL.replace("\n--\n", f""", td AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focal_upc, {MARKET}
    ORDER BY transfer_prob DESC, donor_upc) AS rn FROM scored) q WHERE rn <= 3
), sig AS (
  SELECT f.week, td.focal_upc AS upc, td.channel_outlet, td.retail_account, td.geography_raw,
    sum(tdp) AS top_donor_tdp_sum, sum(base_units) AS top_donor_units_sum,
    sum(arp * tdp) / sum(tdp) AS top_donor_arp_wavg,
    sum(tdp) FILTER (WHERE NOT o) AS competitor_donor_tdp_sum,
    sum(base_units) FILTER (WHERE NOT o) AS competitor_donor_units_sum,
    sum(arp * tdp) FILTER (WHERE NOT o) / sum(tdp) FILTER (WHERE NOT o)
      AS competitor_donor_arp_wavg,
    sum(tdp) FILTER (WHERE o) AS own_donor_tdp_sum,
    sum(base_units) FILTER (WHERE o) AS own_donor_units_sum
  FROM td JOIN (SELECT *, source_brand LIKE 'OWN%' AS o FROM c_filtered) f ON f.upc = td.donor_upc
    AND f.channel_outlet = td.channel_outlet AND f.retail_account = td.retail_account
    AND f.geography_raw = td.geography_raw
  GROUP BY ALL
)
--
""")


@query("D12_donor_signals", _DONOR_SQL + "SELECT * FROM sig")
def _(t):
    return ag.donor_signals(rank_donors(tp.rule_scored(t), top=3), t.filtered, t.cfg)


@query("D8_weighted_averages", f"""
SELECT {MARKET}, sum(arp * tdp) / sum(tdp) AS tdp_weighted_arp,
  sum(arp_pct_discount_any_promo * units) / sum(units) AS unit_weighted_discount
FROM c_filtered GROUP BY ALL
""")
def _(t):
    from shelfwise.functions.scalar import weighted_avg

    return t.filtered.groupBy(*MARKET_KEYS).agg(
        weighted_avg("arp", "tdp").alias("tdp_weighted_arp"),
        weighted_avg("arp_pct_discount_any_promo", "units").alias("unit_weighted_discount"))


@query("D16_mix_share", f"""
SELECT week, {SERIES}, units / sum(units) OVER (PARTITION BY {MW}, specific_flavor_normalized)
    AS pack_mix_share,
  base_units / nullif(sum(base_units) OVER (PARTITION BY {MW}, specific_flavor_normalized), 0)
    AS pack_mix_base_share,
  units / sum(units) OVER (PARTITION BY week, upc) AS channel_mix_share
FROM c_enriched
""")
def _(t):
    return ag.mix_share(t.enriched)


@query("D17_category_summary", """
SELECT upc, channel_outlet, retail_account, sum(base_units) AS base_units_13w,
  avg(avg_weekly_units_spm) AS avg_velocity_spm, avg(tdp) AS avg_tdp,
  avg(pct_stores_selling) AS avg_pct_stores, avg(arp) AS avg_arp, count(DISTINCT week) AS weeks_present
FROM c_filtered WHERE base_units > 0 AND week >= (SELECT max(week) FROM c_filtered) - 91
GROUP BY ALL
""")
def _(t):
    return ag.category_summary(t.filtered)


@query("D18_velocity_summary", f"""
WITH m AS (SELECT max(week) AS mx FROM c_filtered),
s AS (
  SELECT upc, channel_outlet, retail_account,
    avg(avg_weekly_units_spm) FILTER (WHERE week >= mx - 91) AS vel_13w_avg,
    count(*) FILTER (WHERE week >= mx - 91) AS weeks_13, avg(avg_weekly_units_spm) AS vel_52w_avg,
    min(avg_weekly_units_spm) AS vel_52w_min, max(avg_weekly_units_spm) AS vel_52w_max,
    median(avg_weekly_units_spm) AS vel_52w_med
  FROM c_filtered, m WHERE base_units > 0 AND week >= mx - 364 GROUP BY ALL
), f AS (
  SELECT upc, channel_outlet, retail_account, avg(forecast_units_base / a) AS fv
  FROM c_flat JOIN (SELECT upc, channel_outlet, retail_account, avg(tdp) AS a FROM c_filtered
    GROUP BY ALL) x USING (upc, channel_outlet, retail_account) GROUP BY ALL
)
--
SELECT s.*, CASE WHEN fv <= 5 * vel_52w_max THEN fv END AS fct_vel_avg
FROM s LEFT JOIN f USING (upc, channel_outlet, retail_account) WHERE weeks_13 > 0
""")
def _(t):
    vel = pa.forecast_velocity(flat_forecast(t), t.filtered)
    return ag.velocity_summary(t.filtered, vel)


@query("D19_retailer_summary", f"""
WITH ev AS ({EV_SQL['I16_ev_norm_gap']})
--
SELECT retail_account, dollars_13w, dollars_ytd, active_skus, coalesce(n_events, 0) AS n_events,
  coalesce(skus_with_issues, 0) AS skus_with_issues
FROM (
  SELECT retail_account,
    sum(CASE WHEN week > DATE '2001-06-25' - 91 THEN dollars ELSE 0 END) AS dollars_13w,
    sum(CASE WHEN year(week) = 2001 THEN dollars ELSE 0 END) AS dollars_ytd,
    count(DISTINCT upc) FILTER (WHERE week > DATE '2001-06-25' - 91) AS active_skus
  FROM c_filtered WHERE source_brand LIKE 'OWN%' AND week <= DATE '2001-06-25' GROUP BY 1
) s LEFT JOIN (SELECT retail_account, count(*) AS n_events, count(DISTINCT focal_upc)
  AS skus_with_issues FROM ev GROUP BY 1) e USING (retail_account)
""")
def _(t):
    return ag.retailer_summary(t.filtered, detectors(t)["I16_ev_norm_gap"](), t.cfg,
                               dt.date(2001, 6, 25))


@query("D19_sku_summary", RULE_SCORED_SQL + """
SELECT upc, retail_account, channel_outlet, dollars_13w, velocity_13w, max_transfer_prob, donor_pairs
FROM (
  SELECT upc, retail_account, channel_outlet,
    sum(CASE WHEN week > DATE '2001-06-25' - 91 THEN dollars ELSE 0 END) AS dollars_13w,
    avg(avg_weekly_units_spm) FILTER (WHERE week > DATE '2001-06-25' - 91) AS velocity_13w
  FROM c_filtered WHERE upc = 'SKU-03' AND week <= DATE '2001-06-25' GROUP BY ALL
) s LEFT JOIN (SELECT focal_upc AS upc, retail_account, channel_outlet,
    max(transfer_prob) AS max_transfer_prob, count(*) AS donor_pairs FROM scored GROUP BY ALL) x
  USING (upc, retail_account, channel_outlet)
""")
def _(t):
    return ag.sku_summary(t.filtered, tp.rule_scored(t), "SKU-03", dt.date(2001, 6, 25))


_FAM = f"{MW}, parent_brand, flavor, specific_flavor_normalized"


@query("E17_pack_family", f"""
WITH g AS (
  SELECT *, max(pack_count) OVER (PARTITION BY {_FAM} ORDER BY pack_count
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
    min(pack_count) OVER (PARTITION BY {_FAM} ORDER BY pack_count
      RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi,
    count(*) OVER (PARTITION BY {_FAM}) - count(*) OVER (PARTITION BY {_FAM}, pack_count) AS alt,
    dense_rank() OVER (PARTITION BY {_FAM} ORDER BY pack_count) AS rk,
    units / nullif(sum(units) OVER (PARTITION BY {_FAM}), 0) AS sh
  FROM c_enriched
), n AS (
  SELECT *, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR pack_count - lo <= hi - pack_count)
    THEN lo ELSE hi END AS near,
    CASE WHEN lo IS NOT NULL AND (hi IS NULL OR pack_count - lo <= hi - pack_count) THEN 1 ELSE 0
    END AS dn FROM g
)
--
SELECT n.week, n.upc, n.channel_outlet, n.retail_account, n.geography_raw, n.pack_count,
  rk AS pack_rank_within_brand, alt AS alt_pack_count, CASE WHEN alt > 0 THEN 1 ELSE 0 END
    AS same_flavor_diff_pack_flag, abs(n.pack_count - near) AS pack_gap_to_nearest,
  n.arp - a.arp AS price_gap_to_alt_pack, n.arp / n.pack_count - a.arp / near AS price_per_count_gap,
  sh AS share_of_pack_architecture
FROM n LEFT JOIN LATERAL (SELECT m.arp FROM c_enriched m WHERE m.week = n.week
    AND m.channel_outlet = n.channel_outlet AND m.retail_account = n.retail_account
    AND m.geography_raw = n.geography_raw AND m.parent_brand = n.parent_brand
    AND m.flavor = n.flavor AND m.specific_flavor_normalized = n.specific_flavor_normalized
    AND m.pack_count = n.near
  ORDER BY CASE WHEN n.dn = 1 THEN m.upc END DESC, m.upc LIMIT 1) a ON TRUE
""")
def _(t):
    return ag.pack_family_features(t.enriched).drop(
        "alt_pack_distribution_pressure", "alt_pack_promo_pressure")


@query("E18_sibling_pressure", f"""
SELECT week, {SERIES}, sum(tdp) OVER (PARTITION BY {_FAM}) - sum(tdp) OVER
    (PARTITION BY {_FAM}, pack_count) AS alt_pack_distribution_pressure,
  sum(units_pct_promo) OVER (PARTITION BY {_FAM}) - sum(units_pct_promo) OVER
    (PARTITION BY {_FAM}, pack_count) AS alt_pack_promo_pressure
FROM c_enriched
""")
def _(t):
    return ag.pack_family_features(t.enriched).select(
        "week", *SERIES_KEYS, "alt_pack_distribution_pressure", "alt_pack_promo_pressure")


@query("B12_pack_behaviour", """
SELECT pack_count, avg(tdp) AS tdp_by_pack_count, avg(avg_acv) AS acv_by_pack_count,
  sum(units_promo) / sum(units) AS promo_share_by_pack_count,
  avg(arp_pct_discount_any_promo) AS promo_discount_by_pack_count,
  sum(base_units) / sum(units) AS base_vs_promo_mix, median(tdp) AS median_tdp_by_pack_count
FROM c_enriched GROUP BY 1
""")
def _(t):
    return ag.pack_behaviour(t.enriched)


# ---------------------------------------------------------------- F, C15, C16


@query("F1_top_series", f"""
SELECT {SERIES}, sum(base_units) AS total FROM c_filtered GROUP BY ALL
ORDER BY total DESC, upc, channel_outlet, retail_account, geography_raw LIMIT 20
""")
def _(t):
    return ra.top_series(t.filtered, 20)


@query("F2_dominant_channel", """
SELECT upc, retail_account, channel_outlet, total FROM (
  SELECT *, row_number() OVER (PARTITION BY upc, retail_account ORDER BY total DESC, channel_outlet)
    AS rn FROM (SELECT upc, retail_account, channel_outlet, sum(base_units) AS total
    FROM c_filtered GROUP BY ALL) a) b
WHERE rn = 1 ORDER BY total DESC, upc, retail_account LIMIT 15
""")
def _(t):
    return ra.dominant_channel(t.filtered, 15)


@query("F4_actual_plus_forecast", f"""
SELECT week, {SERIES}, base_units AS units, 'ACTUAL' AS series_type FROM c_own
WHERE week <= (SELECT max(week) FROM c_own) - 91
UNION ALL SELECT week, {SERIES}, forecast_units_base, 'FORECAST' FROM c_flat
""")
def _(t):
    a = known_weeks(t).select(
        "week", *SERIES_KEYS, F.col("base_units").alias("units"), F.lit("ACTUAL").alias("series_type"))
    return a.unionByName(flat_forecast(t).select(
        "week", *SERIES_KEYS, F.col("forecast_units_base").alias("units"),
        F.lit("FORECAST").alias("series_type")))


@query("F8_top_rates", RATE_SQL + f"""
SELECT focal_upc, {MARKET}, avg(cannibalization_rate) AS avg_rate, count(*) AS weeks FROM rate
GROUP BY ALL ORDER BY avg_rate DESC, focal_upc, {MARKET} LIMIT 10
""")
def _(t):
    return ra.top_rates(rate_weekly(tp.rule_scored(t), w.event_detection(t.enriched)))


@query("C15_qualify_series", f"""
SELECT week, {SERIES}, base_units FROM (SELECT *, count(*) FILTER (WHERE week < DATE '2000-01-03')
    OVER (PARTITION BY {SERIES}) AS tr, count(*) FILTER (WHERE week >= DATE '2000-01-03')
    OVER (PARTITION BY {SERIES}) AS te FROM c_filtered) q WHERE tr >= 100 AND te >= 50
""")
def _(t):
    return ra.qualify_series(t.filtered, dt.date(2000, 1, 3), 100, 50).select(
        "week", *SERIES_KEYS, "base_units")


@query("C16_asof_last", f"""
SELECT {SERIES}, max(week) AS last_week, arg_max(tdp, week) AS tdp, arg_max(arp, week) AS arp,
  arg_max(base_units_yago, week) FILTER (WHERE base_units_yago IS NOT NULL) AS base_units_yago
FROM c_filtered WHERE week <= DATE '1999-06-28' GROUP BY ALL
""")
def _(t):
    return ra.asof_last(t.filtered, dt.date(1999, 6, 28), ["tdp", "arp", "base_units_yago"])


@query("C16_asof_join", f"""
SELECT l.week, l.upc, l.channel_outlet, l.retail_account, l.geography_raw, r.arp AS asof_arp
FROM c_own l ASOF LEFT JOIN (SELECT * FROM c_own WHERE month(week) = 1) r
  ON l.upc = r.upc AND l.channel_outlet = r.channel_outlet AND l.retail_account = r.retail_account
  AND l.geography_raw = r.geography_raw AND l.week >= r.week
""")
def _(t):
    o = own(t)
    return ra.asof_join(o, o.where(F.month("week") == 1), "arp").select(
        "week", *SERIES_KEYS, "asof_arp")


# ---------------------------------------------------------------- J


def _gappy(t):
    """Own rows whose price is missing in every fifth ISO week."""
    price = F.when(F.weekofyear("week") % 5 != 0, F.col("arp"))
    return own(t).withColumn("arp", price).join(
        tp.prepost(t).select(*SERIES_KEYS, F.col("post_13w_arp").alias("launch_arp")),
        SERIES_KEYS, "left")


@query("J2_price_cascade", f"""
WITH g AS (
  SELECT o.week, o.upc, o.channel_outlet, o.retail_account, o.geography_raw,
    CASE WHEN weekofyear(o.week) % 5 <> 0 THEN o.arp END AS a, p.post_13w_arp AS la
  FROM c_own o LEFT JOIN c_prepost p USING ({SERIES})
), x AS (
  SELECT *, CASE WHEN count(a) OVER p >= 4 THEN avg(a) OVER p END AS r FROM g
  WINDOW p AS (PARTITION BY {SERIES} ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)
)
--
SELECT week, {SERIES}, coalesce(a, r, la) AS arp,
  CASE WHEN a IS NULL AND coalesce(r, la) IS NOT NULL THEN 1 ELSE 0 END AS arp_fallback,
  CASE WHEN a IS NOT NULL THEN 'live' WHEN r IS NOT NULL THEN 'roll13' WHEN la IS NOT NULL
    THEN 'prepost' ELSE 'live' END AS arp_source FROM x
""")
def _(t):
    return pa.price_cascade(_gappy(t)).select("week", *SERIES_KEYS, "arp", "arp_fallback", "arp_source")


@query("J4_calendar", """
WITH c AS (SELECT DISTINCT week, weekofyear(week) AS woy FROM c_filtered)
--
SELECT week, woy AS week_of_year, CASE WHEN woy IN (1, 2) THEN 1 WHEN woy = 5 THEN 2 WHEN woy = 21
    THEN 3 WHEN woy = 36 THEN 4 WHEN woy = 47 THEN 5 WHEN woy = 52 THEN 6 ELSE 0 END AS holiday_week,
  CASE WHEN woy IN (1, 2) THEN 1 ELSE 0 END AS is_new_year_week,
  CASE WHEN woy = 47 THEN 1 ELSE 0 END AS is_thanksgiving_week,
  sin(2 * pi() * woy / 52.178) AS week_sin, cos(2 * pi() * woy / 52.178) AS week_cos FROM c
""")
def _(t):
    return pa.calendar_features(t.filtered.select("week").distinct()).select(
        "week", "week_of_year", "holiday_week", "is_new_year_week", "is_thanksgiving_week",
        "week_sin", "week_cos")


@query("J5_price_change_bin", f"""
WITH b AS (SELECT *, CASE WHEN delta IS NULL THEN 0
    ELSE least(0.5, greatest(-0.5, delta / greatest(l1, 0.01))) END AS pc FROM c_promo_panel)
--
SELECT week, {SERIES}, delta AS arp_wow_delta, pc AS arp_pct_change, r8 AS arp_roll8_avg,
  CASE WHEN delta IS NULL OR abs(pc) < 0.02 THEN 0 WHEN delta > 0.05 THEN -1
    WHEN -delta <= 0.05 THEN 0 WHEN -delta <= 0.25 THEN 1 ELSE 2 END AS price_change_bin,
  least(1.5, greatest(-1.5, pc * -1.2)) AS price_elasticity_effect FROM b
""")
def _(t):
    p = own(t).withColumn("implied_elasticity", F.lit(-1.2))
    return pa.price_change_bin(p).select(
        "week", *SERIES_KEYS, "arp_wow_delta", "arp_pct_change", "arp_roll8_avg",
        "price_change_bin", "price_elasticity_effect")


@query("J6_promo_signals", f"""
WITH s AS (
  SELECT *, least(1, units_promo / greatest(units, 1)) AS pi_, coalesce(dd0, 0) AS dd FROM
    c_promo_panel
), f AS (
  SELECT *, pi_ > 0.10 AS bu, units_promo = 0 AND (r8 IS NOT NULL AND dd > 0.05) AS bp FROM s
)
--
SELECT week, {SERIES}, pi_ AS promo_intensity,
  coalesce(least(1, greatest(0, (r8 - arp) / greatest(r8, 0.01))), 0) AS arp_discount_pct,
  CASE WHEN r8 IS NULL THEN 0 ELSE dd END AS arp_dollar_discount,
  least(5, incr_units / greatest(base_units, 1)) AS promo_lift_ratio,
  CASE WHEN bu OR bp THEN 1 ELSE 0 END AS is_promo_week,
  CASE WHEN bu THEN 'units_promo' WHEN bp THEN 'arp_inferred' ELSE 'none' END AS promo_source FROM f
""")
def _(t):
    p = own(t).withColumn("total_units", F.col("units")).withColumn(
        "arp_roll8_avg", w.rolling_prior("arp", 8, 2))
    return pa.promo_signals(p).select(
        "week", *SERIES_KEYS, "promo_intensity", "arp_discount_pct", "arp_dollar_discount",
        "promo_lift_ratio", "is_promo_week", "promo_source")


def panel(t):
    scored = written(tp.rule_scored(t))
    events = w.event_detection(t.enriched)
    elas = rule_elasticity(t).groupBy(*SERIES_KEYS).agg(
        F.max_by("implied_elasticity", "week").alias("implied_elasticity"))
    return pa.forecast_panel(events, tp.prepost(t), scored, rate_weekly(scored, events), elas,
                             t.filtered, t.cfg)


PANEL_SQL = _DONOR_SQL.replace("\n--\n", f""", don AS (
  SELECT focal_upc AS upc, {MARKET}, max(transfer_prob) AS mp, count(*) AS dc FROM scored GROUP BY ALL
), pan AS (
  SELECT e.week, e.upc, e.channel_outlet, e.retail_account, e.geography_raw, e.base_units,
    e.units AS total_units, e.arp, coalesce(don.mp, 0) AS max_donor_prob,
    coalesce(don.dc, 0) AS donor_count, sig.top_donor_units_sum,
    e.arp - sig.competitor_donor_arp_wavg AS competitor_price_gap,
    count(*) OVER (PARTITION BY {SERIES}) AS n,
    lag(e.base_units) OVER w AS base_units_lag1, lag(e.base_units, 13) OVER w AS base_units_lag13,
    e.tdp - lag(e.tdp, 4) OVER w AS tdp_4w_momentum,
    lag(e.base_units_roll8_avg) OVER w AS prev_base_units_roll8_avg
  FROM (SELECT * FROM c_events WHERE parent_brand = 'OWN') e
  LEFT JOIN don USING ({SERIES}) LEFT JOIN sig USING (week, {SERIES})
  WINDOW w AS (PARTITION BY {SERIES} ORDER BY week)
)
--
""")
_PANEL_COLS = ["base_units", "total_units", "arp", "max_donor_prob", "donor_count",
               "top_donor_units_sum", "competitor_price_gap", "base_units_lag1", "base_units_lag13",
               "tdp_4w_momentum", "prev_base_units_roll8_avg"]


@query("J1_forecast_panel", PANEL_SQL + f"""
SELECT week, {SERIES}, {', '.join(_PANEL_COLS)} FROM pan WHERE n >= 13 AND base_units_lag1 IS NOT NULL
""")
def _(t):
    return panel(t).select("week", *SERIES_KEYS, *_PANEL_COLS)


@query("C12_panel_fan_in", PANEL_SQL + f"""
SELECT {SERIES}, count(*) AS n_weeks, count(top_donor_units_sum) AS donor_weeks,
  max(max_donor_prob) AS max_donor_prob
FROM pan WHERE n >= 13 AND base_units_lag1 IS NOT NULL GROUP BY ALL
""")
def _(t):
    return panel(t).groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n_weeks"), F.count("top_donor_units_sum").alias("donor_weeks"),
        F.max("max_donor_prob").alias("max_donor_prob"))


@query("J3_donor_signal_changes", _DONOR_SQL + f"""
SELECT o.week, o.upc, o.channel_outlet, o.retail_account, o.geography_raw,
  o.arp - competitor_donor_arp_wavg AS competitor_price_gap,
  top_donor_units_sum - lag(top_donor_units_sum) OVER w AS top_donor_units_wow
FROM c_own o LEFT JOIN sig USING (week, {SERIES})
WINDOW w AS (PARTITION BY o.upc, o.channel_outlet, o.retail_account, o.geography_raw ORDER BY o.week)
""")
def _(t):
    sig = ag.donor_signals(rank_donors(tp.rule_scored(t), top=3), t.filtered, t.cfg)
    j = own(t).join(sig, ["week", *SERIES_KEYS], "left")
    return j.select(
        "week", *SERIES_KEYS,
        (F.col("arp") - F.col("competitor_donor_arp_wavg")).alias("competitor_price_gap"),
        (F.col("top_donor_units_sum") - F.lag("top_donor_units_sum").over(w.series())).alias(
            "top_donor_units_wow"))


@query("J7_rolling_signals", _DONOR_SQL.replace("\n--\n", f""", d AS (
  SELECT o.*, top_donor_units_sum AS ds, coalesce(top_donor_units_sum, 0) AS dz
  FROM c_own o LEFT JOIN sig USING (week, {SERIES})
), r AS (
  SELECT week, {SERIES}, ds, CASE WHEN count(base_units) OVER w8 >= 5
      AND stddev_samp(base_units) OVER w8 > 0 AND stddev_samp(dz) OVER w8 > 0
    THEN -corr(base_units, dz) OVER w8 END AS p8
  FROM d WINDOW w8 AS (PARTITION BY {SERIES} ORDER BY week ROWS 7 PRECEDING)
)
--
""") + f"SELECT week, {SERIES}, CASE WHEN ds IS NOT NULL THEN p8 END AS rolling_cannibal_pressure FROM r")
def _(t):
    sig = ag.donor_signals(rank_donors(tp.rule_scored(t), top=3), t.filtered, t.cfg)
    j = own(t).join(sig, ["week", *SERIES_KEYS], "left")
    return pa.rolling_signals(j).select("week", *SERIES_KEYS, "rolling_cannibal_pressure")


@query("J13_baselines", f"""
SELECT {SERIES}, max(base_units) FILTER (WHERE rb = 1) AS last_value,
  avg(base_units) FILTER (WHERE rb <= 4) AS ma4, avg(base_units) FILTER (WHERE rb <= 13) AS ma13,
  max(base_units) FILTER (WHERE rb = 52) AS seasonal_naive
FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb FROM c_filtered) q
GROUP BY ALL
""")
def _(t):
    return fo.baselines(t.filtered)


@query("J14_holt_forecast")
def _(t):
    return fo.holt_forecast(own(t))


def _recursion(t):
    p = own(t).withColumn("weeks_since_launch", weeks_between("week", "first_week_selling"))
    return fo.recursive_forecast(p, fo.lag_rule({1: 0.5, 4: 0.3, 13: 0.2}))


@query("J11_recursive_rule", f"""
WITH RECURSIVE h AS (
  SELECT {SERIES}, list(base_units ORDER BY week) AS hist, max(week) AS anchor_week
  FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb FROM c_own) q
  WHERE rb <= 65 GROUP BY ALL
), b AS (
  SELECT *, len(hist) AS n0, CASE WHEN len(hist) >= 52 AND hist[-52] > 0
    THEN least(2.0, greatest(0.5, hist[-1] / hist[-52])) END AS yoy FROM h
), r AS (
  SELECT {SERIES}, anchor_week, n0, yoy, hist, 0 AS step, CAST(NULL AS DOUBLE) AS f FROM b
  UNION ALL
  SELECT {SERIES}, anchor_week, n0, yoy, list_append(hist, v), step + 1, v FROM (
    SELECT *, greatest(0, CASE WHEN yoy IS NOT NULL AND ly > 0 AND base > 0
      THEN 0.6 * base + 0.4 * ly * yoy ELSE base END) AS v
    FROM (
      SELECT *, CASE WHEN n0 >= 52 - step THEN hist[n0 - 51 + step] END AS ly,
        (0.5 * hist[-1] + CASE WHEN len(hist) >= 4 THEN 0.3 * hist[-4] ELSE 0 END
          + CASE WHEN len(hist) >= 13 THEN 0.2 * hist[-13] ELSE 0 END)
        / (0.5 + CASE WHEN len(hist) >= 4 THEN 0.3 ELSE 0 END
          + CASE WHEN len(hist) >= 13 THEN 0.2 ELSE 0 END) AS base
      FROM r WHERE step < 13) x) y
)
--
SELECT {SERIES}, anchor_week + CAST(7 * step AS INTEGER) AS week, step AS forecast_week_number,
  f AS forecast_units_base FROM r WHERE step > 0
""")
def _(t):
    return _recursion(t).select(*SERIES_KEYS, "week", "forecast_week_number", "forecast_units_base")


@query("J11_coherent_totals")
def _(t):
    p = own(t).withColumn("weeks_since_launch", weeks_between("week", "first_week_selling"))
    rule = fo.lag_rule({1: 0.5, 4: 0.3, 13: 0.2})
    return fo.coherent_total(fo.recursive_forecast(p, rule), fo.recursive_forecast(p, rule, target="units"))


@query("J15_forecast_ladder")
def _(t):
    model = fo.with_history(_recursion(t), own(t))
    holt = fo.holt_forecast(own(t), min_rows=40)
    return fo.forecast_ladder(model, holt, fo.baselines(own(t)))


#: Launches of the fixture lie in its first half, so all that are younger than this still take from siblings.
LAUNCH_WEEKS = 208

CONSTRAINT_SQL = f"""
WITH claims AS (
  SELECT DISTINCT focal_upc, donor_upc, {MARKET}, 0.9 / relationship_distance AS p
  FROM (SELECT focal_upc, candidate_upc AS donor_upc, {MARKET},
      min(relationship_distance) AS relationship_distance FROM c_launch_pairs
    WHERE candidate_upc IN (SELECT upc FROM c_own) GROUP BY ALL) q
  WHERE 0.9 / relationship_distance >= 0.30
), j AS (
  SELECT c.*, f.forecast_week_number AS k, f.forecast_units_base AS fu, d.forecast_units_base AS du,
    c.p * d.forecast_units_base * greatest(0, 1 - f.weeks_since_launch / {LAUNCH_WEEKS}) AS raw
  FROM claims c JOIN c_flat f ON f.upc = c.focal_upc AND f.channel_outlet = c.channel_outlet
    AND f.retail_account = c.retail_account AND f.geography_raw = c.geography_raw
  JOIN c_flat d ON d.upc = c.donor_upc AND d.channel_outlet = c.channel_outlet
    AND d.retail_account = c.retail_account AND d.geography_raw = c.geography_raw
    AND d.forecast_week_number = f.forecast_week_number
  WHERE f.weeks_since_launch <= {LAUNCH_WEEKS} AND f.forecast_units_base >= 10 AND d.forecast_units_base > 0
), g AS (
  SELECT *, least(raw, greatest(0, 0.2 * du - coalesce(sum(raw) OVER (PARTITION BY donor_upc,
    {MARKET}, k ORDER BY p DESC, focal_upc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
    AS given FROM j
), x AS (
  SELECT *, least(given, greatest(0, 0.5 * fu - coalesce(sum(given) OVER (PARTITION BY focal_upc,
    {MARKET}, k ORDER BY p DESC, donor_upc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
    AS moved FROM g
), net AS (
  SELECT upc, {MARKET}, k AS forecast_week_number, sum(d) AS delta, CASE WHEN min(ty) = max(ty)
    THEN min(ty) ELSE 'BOTH' END AS ty FROM (
    SELECT focal_upc AS upc, {MARKET}, k, moved AS d, 'FOCAL_LAUNCH' AS ty FROM x WHERE moved > 1e-6
    UNION ALL SELECT donor_upc, {MARKET}, k, -moved, 'DONOR' FROM x WHERE moved > 1e-6) u
  GROUP BY ALL
), adj AS (
  SELECT f.*, coalesce(delta, 0) AS delta, coalesce(ty, 'NONE') AS ty
  FROM c_flat f LEFT JOIN net USING ({SERIES}, forecast_week_number)
)
--
"""


def _sibling_claims(t):
    from shelfwise.operators.pool import launch_pairs

    own_upcs = own(t).select(F.col("upc").alias("donor_upc")).distinct()
    return launch_pairs(tp.pool(t)).withColumnRenamed("candidate_upc", "donor_upc").join(
        own_upcs, "donor_upc", "left_semi"
    ).groupBy("focal_upc", "donor_upc", *MARKET_KEYS).agg(
        (0.9 / F.min("relationship_distance")).alias("transfer_prob"))


def _adjusted(t):
    return fo.portfolio_constraint(flat_forecast(t), _sibling_claims(t), launch_window=LAUNCH_WEEKS)


@query("J17_portfolio_constraint", CONSTRAINT_SQL + f"""
SELECT {SERIES}, forecast_week_number, forecast_units_base AS forecast_units_raw,
  forecast_units_base + delta AS forecast_units_base, delta AS portfolio_adj_delta,
  ty AS portfolio_adj_type FROM adj
""")
def _(t):
    return _adjusted(t).select(
        *SERIES_KEYS, "forecast_week_number", "forecast_units_raw", "forecast_units_base",
        "portfolio_adj_delta", "portfolio_adj_type")


@query("D21_portfolio_summary", CONSTRAINT_SQL + f"""
SELECT {SERIES}, sum(forecast_units_base) AS raw_13w_units,
  sum(forecast_units_base + delta) AS adj_13w_units, sum(delta) AS total_adj_delta,
  min(weeks_since_launch) AS wsl_anchor,
  coalesce(max(ty) FILTER (WHERE ty <> 'NONE'), 'NONE') AS portfolio_adj_type,
  100 * sum(delta) / greatest(sum(forecast_units_base), 0.01) AS adj_pct FROM adj GROUP BY ALL
""")
def _(t):
    return fo.portfolio_summary(_adjusted(t))


@query("J18_tdp_velocity", f"""
WITH r AS (
  SELECT *, greatest(tdp, 0.1) AS t, base_units / greatest(tdp, 0.1) AS v,
    row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb,
    count(*) OVER (PARTITION BY {SERIES}) AS n FROM c_filtered
), q AS (
  SELECT *, rb <= least(13, n // 2) AS nw, CASE WHEN n >= 65 THEN rb BETWEEN 53 AND 65
    ELSE rb > n - least(13, n // 2) END AS ag FROM r WHERE n >= 26
), s AS (
  SELECT {SERIES}, avg(t) FILTER (WHERE nw) AS t1, avg(v) FILTER (WHERE nw) AS v1,
    avg(base_units) FILTER (WHERE nw) AS u1, avg(t) FILTER (WHERE ag) AS t0,
    avg(v) FILTER (WHERE ag) AS v0, avg(base_units) FILTER (WHERE ag) AS u0
  FROM q GROUP BY ALL HAVING count(*) FILTER (WHERE ag) >= 4
), d AS (
  SELECT *, u1 - u0 AS du, (t1 - t0) * (v1 + v0) / 2 AS ct, (v1 - v0) * (t1 + t0) / 2 AS cv FROM s
), p AS (
  SELECT *, coalesce(100 * ct / nullif(abs(ct) + abs(cv), 0), 0) AS pt,
    coalesce(100 * cv / nullif(abs(ct) + abs(cv), 0), 0) AS pv FROM d
)
--
SELECT {SERIES}, du AS hist_delta_units, ct AS hist_tdp_contrib, cv AS hist_vel_contrib,
  pt AS hist_tdp_contrib_pct, pv AS hist_vel_contrib_pct,
  CASE WHEN abs(du) <= 5 THEN 'STABLE'
    WHEN du > 0 AND abs(pt) >= 60 THEN 'TDP_EXPANSION' WHEN du > 0 AND abs(pv) >= 60
    THEN 'VELOCITY_GROWTH' WHEN du > 0 THEN 'MIXED_GROWTH' WHEN abs(pt) >= 60
    THEN 'DISTRIBUTION_LOSS' WHEN abs(pv) >= 60 THEN 'VELOCITY_EROSION' ELSE 'MIXED_DECLINE' END
    AS growth_driver, t1 AS hist_tdp_last13w_avg, v1 AS hist_vel_last13w_avg FROM p
""")
def _(t):
    return fo.tdp_velocity(t.filtered).select(
        *SERIES_KEYS, "hist_delta_units", "hist_tdp_contrib", "hist_vel_contrib",
        "hist_tdp_contrib_pct", "hist_vel_contrib_pct", "growth_driver", "hist_tdp_last13w_avg",
        "hist_vel_last13w_avg")


@query("J18_tdp_velocity_forward")
def _(t):
    return fo.tdp_velocity(own(t), flat_forecast(t))


@query("J19_monthly_index", f"""
WITH e AS (SELECT {SERIES}, month(week) AS month, avg(base_units) AS m FROM c_filtered
  WHERE ({SERIES}) IN (SELECT ({SERIES}) FROM c_filtered GROUP BY ALL HAVING count(*) >= 26)
  GROUP BY ALL),
l AS (SELECT {SERIES}, avg(m) AS lv FROM e GROUP BY ALL HAVING avg(m) > 0),
d AS (SELECT month, avg(m / lv - 1) AS d FROM e JOIN l USING ({SERIES}) GROUP BY 1)
--
SELECT month, d - (SELECT avg(d) FROM d) AS seasonal_index, 1 + d - (SELECT avg(d) FROM d)
  AS demand_index FROM d
""")
def _(t):
    return fo.monthly_index(t.filtered)


@query("J19_seasonal_index", """
WITH tt AS (SELECT channel_outlet, week, sum(base_units) AS u FROM c_filtered GROUP BY ALL),
r AS (SELECT week, u, avg(u) OVER a AS ma, count(u) OVER a AS n FROM tt WINDOW a AS
  (PARTITION BY channel_outlet ORDER BY week ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)),
m AS (SELECT weekofyear(week) AS week_of_year, median(u / ma - 1) AS i FROM r WHERE n >= 26 GROUP BY 1)
--
SELECT week_of_year, i - (SELECT avg(i) FROM m) AS seasonal_index FROM m
""")
def _(t):
    return fo.seasonal_index(t.filtered)


@query("J20_weekly_spine", f"""
WITH sp AS (
  SELECT {SERIES}, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week
  FROM (SELECT {SERIES}, min(week) AS a, max(week) AS b FROM c_filtered GROUP BY ALL) q
)
--
SELECT week, {SERIES}, last_value(base_units IGNORE NULLS) OVER w AS base_units,
  last_value(tdp IGNORE NULLS) OVER w AS tdp, base_units IS NULL AS is_filled
FROM sp LEFT JOIN c_filtered USING (week, {SERIES})
WINDOW w AS (PARTITION BY {SERIES} ORDER BY week ROWS UNBOUNDED PRECEDING)
""")
def _(t):
    return fo.weekly_spine(t.filtered, ["base_units", "tdp"])


@query("J21_change_points", f"""
WITH s AS (
  SELECT week, {SERIES}, CASE WHEN count(*) OVER b = 8 AND count(*) OVER a = 8 AND
      sqrt(var_samp(base_units) OVER b / 8 + var_samp(base_units) OVER a / 8) > 0
    THEN (avg(base_units) OVER a - avg(base_units) OVER b)
      / sqrt(var_samp(base_units) OVER b / 8 + var_samp(base_units) OVER a / 8) END AS shift_t
  FROM c_filtered WINDOW b AS (PARTITION BY {SERIES} ORDER BY week
    ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY {SERIES} ORDER BY week
    ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), m AS (
  SELECT *, max(abs(shift_t)) OVER (PARTITION BY {SERIES} ORDER BY week
    ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top FROM s
)
--
SELECT week, {SERIES}, shift_t FROM m WHERE abs(shift_t) >= 3 AND abs(shift_t) = top
""")
def _(t):
    return fo.change_points(t.filtered)


@query("J21_segments", f"""
WITH RECURSIVE q1 AS (
  SELECT {SERIES}, week, CAST(base_units AS DOUBLE) AS v, row_number() OVER p AS i, count(*) OVER a AS n,
    CAST(base_units AS DOUBLE) - avg(CAST(base_units AS DOUBLE)) OVER a AS x,
    CAST(base_units AS DOUBLE) - lag(CAST(base_units AS DOUBLE)) OVER p AS d
  FROM c_filtered WHERE base_units IS NOT NULL
  WINDOW p AS (PARTITION BY {SERIES} ORDER BY week), a AS (PARTITION BY {SERIES})
), q2 AS (
  SELECT *, sum(x) OVER p AS one, sum(x * x) OVER p AS two FROM q1
  WINDOW p AS (PARTITION BY {SERIES} ORDER BY week ROWS UNBOUNDED PRECEDING)
), q3 AS (
  SELECT {SERIES}, max(n) AS n, [CAST(0 AS DOUBLE)] || list(one ORDER BY i) AS one,
    [CAST(0 AS DOUBLE)] || list(two ORDER BY i) AS two, 3 * pow(coalesce(
      nullif(median(abs(d)) / 0.6744897501960817, 0), stddev_pop(d), 0) / sqrt(2), 2) * ln(greatest(max(n), 2)) + 1e-9 AS pen
  FROM q2 GROUP BY ALL
), dp AS (
  SELECT {SERIES}, n, one, two, pen, CAST(0 AS BIGINT) AS t, [-pen] AS least, [CAST(0 AS BIGINT)] AS origin FROM q3
  UNION ALL
  SELECT {SERIES}, n, one, two, pen, t, list_append(least, coalesce(list_min(costs) + pen, CAST('inf' AS DOUBLE))),
    list_append(origin, coalesce(list_position(costs, list_min(costs)) - 1, 0)) FROM (
    SELECT {SERIES}, n, one, two, pen, t + 1 AS t, least, origin, list_transform(range(0, t + 2 - 8),
      lambda s: least[s + 1] + greatest(two[t + 2] - two[s + 1] - pow(one[t + 2] - one[s + 1], 2) / (t + 1 - s), 0)) AS costs
    FROM dp WHERE t < n) g
), bt AS (
  SELECT {SERIES}, n, origin, n AS stop, CASE WHEN n < 16 THEN 0 ELSE origin[n + 1] END AS start FROM dp WHERE t = n
  UNION ALL
  SELECT {SERIES}, n, origin, start, origin[start + 1] FROM bt WHERE start > 0
), sg AS (
  SELECT {SERIES}, start, min(week) AS first_week, max(week) AS last_week, count(*) AS n_rows, avg(v) AS level
  FROM bt JOIN q1 USING ({SERIES}) WHERE i > start AND i <= stop GROUP BY ALL
)
--
SELECT {SERIES}, row_number() OVER p AS segment, first_week, last_week, n_rows, level, level - lag(level) OVER p AS shift
FROM sg WINDOW p AS (PARTITION BY {SERIES} ORDER BY start)
""")
def _(t):
    return sg.change_segments(t.filtered)


@query("J22_scenario_totals", f"""
SELECT {SERIES}, sum(forecast_units_low) AS p10_units_total, sum(forecast_units_base)
    AS p50_units_total, sum(forecast_units_high) AS p90_units_total,
  100 * avg((forecast_units_high - forecast_units_low) / greatest(forecast_units_base, 1))
    AS interval_width_pct,
  avg(CASE WHEN o.base_units IS NULL THEN NULL WHEN o.base_units BETWEEN forecast_units_low
    AND forecast_units_high THEN 1.0 ELSE 0.0 END) AS coverage_rate,
  sum(forecast_units_low) * avg(f.arp) AS p10_rev_total,
  sum(forecast_units_base) * avg(f.arp) AS p50_rev_total,
  sum(forecast_units_high) * avg(f.arp) AS p90_rev_total
FROM c_flat f LEFT JOIN (SELECT week, {SERIES}, base_units FROM c_own) o USING (week, {SERIES})
GROUP BY ALL
""")
def _(t):
    return fo.scenario_totals(flat_forecast(t), own(t))


SCEN_SQL = f"""
WITH tot AS (SELECT {SERIES}, sum(forecast_units_low) AS low, sum(forecast_units_base) AS mid,
  sum(forecast_units_high) AS high FROM c_flat GROUP BY ALL),
sc AS (
  SELECT scenario_id, {SERIES}, st AS scenario_tdp_change, sp AS scenario_price_change,
    sd AS scenario_promo_depth, low, mid, high, (1 + st) * (1 - sp) * (1 + 1.5 * sd) AS x, 0.3 AS r
  FROM tot, (VALUES ('expand_reach', 0.10, 0.0, 0.0), ('price_cut', 0.0, -0.05, 0.0),
    ('promo', 0.0, 0.0, 0.15), ('hold', 0.0, 0.0, 0.0)) v(scenario_id, st, sp, sd)
), rec AS (
  SELECT scenario_id, {SERIES}, scenario_tdp_change, scenario_price_change, scenario_promo_depth,
    {', '.join(f"{q} * x AS forecast_focal_units_{q}, greatest(0, {q} * (x - 1)) * r AS forecast_donor_units_loss_{q}, {q} * (x - 1) - greatest(0, {q} * (x - 1)) * r AS forecast_net_incremental_units_{q}" for q in ('low', 'mid', 'high'))},
    1 - r AS forecast_incremental_share FROM sc
)
--
"""


def _scenarios(t):
    rates = own(t).select(*SERIES_KEYS).distinct().withColumn("cannibalization_rate", F.lit(0.3))
    return fo.scenario_records(flat_forecast(t), rates)


@query("J23_scenario_records", SCEN_SQL + "SELECT * FROM rec")
def _(t):
    return _scenarios(t)


@query("J24_rank_markets", SCEN_SQL + f"""
SELECT scenario_id, {SERIES}, forecast_net_incremental_units_mid AS net_units,
  row_number() OVER (PARTITION BY scenario_id, upc ORDER BY
    forecast_net_incremental_units_mid DESC, {MARKET}) AS market_rank,
  CASE WHEN forecast_net_incremental_units_mid > 0 THEN 'EXPAND'
    WHEN forecast_net_incremental_units_mid < 0 THEN 'HOLD' ELSE 'NEEDS_DATA' END
    AS recommended_action FROM rec
""")
def _(t):
    return fo.rank_markets(_scenarios(t))


@query("J24_donor_exposure", f"""
WITH s AS (
  SELECT p.focal_upc, p.donor_upc, p.channel_outlet, p.retail_account, p.geography_raw,
    0.4 / p.relationship_distance + 0.2 * coalesce(1 / (1 + abs(focal_price_per_unit
      - donor_price_per_unit)), 0) + 0.3 * coalesce(opposition_rate, 0)
      + 0.1 * (1 - coalesce(co_win_rate, 0)) AS exposure_score
  FROM c_pairs p LEFT JOIN c_assoc a ON a.focal_upc = p.focal_upc AND a.comparison_upc = p.donor_upc
    AND a.channel_outlet = p.channel_outlet AND a.retail_account = p.retail_account
    AND a.geography_raw = p.geography_raw
)
--
SELECT *, exposure_score / sum(exposure_score) OVER (PARTITION BY focal_upc, {MARKET})
    AS donor_attribution_weight, row_number() OVER (PARTITION BY focal_upc, {MARKET}
    ORDER BY exposure_score DESC, donor_upc) AS donor_rank FROM s
""")
def _(t):
    return fo.donor_exposure(
        tp.pairs(t), wi.win_association(tp.pool(t), wi.win_flags(t.enriched)))


@query("J25_future_frame", f"""
SELECT f.*, weekofyear(week) AS week_of_year FROM (
  SELECT {SERIES}, h AS forecast_week_number, aw + CAST(7 * h AS INTEGER) AS week, pack_count, arp,
    tdp, wsl + h AS weeks_since_launch
  FROM (SELECT {SERIES}, max(week) AS aw, arg_max(pack_count, week) AS pack_count,
      arg_max(arp, week) AS arp, arg_max(tdp, week) AS tdp,
      arg_max(datediff('day', first_week_selling, week) // 7, week) AS wsl
    FROM c_own GROUP BY ALL) a, (SELECT unnest(range(1, 14)) AS h) s) f
""")
def _(t):
    p = own(t).withColumn("weeks_since_launch", weeks_between("week", "first_week_selling"))
    return pa.future_frame(p).select(
        *SERIES_KEYS, "forecast_week_number", "week", "pack_count", "arp", "tdp",
        "weeks_since_launch", "week_of_year")


@query("J26_forecast_velocity", """
SELECT forecast_week_number, upc, channel_outlet, retail_account, avg_tdp_anchor,
  avg(forecast_units_low / avg_tdp_anchor) AS forecast_vel_low,
  avg(forecast_units_base / avg_tdp_anchor) AS forecast_vel_base,
  avg(forecast_units_high / avg_tdp_anchor) AS forecast_vel_high
FROM c_flat JOIN (SELECT upc, channel_outlet, retail_account, avg(tdp) AS avg_tdp_anchor
  FROM c_own GROUP BY ALL) a USING (upc, channel_outlet, retail_account)
GROUP BY ALL
""")
def _(t):
    return pa.forecast_velocity(flat_forecast(t), own(t))


@query("J27_sku_contribution", """
SELECT upc, retail_account, base_dollars, base_dollars / sum(base_dollars) OVER (PARTITION BY upc)
  AS sku_contribution
FROM (SELECT upc, retail_account, sum(base_dollars) AS base_dollars FROM c_own GROUP BY ALL) q
""")
def _(t):
    return pa.sku_contribution(own(t))


@query("J27_promo_roi", LIFT_SQL + """
SELECT upc, channel_outlet, retail_account, discount_bucket, lift_rate_mean AS best_lift_estimate,
  lift_rate_mean * b * a AS expected_lift_dollars, (lift_rate_mean * b * a - 50) / 50 AS promo_roi
FROM lift JOIN (SELECT upc, channel_outlet, retail_account, avg(base_units) AS b, avg(arp) AS a
  FROM c_own GROUP BY ALL) q USING (upc, channel_outlet, retail_account)
""")
def _(t):
    summary = pr.promo_lift_summary(pr.promo_events(t.filtered, t.cfg))
    return pa.promo_roi(summary, own(t), 50.0)
