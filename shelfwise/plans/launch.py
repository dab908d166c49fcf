"""Queries of group G."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import launch as la
from shelfwise.operators.enrich import own_scored
from shelfwise.operators.pool import launch_pairs
from shelfwise.plans.registry import query
from shelfwise.plans.transfer import _cols, pool, prepost
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"


@query("G1_new_upcs", "SELECT * FROM c_new_upcs")
def _(t):
    return la.new_upcs(t.enriched, t.cfg)


def classified(t):
    return la.classify_new(la.new_upcs(t.enriched, t.cfg), t.enriched, t.cfg)


@query("G2_classify_new", "SELECT * FROM c_classified")
def _(t):
    return classified(t)


@query("C10_conditional_exists", """
SELECT upc, min(upc_classification) AS upc_classification, count(*) AS markets
FROM c_classified GROUP BY 1
""")
def _(t):
    return classified(t).groupBy("upc").agg(
        F.min("upc_classification").alias("upc_classification"), F.count(F.lit(1)).alias("markets"))


@query("G3_ramp_monitor_16w", "SELECT * FROM c_ramp16")
def _(t):
    return la.ramp_monitor(t.enriched, t.cfg)


@query("G4_ramp_monitor_12w", "SELECT * FROM c_ramp12")
def _(t):
    return la.ramp_monitor(t.enriched, t.cfg, "12w")


PRELAUNCH_SQL = f"""
WITH pr AS (SELECT DISTINCT focal_upc, candidate_upc, {MARKET}, focal_first_week_selling
  FROM c_launch_pairs),
h AS (
  SELECT pr.*, f.base_units, row_number() OVER (PARTITION BY pr.focal_upc, pr.candidate_upc,
      pr.channel_outlet, pr.retail_account, pr.geography_raw, pr.focal_first_week_selling
    ORDER BY f.week DESC) AS rn
  FROM pr JOIN c_enriched f ON f.upc = pr.candidate_upc AND f.channel_outlet = pr.channel_outlet
    AND f.retail_account = pr.retail_account AND f.geography_raw = pr.geography_raw
    AND f.week < pr.focal_first_week_selling
)
--
SELECT focal_upc, candidate_upc, {MARKET}, focal_first_week_selling,
  avg(base_units) AS pre_launch_avg_base_units, count(base_units) AS pre_launch_week_count
FROM h WHERE rn <= 13 GROUP BY ALL HAVING count(base_units) >= 4
"""


@query("G5_prelaunch_baseline", PRELAUNCH_SQL)
def _(t):
    return la.prelaunch_baseline(launch_pairs(pool(t)), t.enriched)


@query("C17_prelaunch_join", f"""
SELECT p.candidate_upc, p.focal_first_week_selling, count(*) AS prelaunch_rows
FROM (SELECT DISTINCT candidate_upc, {MARKET}, focal_first_week_selling FROM c_launch_pairs) p
JOIN c_enriched f ON f.upc = p.candidate_upc AND f.channel_outlet = p.channel_outlet
  AND f.retail_account = p.retail_account AND f.geography_raw = p.geography_raw
  AND f.week < p.focal_first_week_selling
GROUP BY ALL
""")
def _(t):
    anchors = launch_pairs(pool(t)).select(
        "candidate_upc", *MARKET_KEYS, "focal_first_week_selling").distinct()
    return anchors.join(
        t.enriched.select(F.col("upc").alias("candidate_upc"), *MARKET_KEYS, "week"),
        ["candidate_upc", *MARKET_KEYS],
    ).where("week < focal_first_week_selling").groupBy(
        "candidate_upc", "focal_first_week_selling").agg(F.count(F.lit(1)).alias("prelaunch_rows"))


@query("G6_new_pack_events", """
SELECT DISTINCT upc AS focal_upc, description AS focal_description, pack_count, size_oz,
  closest_pack_partner_upc, closest_pack_partner_description, 'NEW_PACK_SIZE' AS event_type,
  'New pack size detected: ' || description || CASE WHEN closest_pack_partner_description IS NULL
    THEN '' ELSE ' (closest partner: ' || closest_pack_partner_description || ')' END AS event_label,
  'amber' AS event_color, 'Watch' AS transfer_status, 'Medium' AS transfer_confidence
FROM c_classified WHERE upc_classification = 'NEW_PACK_SIZE' AND flavor_taxonomy_conflict = 'N'
""")
def _(t):
    return la.new_pack_events(classified(t))


@query("G7_maturity_tier", f"""
SELECT {SERIES}, post_26w_weeks_count AS post_weeks, CASE WHEN post_26w_weeks_count >= 13
  THEN 'FULL' WHEN post_26w_weeks_count >= 8 THEN 'PARTIAL' ELSE 'EARLY' END AS confidence_tier
FROM c_prepost
""")
def _(t):
    return la.launch_tiers(prepost(t))


@query("G8_similar_skus", """
WITH f AS (
  SELECT upc, channel_outlet, arg_min(avg_weekly_units_spm,
      CAST(week AS VARCHAR) || retail_account || geography_raw) AS v,
    min(first_week_selling) AS fws, min(flavor) AS fl, min(specific_flavor_normalized) AS sp,
    CASE WHEN min(pack_count) <= 1 THEN 'single' WHEN min(pack_count) <= 4 THEN '2 to 4'
      WHEN min(pack_count) <= 8 THEN '5 to 8' WHEN min(pack_count) <= 12 THEN '9 to 12'
      ELSE '13 plus' END AS pack_band
  FROM c_own GROUP BY ALL
), d AS (
  SELECT n.upc AS new_upc, o.upc AS similar_upc, channel_outlet, pack_band,
    abs(ln(greatest(n.v, 0.01)) - ln(greatest(o.v, 0.01)))
      + CASE WHEN n.fl <> o.fl THEN 1 ELSE 0 END + CASE WHEN n.sp <> o.sp THEN 0.5 ELSE 0 END
      AS similarity_distance
  FROM (SELECT * FROM f WHERE fws >= DATE '1997-04-06') n
  JOIN (SELECT * FROM f WHERE fws < DATE '1997-04-06') o USING (channel_outlet, pack_band)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY new_upc, channel_outlet
    ORDER BY similarity_distance, similar_upc) AS similarity_rank FROM d
)
--
SELECT * FROM r WHERE similarity_rank <= 5
""")
def _(t):
    return la.similar_skus(t.enriched, t.cfg)


@query("G9_launch_percentile", f"""
WITH r AS (
  SELECT {SERIES}, datediff('day', first_week_selling, week) // 7 AS week_n,
    avg_weekly_units_spm AS velocity FROM c_own
)
--
SELECT *, percent_rank() OVER (PARTITION BY week_n ORDER BY velocity) AS launch_percentile
FROM r WHERE week_n BETWEEN 0 AND 26
""")
def _(t):
    return la.launch_percentile(t.enriched, t.cfg)


@query("G10_launch_projection", f"""
WITH r AS (
  SELECT *, CAST(datediff('day', first_week_selling, week) // 7 AS DOUBLE) AS x FROM c_own
), f AS (
  SELECT {SERIES}, regr_slope(base_units, x) AS slope, regr_intercept(base_units, x) AS i,
    sqrt(greatest(0, regr_syy(base_units, x) - regr_sxy(base_units, x) * regr_sxy(base_units, x)
      / regr_sxx(base_units, x)) / (count(*) - 2)) AS s, max(x) AS last_x, count(*) AS n
  FROM r WHERE x BETWEEN 0 AND 11 GROUP BY ALL
), p AS (
  SELECT *, i + slope * (last_x + step) AS mid
  FROM (SELECT *, unnest(range(1, 14)) AS step FROM f WHERE n >= 4) q
)
--
SELECT {SERIES}, step, slope, greatest(mid, 0) AS projected_units,
  greatest(mid - 1.28 * s, 0) AS projected_low, greatest(mid + 1.28 * s, 0) AS projected_high FROM p
""")
def _(t):
    return la.launch_projection(t.enriched, t.cfg)


@query("G11_ramp_match")
def _(t):
    return la.ramp_match(t.enriched, t.cfg)


def month_index(t):
    from shelfwise.operators.forecast import monthly_index

    return monthly_index(t.filtered)


@query("G12_analog_overlay")
def _(t):
    return la.analog_overlay(la.ramp_match(t.enriched, t.cfg), own_scored(t.enriched, t.cfg),
                             month_index(t).select("month", "demand_index"))


@query("G13_tdp_milestones", f"""
SELECT {SERIES}, arg_min(tdp, week) AS launch_tdp,
  max(tdp) FILTER (WHERE datediff('day', first_week_selling, week) // 7 = 7) AS week7_tdp,
  arg_max(tdp, week) AS last_tdp, max(tdp) AS peak_tdp FROM c_own GROUP BY ALL
""")
def _(t):
    return la.tdp_milestones(t.enriched, t.cfg)


@query("G14_early_flags", f"""
WITH norms AS (
  SELECT week, {MARKET}, source_pack_count AS pack_count,
    avg(avg_weekly_units_spm) AS nv, avg(tdp) AS nt
  FROM c_filtered WHERE source_brand NOT LIKE 'OWN%' AND arp > 0 GROUP BY ALL
), sib AS (SELECT DISTINCT upc FROM c_classified WHERE upc_classification = 'NEW_PACK_SIZE')
--
SELECT n.upc, n.channel_outlet, n.retail_account, n.geography_raw, n.pack_count,
  (units_first_week / nullif(tdp_first_week, 0)) / nv AS velocity_vs_norm,
  tdp_first_week / nt AS tdp_vs_norm,
  CASE WHEN s.upc IS NOT NULL THEN 'LIKELY_CANNIBALISTIC' ELSE 'LIKELY_INCREMENTAL' END
    AS assortment_flag
FROM c_new_upcs n
LEFT JOIN norms USING (week, channel_outlet, retail_account, geography_raw, pack_count)
LEFT JOIN sib s ON s.upc = n.upc
""")
def _(t):
    from shelfwise.operators.price import category_norms

    c = classified(t)
    return la.early_flags(
        c, category_norms(t.filtered, t.cfg).select(
            "week", *MARKET_KEYS, "pack_count", "norm_avg_velocity_spm", "norm_avg_tdp"),
        c.where("upc_classification = 'NEW_PACK_SIZE'").select("upc"))
