"""Queries of the pool joins, launch windows and demand transfer (groups C, D1-D6, H)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import pool as po
from shelfwise.operators import transfer as tr
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import select_pool
from shelfwise.plans.registry import query
from shelfwise.scale import written
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

MARKET = "channel_outlet, retail_account, geography_raw"
PAIR = f"focal_upc, donor_upc, {MARKET}"


def pool(t, by_market=False):
    return po.comparison_pool(t.enriched, t.cfg, by_market=by_market)


def prepost(t):
    return tr.focal_prepost(t.enriched, t.cfg)


def pairs(t, min_weeks=8, **kw):
    donor = tr.donor_prepost(pool(t, by_market=True), t.filtered, t.cfg)
    return tr.pair_features(prepost(t), donor, min_weeks, **kw)


#: A fixed stand-in score, so that everything after a model can be checked against SQL.
RULE_SCORE = (
    "least(0.99, greatest(0.01, 0.5 - 0.4 * donor_base_units_pct_chg"
    " - 0.05 * relationship_distance))"
)


def rule_scored(t, min_weeks=8):
    return tr.score_bands(pairs(t, min_weeks).withColumn("transfer_prob", F.expr(RULE_SCORE)))


RULE_SCORED_SQL = f"""
WITH scored AS (
  SELECT *, CASE WHEN transfer_prob <= 0.35 THEN 'Incremental' WHEN transfer_prob <= 0.65
      THEN 'Watch' ELSE 'Cannibalizing' END AS transfer_status,
    CASE WHEN focal_pre_weeks_count >= 12 AND focal_post_weeks_count >= 10 THEN 'High'
      WHEN focal_pre_weeks_count >= 8 AND focal_post_weeks_count >= 8 THEN 'Medium'
      ELSE 'Low' END AS transfer_confidence
  FROM (SELECT *, {RULE_SCORE} AS transfer_prob FROM c_pairs) x
)
--
"""

_POOL_COLS = (
    f"week, {MARKET}, focal_upc, candidate_upc, focal_brand, candidate_brand, focal_flavor, "
    "candidate_flavor, focal_pack_count, candidate_pack_count, comparison_type, "
    "relationship_distance, pack_distance, price_per_unit_ratio, candidate_base_units, "
    "candidate_velocity_spm, candidate_competitor_tier"
)


def _cols(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


@query("C1_comparison_pool", f"SELECT {_POOL_COLS} FROM c_pool")
def _(t):
    return pool(t).select(*_cols(_POOL_COLS))


@query("C2_relationship_mix", """
SELECT relationship_distance, comparison_type, count(*) AS pairs,
  sum(candidate_base_units) AS candidate_base_units FROM c_pool GROUP BY ALL
""")
def _(t):
    return pool(t).groupBy("relationship_distance", "comparison_type").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("candidate_base_units").alias("candidate_base_units"))


@query("C3_competitive_pool", """
SELECT f.week, f.channel_outlet, f.retail_account, f.geography_raw, f.upc AS focal_upc,
  f.pack_count AS focal_pack_count, f.arp AS focal_arp, f.base_units AS focal_base_units,
  f.avg_weekly_units_spm AS focal_velocity_spm, c.upc AS competitor_upc,
  c.source_brand AS competitor_brand, c.flavor_raw AS competitor_flavor_raw,
  c.source_pack_count AS competitor_pack_count, c.arp AS competitor_arp,
  c.arp / c.source_pack_count AS competitor_price_per_unit,
  c.base_units AS competitor_base_units, c.avg_weekly_units_spm AS competitor_velocity_spm,
  'CROSS_FLAVOR_CROSS_BRAND' AS comparison_type, 6 AS relationship_distance,
  CAST(NULL AS BIGINT) AS pack_distance, 1 AS competitor_tier
FROM c_enriched f JOIN c_filtered c USING (week, channel_outlet, retail_account, geography_raw)
WHERE f.upc = 'SKU-03' AND c.source_brand = 'BRAND1' AND f.channel_outlet = 'MACHINERY'
  AND f.retail_account = 'ACCT-0' AND f.geography_raw = 'GEO-0' AND f.week >= DATE '1998-01-05'
""")
def _(t):
    return po.competitive_pool(t.enriched, t.filtered, t.cfg, "SKU-03", "BRAND1", "MACHINERY",
                               "ACCT-0", "GEO-0", dt.date(1998, 1, 5))


@query("C4_launch_pairs", "SELECT * FROM c_launch_pairs")
def _(t):
    return po.launch_pairs(pool(t))


@query("C5_focal_donor_join", f"""
SELECT focal_upc, {MARKET}, count(*) AS donors, sum(donor_pre_13w_base_units) AS donor_pre_units
FROM c_pairs GROUP BY ALL
""")
def _(t):
    return pairs(t).groupBy("focal_upc", *MARKET_KEYS).agg(
        F.count(F.lit(1)).alias("donors"),
        F.sum("donor_pre_13w_base_units").alias("donor_pre_units"))


@query("C9_semi_join_scope", f"""
SELECT upc, {MARKET}, post_13w_base_units FROM c_prepost p
WHERE EXISTS (SELECT 1 FROM c_own e WHERE e.flavor = 'FL1' AND e.upc = p.upc
  AND e.channel_outlet = p.channel_outlet AND e.retail_account = p.retail_account
  AND e.geography_raw = p.geography_raw)
""")
def _(t):
    return tr.heatmap(prepost(t), t.enriched, t.cfg, flavor="FL1").select(
        *SERIES_KEYS, "post_13w_base_units")


@query("D1_focal_prepost", "SELECT * FROM c_prepost")
def _(t):
    return prepost(t)


@query("D1_focal_prepost_untrimmed", "SELECT * FROM u_prepost", trim_launch=False)
def _(t):
    return prepost(t)


@query("D2_donor_prepost", "SELECT * FROM c_donor")
def _(t):
    return tr.donor_prepost(pool(t, by_market=True), t.filtered, t.cfg)


@query("D3_filtered_aggregates", f"""
SELECT {MARKET}, sum(units) FILTER (WHERE promo_weeks = 1) AS promo_units,
  avg(arp) FILTER (WHERE promo_weeks = 0) AS regular_arp,
  count(*) FILTER (WHERE base_units = 0) AS zero_base_weeks
FROM c_filtered GROUP BY ALL
""")
def _(t):
    return t.filtered.groupBy(*MARKET_KEYS).agg(
        F.expr("sum(units) FILTER (WHERE promo_weeks = 1)").alias("promo_units"),
        F.expr("avg(arp) FILTER (WHERE promo_weeks = 0)").alias("regular_arp"),
        F.expr("count(*) FILTER (WHERE base_units = 0)").alias("zero_base_weeks"))


_LABEL = """CASE relationship_distance WHEN 1 THEN 'Pack size comparison'
  WHEN 2 THEN 'Same flavor · any brand' WHEN 3 THEN 'Cross-flavor · own brand only'
  WHEN 4 THEN 'Cross-flavor · all brands' WHEN 5 THEN 'Other own flavor groups'
  ELSE 'Full competitive · on-demand' END AS comparison_scope_label"""


@query("D4_pool_distinct_counts", f"""
SELECT focal_upc, {MARKET}, comparison_type, relationship_distance,
  count(DISTINCT candidate_upc) AS pool_sku_count, {_LABEL} FROM c_pool GROUP BY ALL
""")
def _(t):
    return po.pool_scope(
        pool(t), ["focal_upc", *MARKET_KEYS, "comparison_type", "relationship_distance"])


@query("D5_having_average", """
SELECT upc, avg(arp) AS avg_arp, count(*) AS n FROM c_enriched GROUP BY upc HAVING avg(arp) >= 4
""")
def _(t):
    return t.enriched.groupBy("upc").agg(
        F.avg("arp").alias("avg_arp"), F.count(F.lit(1)).alias("n")).where(F.col("avg_arp") >= 4)


@query("D6_representatives", f"""
SELECT {MARKET}, min(description) AS any_description,
  arg_max(arp, CAST(week AS VARCHAR) || upc) AS latest_arp, max(week) AS latest_week
FROM c_filtered GROUP BY ALL
""")
def _(t):
    return t.filtered.groupBy(*MARKET_KEYS).agg(
        F.min("description").alias("any_description"),
        F.max_by("arp", F.concat(F.col("week").cast("string"), F.col("upc"))).alias("latest_arp"),
        F.max("week").alias("latest_week"))


@query("D14_pool_census", """
SELECT year(week) AS yr, comparison_type, count(*) AS pairs FROM c_pool GROUP BY ALL
""")
def _(t):
    return po.pool_census(pool(t))


@query("B16_select_pool", f"""
SELECT 'pack_ladder' AS mode, focal_upc, candidate_upc, {MARKET}, week FROM c_pool
  WHERE relationship_distance = 1
UNION ALL SELECT 'same_family_own', focal_upc, candidate_upc, {MARKET}, week FROM c_pool
  WHERE relationship_distance IN (1, 3) AND candidate_brand = 'OWN'
UNION ALL SELECT 'selected_brands', focal_upc, candidate_upc, {MARKET}, week FROM c_pool
  WHERE candidate_brand IN ('BRAND0', 'BRAND3')
UNION ALL SELECT 'custom_basket', focal_upc, candidate_upc, {MARKET}, week FROM c_pool
  WHERE candidate_upc IN (SELECT upc FROM c_skus WHERE source_pack_count = 8)
""")
def _(t):
    p = pool(t)
    basket = t.skus.where("source_pack_count = 8").select(F.col("upc").alias("candidate_upc"))
    requests = {
        "pack_ladder": {}, "same_family_own": {},
        "selected_brands": {"brands": ("BRAND0", "BRAND3")}, "custom_basket": {"basket": basket},
    }
    out = None
    for mode, kw in requests.items():
        part = select_pool(p, mode, t.cfg, **kw).select(
            F.lit(mode).alias("mode"), "focal_upc", "candidate_upc", *MARKET_KEYS, "week")
        out = part if out is None else out.unionByName(part)
    return out


@query("F6_pool_names", """
SELECT DISTINCT candidate_upc, candidate_description FROM c_pool
WHERE focal_upc = 'SKU-05' AND channel_outlet = 'BUILDING'
""")
def _(t):
    return po.pool_names(pool(t).where("focal_upc = 'SKU-05' AND channel_outlet = 'BUILDING'"))


@query("F7_pool_name_list", """
SELECT focal_upc, string_agg(candidate_description, ', ' ORDER BY candidate_description) AS names
FROM (SELECT DISTINCT focal_upc, candidate_description FROM c_pool) x GROUP BY 1
""")
def _(t):
    return po.pool_name_list(pool(t), ["focal_upc"])


# ---------------------------------------------------------------- H


@query("H1_pair_features", "SELECT * FROM c_pairs")
def _(t):
    return pairs(t)


@query("H1_pair_features_single_channel", "SELECT * FROM s_pairs4", channel="all")
def _(t):
    return pairs(t, 4)


@query("H2_labels_untrimmed", f"""
SELECT {PAIR}, label_deterministic, donor_base_units_pct_chg, focal_base_units_pct_chg
FROM u_pairs
""", trim_launch=False)
def _(t):
    return pairs(t).select(*_cols(PAIR), "label_deterministic", "donor_base_units_pct_chg",
                           "focal_base_units_pct_chg")


@query("H2_label_treat_missing_as_gain", f"""
SELECT {PAIR}, CASE WHEN dc < -0.10 AND fc > 0.03 THEN 'CANNIBALIZING'
  WHEN dc < -0.03 AND fc > 0 THEN 'WATCH' WHEN dc >= -0.03 THEN 'INCREMENTAL'
  ELSE 'NEUTRAL' END AS label_deterministic
FROM (SELECT *, donor_base_units_pct_chg AS dc, CASE WHEN focal_pre_base_units = 0
    THEN 1.0 ELSE focal_base_units_pct_chg END AS fc FROM c_pairs) x
""")
def _(t):
    return pairs(t, focal_pre_missing="treat_as_gain").select(*_cols(PAIR), "label_deterministic")


@query("H3_demand_vs_distribution", """
SELECT demand_vs_dist, relationship_distance, count(*) AS n FROM u_pairs GROUP BY ALL
""", trim_launch=False)
def _(t):
    return pairs(t).groupBy("demand_vs_dist", "relationship_distance").agg(
        F.count(F.lit(1)).alias("n"))


@query("H4_incremental_share", f"""
SELECT {PAIR}, incremental_share, cannibalization_rate FROM u_pairs
""", trim_launch=False)
def _(t):
    return pairs(t).select(*_cols(PAIR), "incremental_share", "cannibalization_rate")


@query("H5_heatmap", f"""
SELECT upc, {MARKET}, description, pack_count, pre_13w_base_units, post_13w_base_units,
  chg AS base_units_pct_chg,
  CASE WHEN pre_13w_base_units = 0 THEN 'hm-no-data' WHEN chg < -0.10 THEN 'hm-strong-neg'
    WHEN chg < -0.03 THEN 'hm-mild-neg' WHEN chg <= 0.03 THEN 'hm-neutral'
    WHEN chg <= 0.10 THEN 'hm-mild-pos' ELSE 'hm-strong-pos' END AS heatmap_bucket
FROM (SELECT *, (post_13w_base_units - pre_13w_base_units) / nullif(pre_13w_base_units, 0) AS chg
  FROM u_prepost) x WHERE flavor = 'FL1'
""", trim_launch=False)
def _(t):
    return tr.heatmap(prepost(t), t.enriched, t.cfg, flavor="FL1")


@query("H6_pool_scope", f"""
SELECT comparison_type, relationship_distance, count(DISTINCT candidate_upc) AS pool_sku_count,
  {_LABEL} FROM c_pool
WHERE focal_upc = 'SKU-05' AND channel_outlet = 'BUILDING' GROUP BY ALL
""")
def _(t):
    return po.pool_scope(pool(t).where("focal_upc = 'SKU-05' AND channel_outlet = 'BUILDING'"))


RATE_SQL = RULE_SCORED_SQL.replace("\n--\n", f""", losses AS (
  SELECT d.week, s.focal_upc, s.channel_outlet, s.retail_account, s.geography_raw,
    sum(transfer_prob * greatest(0, -coalesce(d.base_units_wow_delta, 0))) AS weighted_donor_loss,
    count(DISTINCT s.donor_upc) AS donor_count, max(transfer_prob) AS max_donor_prob
  FROM scored s JOIN c_events d ON d.upc = s.donor_upc AND d.channel_outlet = s.channel_outlet
    AND d.retail_account = s.retail_account AND d.geography_raw = s.geography_raw
  GROUP BY ALL
), rate AS (
  SELECT e.week, e.upc AS focal_upc, e.channel_outlet, e.retail_account, e.geography_raw,
    e.base_units, e.base_units_wow_delta, coalesce(weighted_donor_loss, 0) AS weighted_donor_loss,
    least(1, greatest(0, coalesce(coalesce(weighted_donor_loss, 0) / nullif(e.base_units, 0), 0)))
      AS cannibalization_rate,
    coalesce(donor_count, 0) AS donor_count, coalesce(max_donor_prob, 0) AS max_donor_prob
  FROM c_events e LEFT JOIN losses l ON e.week = l.week AND e.upc = l.focal_upc
    AND e.channel_outlet = l.channel_outlet AND e.retail_account = l.retail_account
    AND e.geography_raw = l.geography_raw
  WHERE e.upc IN (SELECT focal_upc FROM scored)
)
--
""")


def rates(t):
    return tr.rate_weekly(written(rule_scored(t)), w.event_detection(t.enriched))


@query("H7_rate_weekly", RATE_SQL + "SELECT * FROM rate")
def _(t):
    return rates(t)


@query("C13_donor_loss_weeks", RATE_SQL + "SELECT focal_upc, count(*) AS weeks, "
       "sum(weighted_donor_loss) AS weighted_donor_loss FROM losses GROUP BY 1")
def _(t):
    r = tr.donor_losses(rule_scored(t), w.event_detection(t.enriched))
    return r.groupBy("focal_upc").agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("weighted_donor_loss").alias("weighted_donor_loss")
    )


@query("H8_rate_trend", RATE_SQL + f"""
SELECT week, focal_upc, {MARKET}, avg(cannibalization_rate) AS cannibalization_rate,
  avg(weighted_donor_loss) AS estimated_donor_units_lost, max(donor_count) AS donor_count,
  'ACTUAL' AS series_type, CAST(NULL AS DOUBLE) AS forecast_rate_low,
  CAST(NULL AS DOUBLE) AS forecast_rate_high
FROM rate WHERE week >= DATE '2001-10-01' - 56 AND week <= DATE '2001-10-01' GROUP BY ALL
UNION ALL
SELECT DATE '2001-10-01' + CAST(7 * h AS INTEGER), focal_upc, {MARKET}, m, NULL, NULL,
  'FORECAST', m * 0.5, least(1, m * 1.5)
FROM (SELECT focal_upc, {MARKET}, avg(cannibalization_rate) AS m FROM rate GROUP BY ALL) x,
  (SELECT unnest(range(1, 14)) AS h) s
""")
def _(t):
    r = rates(t)
    as_of = dt.date(2001, 10, 1)
    flat = r.groupBy("focal_upc", *MARKET_KEYS).agg(F.avg("cannibalization_rate").alias("m"))
    forecast = flat.select("*", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("h")).select(
        F.date_add(F.lit(as_of), F.col("h") * 7).alias("week"), "focal_upc", *MARKET_KEYS,
        F.col("m").alias("forecast_rate_base"), (F.col("m") * 0.5).alias("forecast_rate_low"),
        F.least(F.lit(1.0), F.col("m") * 1.5).alias("forecast_rate_high"))
    return tr.rate_trend(r, forecast, as_of)


def _pair_history(t):
    """Donor weeks around each focal launch."""
    p = pairs(t).select("donor_upc", *MARKET_KEYS, "focal_first_week_selling").distinct()
    return p.join(t.filtered.withColumnRenamed("upc", "donor_upc"),
                  ["donor_upc", *MARKET_KEYS]).withColumn(
        "offset", F.floor(F.datediff("week", "focal_first_week_selling") / 7).cast("int"))


_SIG_KEYS = ["donor_upc", *MARKET_KEYS, "focal_first_week_selling"]

SIG_SQL = f"""
WITH hist AS (
  SELECT p.donor_upc, p.channel_outlet, p.retail_account, p.geography_raw,
    p.focal_first_week_selling, d.base_units,
    CAST(floor(datediff('day', p.focal_first_week_selling, d.week) / 7) AS INTEGER) AS o
  FROM (SELECT DISTINCT donor_upc, {MARKET}, focal_first_week_selling FROM c_pairs) p
  JOIN c_filtered d ON d.upc = p.donor_upc AND d.channel_outlet = p.channel_outlet
    AND d.retail_account = p.retail_account AND d.geography_raw = p.geography_raw
), st AS (
  SELECT donor_upc, {MARKET}, focal_first_week_selling,
    count(base_units) FILTER (WHERE o BETWEEN -13 AND -1) AS n_pre,
    count(base_units) FILTER (WHERE o BETWEEN 0 AND 12) AS n_post,
    avg(base_units) FILTER (WHERE o BETWEEN -13 AND -1) AS mean_pre,
    avg(base_units) FILTER (WHERE o BETWEEN 0 AND 12) AS mean_post,
    var_samp(base_units) FILTER (WHERE o BETWEEN -13 AND -1) / n_pre AS a,
    var_samp(base_units) FILTER (WHERE o BETWEEN 0 AND 12) / n_post AS b
  FROM hist GROUP BY ALL
), sig AS (
  SELECT *, (mean_pre - mean_post) / nullif(sqrt(a + b), 0) AS t_stat,
    (a + b) * (a + b) / nullif(a * a / (n_pre - 1) + b * b / (n_post - 1), 0) AS dof,
    (mean_post - mean_pre) / (abs(mean_pre) + 1e-9) AS pct_change FROM st
)
--
"""


@query("H17_window_significance", SIG_SQL + f"""
SELECT donor_upc, {MARKET}, focal_first_week_selling, n_pre, n_post, mean_pre, mean_post,
  t_stat, dof, pct_change FROM sig
""")
def _(t):
    return tr.window_significance(_pair_history(t), _SIG_KEYS).select(
        *_SIG_KEYS, "n_pre", "n_post", "mean_pre", "mean_post", "t_stat", "dof", "pct_change")


@query("H18_assemble_events")
def _(t):
    sig = tr.window_significance(_pair_history(t), _SIG_KEYS).select(
        *_SIG_KEYS, "significant", "pct_change", "p_value")
    scored = rule_scored(t)
    # the donor's z-score in the newest week of the 13 after the launch
    seen = w.event_detection(t.enriched).select(
        F.col("upc").alias("donor_upc"), *MARKET_KEYS, F.col("week").alias("_week"), F.col("base_units_z13").alias("_z"))
    launch = F.col("focal_first_week_selling")
    z = scored.select(*_SIG_KEYS).distinct().join(seen, ["donor_upc", *MARKET_KEYS]).where(
        F.col("_week").between(launch, F.date_add(launch, 91))
    ).groupBy(*_SIG_KEYS).agg(F.max_by("_z", "_week").alias("z_score"))
    evidence = scored.join(sig, _SIG_KEYS, "left").join(z, _SIG_KEYS, "left")
    return tr.assemble_events(evidence).select(
        *_cols(PAIR), "transfer_prob", "z_score", "pct_change", "confidence", "event_label")


@query("H19_assign_event", RULE_SCORED_SQL + f"""
SELECT {PAIR}, event_type, event_color, CASE
  WHEN dc < -0.10 THEN 'Significant Demand Transfer Detected'
  WHEN tc > 0.15 AND vc < -0.03 THEN 'Distribution-Led Gain Detected'
  WHEN dc < -0.05 AND event_type = 'CROSS_FLAVOR_SIGNAL'
    THEN 'Cross-Flavor Signal: ' || donor_description || ' Declining'
  WHEN dc < -0.05 THEN 'Pack Overlap Risk Elevated'
  ELSE 'Watch — Monitor Before Expanding' END AS event_label
FROM (
  SELECT *, CASE WHEN dc < -0.10 OR (tc > 0.15 AND vc < -0.03) THEN 'DEMAND_TRANSFER'
      WHEN dc < -0.05 AND relationship_distance IN (3, 4) THEN 'CROSS_FLAVOR_SIGNAL'
      ELSE 'PACK_OVERLAP_RISK' END AS event_type,
    CASE WHEN dc < -0.10 THEN 'red' WHEN (tc > 0.15 AND vc < -0.03) OR dc < -0.05 THEN 'amber'
      ELSE 'green' END AS event_color
  FROM (SELECT *, coalesce(donor_base_units_pct_chg, 0) AS dc, coalesce(focal_tdp_pct_chg, 0) AS tc,
      coalesce(focal_velocity_spm_pct_chg, 0) AS vc FROM scored) y
  WHERE transfer_status = 'Cannibalizing'
    OR (transfer_status = 'Watch' AND transfer_confidence IN ('High', 'Medium'))
) x
""")
def _(t):
    return tr.assign_event(rule_scored(t)).select(
        *_cols(PAIR), "event_type", "event_color", "event_label")


@query("H20_score_bands", RULE_SCORED_SQL + f"""
SELECT {PAIR}, transfer_prob, transfer_status, transfer_confidence FROM scored
""")
def _(t):
    return rule_scored(t).select(*_cols(PAIR), "transfer_prob", "transfer_status",
                                 "transfer_confidence")


@query("H21_event_label", f"""
SELECT {PAIR}, CASE WHEN label_deterministic = 'CANNIBALIZING' AND donor_base_units_pct_chg < -0.05
  THEN 1 ELSE 0 END AS event_significant FROM u_pairs
""", trim_launch=False)
def _(t):
    return tr.event_label(pairs(t)).select(*_cols(PAIR), "event_significant")


@query("H22_ranking_frame", f"""
SELECT {PAIR}, CASE label_deterministic WHEN 'CANNIBALIZING' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END
  AS relevance FROM u_pairs WHERE label_deterministic <> 'NEUTRAL'
""", trim_launch=False)
def _(t):
    return tr.ranking_frame(pairs(t)).select(*_cols(PAIR), "relevance")


@query("H23_rank_donors", RULE_SCORED_SQL + f"""
SELECT {PAIR}, transfer_prob, row_number() OVER (PARTITION BY focal_upc, {MARKET}
  ORDER BY transfer_prob DESC, donor_upc) AS donor_rank FROM scored
""")
def _(t):
    return tr.rank_donors(rule_scored(t)).select(*_cols(PAIR), "transfer_prob", "donor_rank")


@query("E8_top_donors", RULE_SCORED_SQL + f"""
SELECT {PAIR}, transfer_prob, rn AS donor_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY focal_upc, {MARKET}
    ORDER BY transfer_prob DESC, donor_upc) AS rn FROM scored) x WHERE rn <= 3
""")
def _(t):
    return tr.rank_donors(rule_scored(t), top=3).select(*_cols(PAIR), "transfer_prob", "donor_rank")
