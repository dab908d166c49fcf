"""Queries of group I and the price-related joins and norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import launch as la
from shelfwise.operators import price as pr
from shelfwise.operators import refute
from shelfwise.plans.registry import query
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS, SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"
MW = f"week, {MARKET}"


def prices(t):
    return pr.price_weekly(t.enriched, t.cfg)


def competitive(t):
    return pr.competitive_price(prices(t), t.filtered, t.cfg)


def rule_elasticity(t, min_weeks=4):
    """Price windows scored with a fixed response in place of a fitted one."""
    frame = pr.elasticity_frame(pr.price_windows(prices(t), min_weeks), guard=False)
    return pr.elasticity_score(frame.withColumn(
        "predicted_log_unit_change", F.expr("-0.8 * log_price_change + 0.3 * log_unit_change")))


@query("I1_price_weekly", "SELECT * FROM c_price")
def _(t):
    return prices(t)


@query("I2_pack_ladder", "SELECT * FROM c_ladder")
def _(t):
    return pr.pack_ladder(prices(t))


@query("C6_ladder_join", f"""
SELECT {MARKET}, focal_upc, partner_upc, count(*) AS weeks FROM c_ladder GROUP BY ALL
""")
def _(t):
    return pr.pack_ladder(prices(t)).groupBy(*MARKET_KEYS, "focal_upc", "partner_upc").agg(
        F.count(F.lit(1)).alias("weeks"))


@query("I3_competitive_price", "SELECT * FROM c_comp")
def _(t):
    return competitive(t)


@query("C7_competitive_join", """
SELECT competitor_brand, count(DISTINCT focal_upc) AS focal_upcs, count(*) AS rows_
FROM c_comp GROUP BY 1
""")
def _(t):
    return competitive(t).groupBy("competitor_brand").agg(
        F.count_distinct("focal_upc").alias("focal_upcs"), F.count(F.lit(1)).alias("rows_"))


@query("I4_price_windows", "SELECT * FROM c_pwin")
def _(t):
    return pr.price_windows(prices(t))


@query("C8_range_join_windows", f"""
SELECT week, {SERIES}, pre_13w_weeks_count, post_13w_weeks_count, pre_13w_base_units,
  post_13w_base_units FROM c_pwin4
""")
def _(t):
    return pr.price_windows(prices(t), 4).select(
        "week", *SERIES_KEYS, "pre_13w_weeks_count", "post_13w_weeks_count", "pre_13w_base_units",
        "post_13w_base_units")


@query("D10_category_norms", "SELECT * FROM c_norms")
def _(t):
    return pr.category_norms(t.filtered, t.cfg)


def _norm_branch(scope, ch, ac):
    return f"""SELECT '{scope}' AS norm_scope, {ch} AS channel_outlet, {ac} AS retail_account,
    pack_count, count(DISTINCT competitor_upc) AS norm_sku_count,
    median(price) AS norm_median_price, median(velocity) AS norm_median_velocity
  FROM item GROUP BY ALL HAVING count(DISTINCT competitor_upc) >= 3"""


NORMS_SQL = f"""
WITH item AS (
  SELECT {MARKET}, competitor_upc, competitor_pack_count AS pack_count,
    avg(competitor_price_per_unit) AS price, avg(competitor_velocity_spm) AS velocity
  FROM c_comp GROUP BY ALL
), n AS (
  {_norm_branch('account', 'channel_outlet', 'retail_account')}
  UNION ALL {_norm_branch('channel', 'channel_outlet', "'ALL'")}
  UNION ALL {_norm_branch('overall', "'ALL'", "'ALL'")}
), packnorm AS (
  SELECT n.*, CASE WHEN pack_count <> 1 THEN (s - norm_median_price) / s END
      AS step_discount_vs_1ct,
    CASE WHEN pack_count = 1 THEN '1ct' WHEN pack_count <= 5 THEN '4pk' WHEN pack_count <= 9
      THEN '8pk' ELSE '12pk' END AS pack_size_bucket
  FROM n LEFT JOIN (SELECT norm_scope, channel_outlet, retail_account, norm_median_price AS s
    FROM n WHERE pack_count = 1) one USING (norm_scope, channel_outlet, retail_account)
)
--
"""


@query("D9_pack_norms", NORMS_SQL + "SELECT * FROM packnorm")
def _(t):
    return pr.pack_norms(competitive(t))


@query("I5_step_discount", NORMS_SQL + """
SELECT norm_scope, pack_count, max(step_discount_vs_1ct) AS best_step FROM packnorm GROUP BY ALL
""")
def _(t):
    return pr.pack_norms(competitive(t)).groupBy("norm_scope", "pack_count").agg(
        F.max("step_discount_vs_1ct").alias("best_step"))


@query("I6_norm_fallback", NORMS_SQL.replace("\n--\n", f""", own AS (
  SELECT upc, {MARKET}, max(pack_count) AS pack_count FROM c_price GROUP BY ALL
)
--
SELECT o.*, CASE WHEN a.norm_median_price IS NOT NULL THEN 'account' WHEN c.norm_median_price
    IS NOT NULL THEN 'channel' WHEN v.norm_median_price IS NOT NULL THEN 'overall' END AS norm_scope,
  coalesce(a.norm_median_price, c.norm_median_price, v.norm_median_price) AS norm_median_price,
  coalesce(a.norm_median_velocity, c.norm_median_velocity, v.norm_median_velocity)
    AS norm_median_velocity
FROM own o
LEFT JOIN packnorm a ON a.norm_scope = 'account' AND a.channel_outlet = o.channel_outlet
  AND a.retail_account = o.retail_account AND a.pack_count = o.pack_count
LEFT JOIN packnorm c ON c.norm_scope = 'channel' AND c.channel_outlet = o.channel_outlet
  AND c.pack_count = o.pack_count
LEFT JOIN packnorm v ON v.norm_scope = 'overall' AND v.pack_count = o.pack_count
"""))
def _(t):
    own = prices(t).groupBy(*SERIES_KEYS).agg(F.max("pack_count").alias("pack_count"))
    return pr.norm_lookup(own, pr.pack_norms(competitive(t)))


DRIVER_SQL = f"""
SELECT week, {SERIES}, source_brand, flavor_raw, nfp_protein, nfp_protein_range,
  arp / source_pack_count AS price_per_unit,
  avg_weekly_units_spm / nullif(avg(avg_weekly_units_spm) OVER g, 0) AS velocity_flavor_index,
  CASE WHEN nfp_protein_range LIKE '20%' THEN 'HIGH_PROTEIN_20g_plus'
    WHEN nfp_protein_range LIKE '15%' THEN 'MID_PROTEIN_15_19g'
    WHEN nfp_protein_range LIKE '10%' THEN 'LOW_PROTEIN_10_14g' ELSE 'UNKNOWN' END AS protein_tier,
  pct_stores_selling / nullif(avg(pct_stores_selling) OVER g, 0) AS penetration_flavor_index
FROM c_filtered WHERE arp > 0 AND source_pack_count > 0 AND nfp_protein IS NOT NULL
WINDOW g AS (PARTITION BY {MW}, flavor_raw)
"""


@query("I7_driver_features", DRIVER_SQL)
def _(t):
    return pr.driver_features(t.filtered, t.cfg)


@query("E6_group_index", f"SELECT week, {SERIES}, velocity_flavor_index FROM ({DRIVER_SQL}) q")
def _(t):
    return pr.driver_features(t.filtered, t.cfg).select(
        "week", *SERIES_KEYS, "velocity_flavor_index")


@query("I8_elasticity_frame", f"""
SELECT week, {SERIES}, log_price_change, log_unit_change FROM c_elas WHERE real_price_move
""")
def _(t):
    return pr.elasticity_frame(pr.price_windows(prices(t), 4)).select(
        "week", *SERIES_KEYS, "log_price_change", "log_unit_change")


@query("I9_elasticity_bands", f"""
SELECT week, {SERIES}, implied_elasticity, elasticity_band FROM c_elas
""")
def _(t):
    return rule_elasticity(t).select("week", *SERIES_KEYS, "implied_elasticity", "elasticity_band")


@query("I10_price_scenarios", f"""
WITH s AS (
  SELECT e.*, scenario_name, ch, CASE elasticity_band WHEN 'Highly Elastic' THEN 0.25
    WHEN 'Elastic' THEN 0.20 WHEN 'Moderately Elastic' THEN 0.15 WHEN 'Inelastic' THEN 0.10
    WHEN 'Positive' THEN 0.20 ELSE 0.15 END AS bw,
    greatest(0, pre_13w_velocity_spm * (1 + implied_elasticity * ch)) AS u
  FROM c_elas e, (VALUES ('low', -0.10), ('base', 0.0), ('high', 0.10)) v(scenario_name, ch)
  WHERE implied_elasticity BETWEEN -10 AND 5 AND pre_13w_velocity_spm IS NOT NULL
)
--
SELECT week, {SERIES}, scenario_name, post_13w_avg_price_per_unit * (1 + ch) AS price_input,
  implied_elasticity * ch AS forecast_pct_change, u AS forecast_units,
  u * (1 - bw) AS confidence_band_low, u * (1 + bw) AS confidence_band_high FROM s
""")
def _(t):
    return pr.price_scenarios(rule_elasticity(t))


_EV = ["week", "focal_upc", "focal_description", *MARKET_KEYS, "event_type", "event_label",
       "event_color", "confidence", "trigger_value", "focal_pack_count", "partner_pack_count",
       "partner_description"]


def _ev_sql(kind, label, color, conf, value, source, week="week", upc="upc", desc="description",
            pack="pack_count", ppack="CAST(NULL AS BIGINT)", pdesc="CAST(NULL AS VARCHAR)", tail=""):
    return f"""
SELECT {week} AS week, {upc} AS focal_upc, {desc} AS focal_description, {MARKET},
  '{kind}' AS event_type, {label} AS event_label, '{color}' AS event_color, {conf} AS confidence,
  CAST({value} AS DOUBLE) AS trigger_value, {pack} AS focal_pack_count,
  {ppack} AS partner_pack_count, {pdesc} AS partner_description
FROM {source} {tail}"""


EV_SQL = {
    "I11_ev_price_gap": _ev_sql(
        "COMPETITIVE_PRICE_GAP",
        "'Price gap: ' || fd || ' vs ' || b || ' — gap ' || printf('%.1f', g * 100) || '%'",
        "red", "'High'", "g", f"""(SELECT focal_upc AS fu, focal_description AS fd, {MARKET},
    max(week) AS wk, min(competitor_brand) AS b, avg(price_gap_pct) AS g FROM c_comp
    WHERE competitive_gap_watch_flag = 1 GROUP BY ALL HAVING avg(price_gap_pct) >= 0.09) x""",
        "wk", "fu", "fd", "CAST(NULL AS BIGINT)"),
    "I12_ev_compression": _ev_sql(
        "PACK_LADDER_COMPRESSION",
        "'Pack ladder compression: ' || fd || ' → ' || p || ' per-unit gap below 10%'",
        "blue", "'Medium'", "g", f"""(SELECT focal_upc AS fu, focal_description AS fd, {MARKET},
    max(week) AS wk, min(partner_description) AS p, avg(trade_up_savings_pct) AS g FROM c_ladder
    WHERE ladder_compression_flag = 1 GROUP BY ALL) x""", "wk", "fu", "fd",
        "CAST(NULL AS BIGINT)"),
    "I13_ev_drastic": _ev_sql(
        "DRASTIC_PRICE_CHANGE",
        "'ARP ' || printf('%.1f', abs(pct)) || '% ' || CASE WHEN pct > 0 THEN 'increase' "
        "ELSE 'decrease' END || ' detected (13w window)'",
        "amber", "elasticity_band", "pct",
        "(SELECT *, round(log_price_change * 100, 1) AS pct FROM c_elas) x",
        tail="WHERE abs(post_13w_avg_price_per_unit - pre_13w_avg_price_per_unit) >= 2 "
             "OR abs(log_price_change) >= ln(1.15)"),
    "I14_ev_breakpoint": _ev_sql(
        "PROMO_RESPONSE_BREAKPOINT", "'Significant price shift during promo-confounded window'",
        "amber", "elasticity_band", "round(log_price_change * 100, 1)", "c_elas",
        tail="WHERE promo_confounded = 1 AND abs(log_price_change) >= ln(1.15) "
             "AND elasticity_band <> 'Positive'"),
    "I15_ev_new_item": _ev_sql(
        "NEW_ITEM_PRICE_BASELINE",
        "'Week ' || CAST(weeks_since_launch AS VARCHAR) || ' — price baseline window open'",
        "amber", "coalesce(ramp_confidence, 'Medium')", "arp",
        f"""(SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rn
    FROM c_ramp16 WHERE weeks_since_launch BETWEEN 8 AND 12) x""", tail="WHERE rn = 1"),
    "I16_ev_norm_gap": _ev_sql(
        "PACK_NORM_GAP",
        "'Own price ' || printf('%.1f', (ix - 1) * 100) || '% above ' "
        "|| CAST(pack_count AS VARCHAR) || '-pack norm'",
        "amber", "'Medium'", "round(ix, 3)",
        f"""(SELECT p.*, p.price_per_unit / n.nm AS ix FROM (SELECT *, row_number() OVER
      (PARTITION BY {SERIES} ORDER BY week DESC) AS rn FROM c_price) p
    JOIN (SELECT {MARKET}, pack_count, arg_max(norm_avg_price_per_unit, week) AS nm FROM c_norms
      GROUP BY ALL) n USING ({MARKET}, pack_count) WHERE rn = 1) x""", tail="WHERE ix >= 1.07"),
    "I17_ev_defense": _ev_sql(
        "PRICE_DEFENSE_OPPORTUNITY",
        "'Own ' || CAST(focal_pack_count AS VARCHAR) || '-ct priced ' || printf('%.1f', abs(gp)) "
        "|| '% ' || CASE WHEN gp < 0 THEN 'below' ELSE 'above' END || ' ' "
        "|| competitor_description || ' ' || CAST(competitor_pack_count AS VARCHAR) "
        "|| '-ct per unit'",
        "amber", "'Medium'", "gp",
        "(SELECT *, round(price_gap_pct * 100, 1) AS gp FROM c_comp) x", "week", "focal_upc",
        "focal_description", "focal_pack_count", "competitor_pack_count", "competitor_description",
        tail="WHERE week = (SELECT max(week) FROM c_comp) AND abs(price_gap_pct) >= 0.09 "
             "AND focal_pack_count = competitor_pack_count"),
    "I18_ev_overlap": _ev_sql(
        "PRICE_DONOR_OVERLAP",
        "'Per-unit price gap with ' || competitor_description || ' ' "
        "|| CAST(competitor_pack_count AS VARCHAR) || '-ct compressed to ' "
        "|| printf('%.1f', abs(price_gap_pct * 100)) || '%'",
        "amber", "'Medium'", "price_gap_pct", "c_comp", "week", "focal_upc", "focal_description",
        "focal_pack_count", "competitor_pack_count", "competitor_description",
        tail="WHERE week = (SELECT max(week) FROM c_comp) "
             "AND flavor_relationship = 'SAME_FLAVOR' "
             "AND competitor_pack_count > focal_pack_count "
             "AND 1 - competitor_price_per_unit / focal_price_per_unit < 0.10"),
}


def detectors(t):
    scored = rule_elasticity(t)
    gaps = pr.brand_gaps(competitive(t))
    return {
        "I11_ev_price_gap": lambda: pr.ev_price_gap(competitive(t)),
        "I12_ev_compression": lambda: pr.ev_compression(pr.pack_ladder(prices(t))),
        "I13_ev_drastic": lambda: pr.ev_drastic(scored),
        "I14_ev_breakpoint": lambda: pr.ev_breakpoint(scored),
        "I15_ev_new_item": lambda: pr.ev_new_item(la.ramp_monitor(t.enriched, t.cfg)),
        "I16_ev_norm_gap": lambda: pr.ev_norm_gap(
            prices(t), pr.category_norms(t.filtered, t.cfg)),
        "I17_ev_defense": lambda: pr.ev_defense(gaps),
        "I18_ev_overlap": lambda: pr.ev_overlap(gaps),
    }


for _name, _sql in EV_SQL.items():
    query(_name, _sql)(lambda t, n=_name: detectors(t)[n]().select(*_EV))


@query("F5_union_events", "SELECT event_type, count(*) AS n FROM (" + "\nUNION ALL ".join(
    EV_SQL.values()) + ") u GROUP BY 1")
def _(t):
    return pr.union_events(*[d() for d in detectors(t).values()]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("C14_latest_norm_join", f"""
SELECT p.upc, p.channel_outlet, p.retail_account, p.geography_raw,
  p.price_per_unit / n.nm AS price_index
FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rn FROM c_price) p
JOIN (SELECT {MARKET}, pack_count, arg_max(norm_avg_price_per_unit, week) AS nm FROM c_norms
  GROUP BY ALL) n USING ({MARKET}, pack_count) WHERE rn = 1
""")
def _(t):
    from shelfwise.functions.scalar import safe_div
    from shelfwise.operators.windows import tail_n

    newest = pr.category_norms(t.filtered, t.cfg).groupBy(*MARKET_KEYS, "pack_count").agg(
        F.max_by("norm_avg_price_per_unit", "week").alias("_n"))
    return tail_n(prices(t), 1).join(newest, [*MARKET_KEYS, "pack_count"]).select(
        *SERIES_KEYS, safe_div("price_per_unit", "_n").alias("price_index"))


# ---------------------------------------------------------------- promotion


@query("I19_promo_events", "SELECT * EXCLUDE (d) FROM c_promo")
def _(t):
    return pr.promo_events(t.filtered, t.cfg)


@query("D13_weekly_rollup", """
SELECT CAST(date_trunc('week', week) AS DATE) AS week, channel_outlet, sum(units) AS units,
  sum(base_units) AS base_units, avg(arp) AS arp FROM c_filtered GROUP BY ALL
""")
def _(t):
    return t.filtered.groupBy(
        F.to_date(F.date_trunc("week", "week")).alias("week"), "channel_outlet").agg(
        F.sum("units").alias("units"), F.sum("base_units").alias("base_units"),
        F.avg("arp").alias("arp"))


LIFT_SQL = """
WITH mech AS (
  SELECT retail_account, channel_outlet, upc, discount_bucket, dominant_mechanic,
    row_number() OVER (PARTITION BY retail_account, channel_outlet, upc, discount_bucket
      ORDER BY n DESC, dominant_mechanic) AS rn
  FROM (SELECT retail_account, channel_outlet, upc, discount_bucket, dominant_mechanic,
    count(*) AS n FROM c_promo GROUP BY ALL) q
), lift AS (
  SELECT p.retail_account, p.channel_outlet, p.upc, p.discount_bucket, p.discount_label,
    count(*) AS n_promo_weeks, avg(lift_rate_obs) AS lift_rate_mean,
    quantile_cont(lift_rate_obs, 0.5) AS lift_rate_median,
    quantile_cont(lift_rate_obs, 0.25) AS lift_rate_p25,
    quantile_cont(lift_rate_obs, 0.75) AS lift_rate_p75, avg(discount_depth) AS discount_avg,
    avg(arp) AS arp_avg, max(week) AS most_recent_promo,
    min(m.dominant_mechanic) AS dominant_mechanic
  FROM c_promo p JOIN (SELECT * FROM mech WHERE rn = 1) m USING
    (retail_account, channel_outlet, upc, discount_bucket)
  GROUP BY ALL
)
--
"""


@query("I20_promo_lift_summary", LIFT_SQL + """
SELECT *, lift_rate_mean AS best_lift_estimate, 'observational' AS estimate_source FROM lift
""")
def _(t):
    return pr.promo_lift_summary(pr.promo_events(t.filtered, t.cfg))


@query("D7_lift_percentiles", LIFT_SQL + """
SELECT retail_account, channel_outlet, upc, discount_bucket, lift_rate_median, lift_rate_p25,
  lift_rate_p75, dominant_mechanic FROM lift
""")
def _(t):
    return pr.promo_lift_summary(pr.promo_events(t.filtered, t.cfg)).select(
        "retail_account", "channel_outlet", "upc", "discount_bucket", "lift_rate_median",
        "lift_rate_p25", "lift_rate_p75", "dominant_mechanic")


@query("D15_bucket_lists", LIFT_SQL + """
SELECT retail_account, channel_outlet, upc, count(*) AS n_buckets,
  string_agg(discount_bucket, ',' ORDER BY discount_bucket) AS buckets,
  sum(n_promo_weeks) AS n_promo_weeks FROM lift GROUP BY ALL
""")
def _(t):
    out = pr.bucket_lists(pr.promo_lift_summary(pr.promo_events(t.filtered, t.cfg)))
    return out.select(
        "retail_account", "channel_outlet", "upc", F.size("buckets").alias("n_buckets"),
        F.array_join(F.col("buckets.bucket"), ",").alias("buckets"),
        F.aggregate(F.col("buckets.n"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias(
            "n_promo_weeks"))


@query("I21_account_elasticity")
def _(t):
    return pr.account_elasticity(prices(t))


@query("I22_refutations")
def _(t):
    return pr.refute(prices(t))


_Z = (*refute.CONFOUNDERS, "zr")


def _refute_sql(replicates=200, seed=42):
    """The draws row by row: every replicate's rows in full, then one regression per replicate."""
    draws = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(refute.draw_constants(replicates, seed)))
    weight = " ".join(f"WHEN v / {refute.PRIME}.0 <= {t!r} THEN {n}" for n, t in enumerate(refute.poisson_steps()))
    cols = ["x", *_Z, "y"]
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = ", ".join(f"sum(wt * {cols[i]} * {cols[j]}) - sum(wt * {cols[i]}) * sum(wt * {cols[j]}) / sum(wt) AS s{i}_{j}"
                     for i, j in cells)
    p, steps, last = len(cols) - 1, [], "g"
    for k in range(p - 1, 0, -1):
        left = [*range(k), p]
        row = ", ".join(
            f"CASE WHEN s{k}_{k} > 1e-9 THEN s{i}_{j} - s{min(i, k)}_{max(i, k)} * s{min(k, j)}_{max(k, j)} / s{k}_{k} "
            f"ELSE s{i}_{j} END AS s{i}_{j}" for i in left for j in left if i <= j)
        steps.append(f"g{k} AS (SELECT variant, r, n, {row} FROM {last})")
        last = f"g{k}"
    z = ", ".join(refute.CONFOUNDERS)
    return f"""
WITH q AS (
  SELECT *, abs(arp - lag(arp) OVER o) AS mv, lag(arp) OVER o AS bf FROM c_price
  WINDOW o AS (PARTITION BY {SERIES} ORDER BY week)
), b AS (
  SELECT {SERIES}, week, ln(base_units) AS y, ln(arp) AS x, CAST(tdp AS DOUBLE) AS tdp,
    CAST(datediff('day', first_week_selling, week) // 7 AS DOUBLE) AS weeks_since_launch,
    CAST(pack_count AS DOUBLE) AS pack_count, CAST(week_of_year AS DOUBLE) AS week_of_year,
    CAST('0x' || substr(md5(concat_ws('|', {SERIES}, CAST(week AS VARCHAR))), 1, 7) AS BIGINT) AS h
  FROM q WHERE (mv >= 0.05 OR mv / nullif(bf, 0) >= 0.025) AND base_units > 0 AND arp > 0
), rw AS (SELECT * FROM b WHERE y + x + tdp + weeks_since_launch + pack_count + week_of_year IS NOT NULL),
d AS (SELECT rw.*, r, (h * da + db) % {refute.PRIME} AS v FROM rw, (VALUES {draws}) t(r, da, db)),
o1 AS (SELECT *, row_number() OVER (PARTITION BY {SERIES}, r ORDER BY week) AS i,
  row_number() OVER (PARTITION BY {SERIES}, r ORDER BY v, week) AS k FROM d),
al AS (
  SELECT 'estimate' AS variant, 0 AS r, 1.0 AS wt, x, {z}, 0.0 AS zr, y FROM rw
  UNION ALL SELECT 'placebo', r, 1.0, o.x, {", ".join("o1." + c for c in refute.CONFOUNDERS)}, 0.0, o1.y
    FROM o1 JOIN (SELECT {SERIES}, r, k, x FROM o1) o USING ({SERIES}, r) WHERE o1.i = o.k
  UNION ALL SELECT 'random_cause', r, 1.0, x, {z}, v / {refute.PRIME}.0, y FROM d
  UNION ALL SELECT 'subset_80', r, 1.0, x, {z}, 0.0, y FROM d WHERE v / {refute.PRIME}.0 < {refute.SHARE}
  UNION ALL SELECT 'bootstrap', r, CASE {weight} ELSE {len(refute.poisson_steps())} END, x, {z}, 0.0, y FROM d
), al2 AS (SELECT variant, r, CAST(wt AS DOUBLE) AS wt, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)} FROM al),
g AS (SELECT variant, r, sum(wt) AS n, {sums} FROM al2 GROUP BY 1, 2 HAVING sum(wt) >= 20),
{", ".join(steps)},
sl AS MATERIALIZED (SELECT variant, r, n, CASE WHEN s0_0 > 1e-9 THEN s0_{p} / s0_0 END AS coef FROM {last}),
e AS (SELECT coef AS estimate, n AS rws FROM sl WHERE variant = 'estimate'),
m AS (SELECT *, CASE WHEN variant = 'placebo' THEN 0 ELSE estimate END AS target FROM sl, e
  WHERE variant <> 'estimate' AND coef IS NOT NULL)
--
SELECT variant, estimate, CAST(rws AS BIGINT) AS rows, count(*) AS replicates, avg(coef) AS mean_effect,
  stddev_samp(coef) AS sd_effect, least(2 * least((count(*) FILTER (WHERE coef <= target) + 1) / (count(*) + 1),
    (count(*) FILTER (WHERE coef >= target) + 1) / (count(*) + 1)), 1.0) AS p_value,
  CASE WHEN variant = 'placebo' THEN (count(*) FILTER (WHERE abs(coef) >= abs(estimate)) + 1) / (count(*) + 1) END AS p_effect
FROM m GROUP BY 1, 2, 3
"""


@query("I22_refutation_pvalues", _refute_sql())
def _(t):
    return refute.refute_replicated(prices(t))


@query("I24_validate_events", """
WITH x AS (SELECT predicted_log_unit_change AS p, log_unit_change AS o, promo_confounded
  FROM c_elas WHERE real_price_move),
y AS (SELECT 'all' AS subset, p, o FROM x UNION ALL
  SELECT 'clean', p, o FROM x WHERE promo_confounded = 0)
--
SELECT subset, count(*) AS n_events, avg(CASE WHEN sign(p) = sign(o) THEN 1.0 ELSE 0.0 END)
    AS direction_accuracy, avg(abs(exp(p) - exp(o))) AS mae_pct, avg(abs(exp(o) - 1)) AS naive_mae_pct,
  corr(p, o) AS r, avg(o - p) AS mean_signed_error FROM y GROUP BY 1
""")
def _(t):
    return pr.validate_price_events(rule_elasticity(t))


@query("I25_magnitude_audit", """
WITH e AS (SELECT channel_outlet, predicted_log_unit_change - log_unit_change AS err FROM c_elas),
q AS (SELECT quantile_cont(err, 0.01) AS lo, quantile_cont(err, 0.99) AS hi FROM e)
--
SELECT channel_outlet, count(*) AS n, avg(err) AS mean_error,
  avg(CASE WHEN err > 0 THEN 1.0 ELSE 0.0 END) AS share_over,
  avg(err) / (stddev_samp(err) / sqrt(count(*))) AS t_stat
FROM e, q WHERE err BETWEEN lo AND hi GROUP BY 1
""")
def _(t):
    return pr.magnitude_audit(rule_elasticity(t), "predicted_log_unit_change", "log_unit_change",
                              "channel_outlet")


@query("I26_promo_gap", f"""
SELECT week, {SERIES}, units - base_units AS promo_gap_units,
  (units - base_units) / nullif(units, 0) AS promo_gap_share FROM c_filtered
""")
def _(t):
    return pr.promo_gap(t.filtered.withColumnRenamed("units", "total_units"))


@query("D20_benchmark_delta", f"""
SELECT week, {SERIES}, implied_elasticity AS value, bench_min, bench_max, bench_avg,
  implied_elasticity - bench_avg AS delta_vs_account
FROM c_elas LEFT JOIN (SELECT retail_account, min(implied_elasticity) AS bench_min,
    max(implied_elasticity) AS bench_max, avg(implied_elasticity) AS bench_avg FROM c_elas
  WHERE implied_elasticity < 0 AND abs(implied_elasticity) <= 50 GROUP BY 1) b
  USING (retail_account)
""")
def _(t):
    return pr.benchmark_delta(rule_elasticity(t))


@query("F3_one_event_per_series", f"""
SELECT {SERIES}, week, price_pct_chg FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES}
  ORDER BY abs(price_pct_chg) DESC, week) AS rn FROM c_pwin4) x WHERE rn = 1
""")
def _(t):
    from shelfwise.operators.ranking import one_per_series

    return one_per_series(pr.price_windows(prices(t), 4)).select(
        *SERIES_KEYS, "week", "price_pct_chg")
