"""Queries of groups K and M and of the model-based forecasts. Most are checked by rows only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import causal as ca
from shelfwise.operators import forecast as fo
from shelfwise.operators import models as mo
from shelfwise.operators import price as pr
from shelfwise.operators import transfer as tr
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored
from shelfwise.functions.scalar import weeks_between
from shelfwise.plans.price import prices
from shelfwise.plans.registry import query
from shelfwise.plans.transfer import pairs, rates
from shelfwise.scale import durable
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"


def own(t):
    """Own rows, written once: model fitting reads its input several times."""
    return durable(own_scored(t.enriched, t.cfg).select(
        "week", *SERIES_KEYS, "base_units", "arp", "tdp", "pack_count", "promo_weeks",
        weeks_between("week", "first_week_selling").alias("weeks_since_launch")))


def pair_table(t):
    return durable(pairs(t))


def weekly_units(t):
    return durable(t.filtered.select("week", *SERIES_KEYS, "base_units", F.col("source_pack_count").alias("pack_count")))


# ---------------------------------------------------------------- K


@query("K1_transfer_classifier", trim_launch=False)
def _(t):
    frame = pair_table(t)
    model, _ = mo.fit_transfer(frame)
    return tr.score_bands(mo.score_pairs(model, frame)).select(
        "focal_upc", "donor_upc", *MARKET_KEYS, "transfer_prob", "transfer_status", "transfer_confidence")


@query("K2_donor_ranker", trim_launch=False)
def _(t):
    frame = tr.ranking_frame(pair_table(t))
    return mo.ndcg(mo.rank_scores(mo.fit_ranker(frame), frame))


@query("K3_event_classifier", trim_launch=False)
def _(t):
    frame = tr.event_label(pair_table(t))
    return mo.score_events(mo.fit_event(frame), frame).select(
        "focal_upc", "donor_upc", *MARKET_KEYS, "event_significant", "event_prob")


def fitted_elasticity(t):
    frame = durable(pr.elasticity_frame(pr.price_windows(prices(t), 4), guard=False))
    return pr.elasticity_score(mo.score_price(mo.fit_price(frame), frame))


@query("K4_price_response")
def _(t):
    return fitted_elasticity(t).groupBy("elasticity_band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("implied_elasticity").alias("avg_elasticity"))


_LIN = ["log_price_change", "tdp_pct_chg", "pack_count"]


@query("K5_linear_models", f"""
SELECT 'ols' AS model, count(*) AS n, avg(log_unit_change) AS mean_actual, avg(log_unit_change) AS mean_pred FROM c_elas
UNION ALL SELECT 'ridge', count(*), avg(log_unit_change), avg(log_unit_change) FROM c_elas
UNION ALL SELECT 'lasso', count(*), avg(log_unit_change), avg(log_unit_change) FROM c_elas
""")
def _(t):
    # a fit with intercept reproduces the mean of its target, whatever the penalty
    frame = durable(pr.elasticity_frame(pr.price_windows(prices(t), 4), guard=False))
    out = None
    for name, alpha, l1 in (("ols", 0.0, 0.0), ("ridge", 0.1, 0.0), ("lasso", 0.01, 1.0)):
        p = mo.predict_linear(mo.fit_linear(frame, _LIN, "log_unit_change", alpha, l1), frame, _LIN)
        row = p.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
                    F.avg("log_unit_change").alias("mean_actual"), F.avg("prediction").alias("mean_pred"))
        out = row if out is None else out.unionByName(row)
    return out


@query("K6_top_drivers", trim_launch=False)
def _(t):
    frame = pair_table(t)
    model, _ = mo.fit_transfer(frame)
    return mo.top_drivers(frame, model).select("focal_upc", "donor_upc", *MARKET_KEYS, "margin", "drivers")


@query("K7_importance", trim_launch=False)
def _(t):
    frame = pair_table(t)
    return mo.importance(mo.fit_transfer(frame)[0], frame)


@query("K8_ablation")
def _(t):
    sets = {"all": mo.PANEL_FEATURES, "no_season": ["lag1", "lag4", "lag13", "lag52"], "short": ["lag1", "lag4"]}
    return mo.ablate(weekly_units(t), sets, "all")


@query("K9_grid_cv")
def _(t):
    cuts = [dt.date(1999, 7, 5), dt.date(2000, 1, 3), dt.date(2000, 7, 3)]
    return mo.grid_cv(weekly_units(t), (0.001, 0.01, 0.1), (0.0, 0.5, 1.0), cuts)


@query("K10_segment_effect")
def _(t):
    p = prices(t)
    before = F.lag("arp").over(w.series())
    rows = p.select(
        "week", *SERIES_KEYS, (F.col("arp") / before - 1).alias("price_move"),
        (F.col("base_units") / F.nullif(F.lag("base_units").over(w.series()), F.lit(0)) - 1).alias("unit_move"),
        "tdp", "week_of_year", "pack_count", F.col("promo_confounded").cast("double").alias("promo"))
    rows = rows.where((F.abs("price_move") > 0.005) & (F.abs("price_move") < 0.5) & (F.abs("unit_move") < 3))
    return mo.segment_effect(durable(rows), "pack_count", "unit_move", "price_move", ["tdp", "week_of_year", "promo"])


@query("I23_ipw")
def _(t):
    return mo.ipw(durable(pr.response_rows(prices(t))), "y", "x", list(pr.CONFOUNDERS))


def held_out_quantiles(t):
    """Bands from one half of the held-out rows, on the other."""
    panel = weekly_units(t)
    model, offsets = mo.fit_quantiles(panel, share=0.5)
    return mo.quantile_predictions(model, durable(offsets), mo.unseen_rows(panel, 0.5))


@query("J9_quantile_model")
def _(t):
    return held_out_quantiles(t).select(
        "week", *SERIES_KEYS, "actual", "low", "base", "high",
        F.col("actual").between(F.col("low"), F.col("high")).alias("covered"))


@query("J9_quantile_quality", f"""
WITH lagged AS (
  SELECT week, {SERIES}, base_units, lag(base_units) OVER (PARTITION BY {SERIES} ORDER BY week) AS l1 FROM c_filtered
), held AS (
  SELECT * FROM lagged WHERE l1 IS NOT NULL AND week > (SELECT max(week) FROM lagged WHERE l1 IS NOT NULL) - 91
    AND CAST('0x' || substr(md5(concat_ws('|', upc, channel_outlet, retail_account, geography_raw, CAST(week AS VARCHAR)) || 'bands'), 1, 8) AS BIGINT)
      / 4294967296.0 >= 0.5
)
--
SELECT channel_outlet, count(*) AS n, sum(base_units) AS actual_units, TRUE AS in_order, TRUE AS share_adds_up FROM held GROUP BY 1
""")
def _(t):
    # the scores are beyond SQL; rows, actuals and what must hold of every band are not
    p = held_out_quantiles(t)
    below, inside, above = (F.sum(c.cast("int")) for c in (
        F.col("actual") < F.col("low"), F.col("actual").between(F.col("low"), F.col("high")), F.col("actual") > F.col("high")))
    return p.groupBy("channel_outlet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").alias("actual_units"),
        F.bool_and((F.col("low") <= F.col("base")) & (F.col("base") <= F.col("high"))).alias("in_order"),
        (below + inside + above == F.count(F.lit(1))).alias("share_adds_up"))


@query("J11_recursive_model")
def _(t):
    panel = own(t)
    model, offsets = mo.fit_quantiles(panel)
    return fo.recursive_model_forecast(
        panel, mo.step_predictor(model, durable(offsets)), seasonal=durable(fo.seasonal_index(panel)))


@query("J12_rate_forecast")
def _(t):
    r = durable(rates(t).withColumnRenamed("focal_upc", "upc"))
    lags = (1, 4, 8)
    model, offsets = mo.fit_quantiles(r, target="cannibalization_rate", lags=lags, log=False)
    f = fo.recursive_model_forecast(
        r, mo.step_predictor(model, durable(offsets), log=False, ceiling=1.0), target="cannibalization_rate",
        lags=lags, clip=(0.0, 1.0), blend=0.0)
    return f.select("week", *SERIES_KEYS, "forecast_week_number", *[
        F.col(f"forecast_units_{q}").alias(f"forecast_rate_{q}") for q in ("low", "base", "high")])


# ---------------------------------------------------------------- M


def events(t):
    return ca.price_event_windows(pr.price_windows(prices(t), 4))


def control_pairs(t, rules=None):
    return ca.control_pairs(own_scored(t.enriched, t.cfg), events(t), rules=rules)


EVENT_SQL = f"""
ev AS (
  SELECT {SERIES}, week AS event_week, price_pct_chg, pre_13w_weeks_count AS pre_w, post_13w_weeks_count AS post_w
  FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY abs(price_pct_chg) DESC, week) AS rn
    FROM c_pwin4 WHERE abs(price_pct_chg) >= 0.05) q WHERE rn = 1
), bounds AS (
  SELECT *, event_week - CAST(7 * post_w AS INTEGER) AS post_start,
    event_week - CAST(7 * (post_w + pre_w + 1) AS INTEGER) AS pre_start FROM ev
), cand AS (
  SELECT b.*, c.retail_account AS control_account, c.geography_raw AS control_geography,
    c.week AS cw, c.base_units AS cu, c.arp AS cp, f.base_units AS fu
  FROM bounds b JOIN c_own c ON c.upc = b.upc AND c.channel_outlet = b.channel_outlet
    AND c.retail_account <> b.retail_account AND c.week BETWEEN b.pre_start AND b.event_week
  LEFT JOIN c_own f ON f.upc = b.upc AND f.channel_outlet = b.channel_outlet AND f.retail_account = b.retail_account
    AND f.geography_raw = b.geography_raw AND f.week = c.week
), prs AS (
  SELECT {SERIES}, event_week, price_pct_chg, control_account, control_geography,
    CASE WHEN var_pop(cu) FILTER (WHERE pre) > 0 AND var_pop(fu) FILTER (WHERE pre) > 0
      THEN corr(cu, fu) FILTER (WHERE pre) END AS pre_corr,
    abs(arg_max(cp, cw) - arg_min(cp, cw)) / greatest(arg_min(cp, cw), 0.01) AS control_price_drift
  FROM (SELECT *, cw < post_start AND fu IS NOT NULL AS pre FROM cand) q GROUP BY ALL
  HAVING count(*) FILTER (WHERE pre) >= 8 AND count(*) >= 2
)
"""


@query("M1_control_pairs", f"WITH {EVENT_SQL}\n--\nSELECT * FROM prs")
def _(t):
    return control_pairs(t).select(*ca.EVENT_KEYS, "price_pct_chg", "control_account", "control_geography",
                                   "pre_corr", "control_price_drift")


@query("M1_select_controls", f"""
WITH {EVENT_SQL}
--
SELECT {SERIES}, event_week, control_account, rn AS control_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY {SERIES}, event_week ORDER BY pre_corr DESC, control_account, control_geography) AS rn
  FROM prs WHERE pre_corr >= 0.40 AND control_price_drift < 0.05) q WHERE rn <= 3
""")
def _(t):
    return ca.select_controls(control_pairs(t, [ca.BASELINE])).select(*ca.EVENT_KEYS, "control_account", "control_rank")


@query("M2_event_impact")
def _(t):
    return ca.event_impact(control_pairs(t, [ca.BASELINE]))


@query("M3_impact_sensitivity")
def _(t):
    return ca.impact_sensitivity(control_pairs(t, ca.SENSITIVITY))


PRE, CUT, END = dt.date(1999, 1, 4), dt.date(2000, 1, 3), dt.date(2000, 7, 3)
FOCAL = {"upc": "SKU-05", "retail_account": "ACCT-0"}

POOL_SQL = f"""
foc AS (SELECT week, sum(base_units) AS y FROM c_filtered WHERE upc = 'SKU-05' AND retail_account = 'ACCT-0'
  AND week BETWEEN DATE '{PRE}' AND DATE '{END}' GROUP BY 1),
oth AS (SELECT * FROM c_filtered WHERE NOT (upc = 'SKU-05' AND retail_account = 'ACCT-0')
  AND week BETWEEN DATE '{PRE}' AND DATE '{END}'),
st AS (
  SELECT {SERIES}, count(*) AS n_weeks, sum(base_units) AS pre_units, stddev_samp(arp) / avg(arp) AS price_cv,
    CASE WHEN stddev_samp(base_units) > 0 AND stddev_samp(y) > 0 THEN corr(base_units, y) END AS pre_corr
  FROM oth JOIN foc USING (week) WHERE week < DATE '{CUT}' GROUP BY ALL
), ok AS (
  SELECT * FROM st WHERE n_weeks >= floor((SELECT count(*) FROM foc WHERE week < DATE '{CUT}') * 0.75)
    AND pre_units > 0 AND (n_weeks <= 3 OR coalesce(price_cv <= 0.08, TRUE))
), big AS (SELECT {SERIES} FROM ok ORDER BY pre_units DESC, {SERIES} LIMIT 30),
pool AS (
  SELECT * FROM ok WHERE CASE WHEN (SELECT count(*) FROM ok WHERE pre_corr > 0.4) >= 5 THEN pre_corr > 0.4
    ELSE ({SERIES}) IN (SELECT ({SERIES}) FROM big) END
)
"""


def treated(t):
    return ca.treated_panel(t.filtered, FOCAL, PRE, CUT, END)


@query("M4_donor_pool", f"WITH {POOL_SQL}\n--\nSELECT * FROM pool")
def _(t):
    focal, others = treated(t)
    return ca.donor_pool(others, focal)


@query("M5_synthetic_control")
def _(t):
    focal, others = treated(t)
    weights, lift = ca.synthetic_control(others, focal, ca.donor_pool(others, focal))
    return weights.withColumns({c: lift.select(c).scalar() for c in ("pct_lift", "pre_rmse")})


@query("M6_diff_in_diff", f"""
WITH r AS (
  SELECT week, base_units, CASE WHEN retail_account = 'ACCT-0' THEN 1 ELSE 0 END AS t FROM c_filtered
  WHERE upc = 'SKU-05' AND retail_account IN ('ACCT-0', 'ACCT-1') AND week BETWEEN DATE '{PRE}' AND DATE '{END}'
), y AS (
  SELECT t, week, sum(base_units) AS y, CASE WHEN week >= DATE '{CUT}' THEN 1 ELSE 0 END AS p FROM r GROUP BY ALL
), c AS (SELECT t, p, avg(y) AS m, count(*) AS n, var_pop(y) * count(*) AS s FROM y GROUP BY ALL),
a AS (
  SELECT max(m) FILTER (WHERE t = 1 AND p = 0) AS treated_pre, max(m) FILTER (WHERE t = 1 AND p = 1) AS treated_post,
    max(m) FILTER (WHERE t = 0 AND p = 0) AS control_pre, max(m) FILTER (WHERE t = 0 AND p = 1) AS control_post,
    CASE WHEN count(*) = 4 THEN sqrt(sum(s) / (sum(n) - 4) * sum(1.0 / n)) END AS did_se FROM c
), sl AS (
  SELECT regr_slope(y, CAST(datediff('day', DATE '1970-01-05', week) AS DOUBLE) / 7) FILTER (WHERE t = 1 AND p = 0) AS ts,
    regr_slope(y, CAST(datediff('day', DATE '1970-01-05', week) AS DOUBLE) / 7) FILTER (WHERE t = 0 AND p = 0) AS cs FROM y
)
--
SELECT treated_pre, treated_post, control_pre, control_post,
  (treated_post - treated_pre) - (control_post - control_pre) AS did_estimate, did_se, ts AS treated_pre_slope,
  cs AS control_pre_slope,
  100 * ((treated_post - treated_pre) - (control_post - control_pre)) / (treated_pre + 1e-9) AS pct_lift FROM a, sl
""")
def _(t):
    focal, _ = treated(t)
    control, _ = ca.treated_panel(t.filtered, {"upc": "SKU-05", "retail_account": "ACCT-1"}, PRE, CUT, END)
    return ca.did(focal, control).drop("did_pvalue")


def _overview_sql(name, cond):
    return f"""SELECT '{name}' AS series, avg(u) FILTER (WHERE week < DATE '{CUT}') AS pre_units,
  avg(p) FILTER (WHERE week < DATE '{CUT}') AS pre_price, avg(u) FILTER (WHERE week >= DATE '{CUT}') AS post_units,
  avg(p) FILTER (WHERE week >= DATE '{CUT}') AS post_price,
  100 * (avg(u) FILTER (WHERE week >= DATE '{CUT}') / avg(u) FILTER (WHERE week < DATE '{CUT}') - 1) AS units_change_pct
FROM (SELECT week, sum(base_units) AS u, avg(arp) AS p FROM c_filtered WHERE {cond}
  AND week BETWEEN DATE '{PRE}' AND DATE '{END}' GROUP BY 1) q"""


@query("M7_event_overview", _overview_sql("focal", "upc = 'SKU-05' AND retail_account = 'ACCT-0'") + " UNION ALL "
       + _overview_sql("other_account", "upc = 'SKU-05' AND retail_account = 'ACCT-1'") + " UNION ALL "
       + _overview_sql("sibling", "upc = 'SKU-06' AND retail_account = 'ACCT-0'"))
def _(t):
    groups = {"focal": FOCAL, "other_account": {"upc": "SKU-05", "retail_account": "ACCT-1"},
              "sibling": {"upc": "SKU-06", "retail_account": "ACCT-0"}}
    return ca.event_overview(t.filtered, groups, PRE, CUT, END)
