"""Queries of group L."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.scalar import weeks_between
from shelfwise.operators import evaluate as ev
from shelfwise.operators import panel as pa
from shelfwise.operators import ranking as ra
from shelfwise.operators import refit
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored
from shelfwise.plans.panel import flat_forecast
from shelfwise.plans.price import rule_elasticity
from shelfwise.plans.registry import query
from shelfwise.schema import SERIES_KEYS

SERIES = "upc, channel_outlet, retail_account, geography_raw"
CUTS = [dt.date(1998, 1, 5), dt.date(1999, 1, 4), dt.date(2000, 1, 3), dt.date(2000, 10, 2), dt.date(2001, 6, 4)]
_CUTS_SQL = ", ".join(f"(DATE '{d}')" for d in CUTS)


def naive_rows(t):
    """Own rows with a one-row-ahead prediction: the mean of the four rows before."""
    return own_scored(t.enriched, t.cfg).withColumn("pred", w.rolling_prior("base_units", 4, 4)).withColumn(
        "actual", F.col("base_units")).withColumn(
        "weeks_since_launch", weeks_between("week", "first_week_selling"))


NAIVE = f"""
naive AS (
  SELECT *, base_units AS actual, datediff('day', first_week_selling, week) // 7 AS wsl,
    CASE WHEN count(base_units) OVER p >= 4 THEN avg(base_units) OVER p END AS pred FROM c_own
  WINDOW p AS (PARTITION BY {SERIES} ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
)
"""


@query("L1_forecast_metrics", f"""
WITH {NAIVE}
--
SELECT upc, channel_outlet, count(*) AS n, 100 * sum(abs(actual - pred)) / nullif(sum(abs(actual)), 0) AS wmape,
  100 * avg(CASE WHEN actual >= 1 THEN least(abs(actual - pred) / actual, 5) END) AS mape_safe,
  100 * avg(CASE WHEN actual + pred > 0 THEN abs(actual - pred) / ((abs(actual) + abs(pred)) / 2) END) AS smape,
  sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
  100 * sum(pred - actual) / nullif(sum(actual), 0) AS bias_pct
FROM naive WHERE pred IS NOT NULL GROUP BY ALL
""")
def _(t):
    return ev.forecast_metrics(naive_rows(t), ["upc", "channel_outlet"])


@query("L2_qualified_series", f"""
SELECT {SERIES}, count(*) AS n FROM c_filtered GROUP BY ALL
HAVING count(*) FILTER (WHERE week < DATE '2000-01-03') >= 52
  AND count(*) FILTER (WHERE week >= DATE '2000-01-03') >= 13
""")
def _(t):
    return ra.qualify_series(t.filtered, dt.date(2000, 1, 3), 52, 13).groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n"))


CV = f"""
rws AS (SELECT week, {SERIES}, base_units AS y, cutpoint FROM c_filtered, (VALUES {_CUTS_SQL}) v(cutpoint)),
tr AS (
  SELECT {SERIES}, cutpoint, count(*) AS n_train, avg(y) FILTER (WHERE rn <= 13) AS pred,
    max(y) FILTER (WHERE rn = 1) AS naive
  FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES}, cutpoint ORDER BY week DESC) AS rn
    FROM rws WHERE week < cutpoint - 56) q GROUP BY ALL HAVING count(*) >= 52
), cv AS (
  SELECT {SERIES}, cutpoint, count(*) AS n_test_rows, sum(y) AS test_units,
    100 * sum(abs(y - pred)) / sum(abs(y)) AS wmape, 100 * sum(abs(y - naive)) / sum(abs(y)) AS naive_wmape
  FROM rws JOIN tr USING ({SERIES}, cutpoint) WHERE week >= cutpoint AND week < cutpoint + 91
  GROUP BY ALL HAVING count(*) >= 8 AND sum(abs(y)) > 0
)
"""


def cv(t):
    return ev.rolling_cv(t.filtered, CUTS, min_test=8)


@query("L3_rolling_cv", f"WITH {CV}\n--\nSELECT * FROM cv")
def _(t):
    return cv(t)


@query("L4_cv_summary", f"""
WITH {CV}
--
SELECT cutpoint, count(*) AS n_series, avg(wmape) AS mean_wmape, quantile_cont(wmape, 0.25) AS p25_wmape,
  quantile_cont(wmape, 0.5) AS median_wmape, quantile_cont(wmape, 0.75) AS p75_wmape,
  quantile_cont(naive_wmape, 0.5) AS naive_median,
  quantile_cont(naive_wmape, 0.5) - quantile_cont(wmape, 0.5) AS gap_vs_naive FROM cv GROUP BY 1
""")
def _(t):
    return ev.summarise_cv(cv(t))


def _roll_sql(name, lag, span):
    return f"""SELECT cutpoint, '{name}' AS model, count(*) AS n, 100 * sum(abs(y - pred)) / sum(abs(y)) AS wmape
FROM rws JOIN (SELECT {SERIES}, cutpoint, avg(y) AS pred FROM (SELECT *, row_number() OVER
    (PARTITION BY {SERIES}, cutpoint ORDER BY week DESC) AS rn FROM rws WHERE week < cutpoint - {7 * lag}) q
  WHERE rn <= {span} GROUP BY ALL) m USING ({SERIES}, cutpoint)
WHERE week >= cutpoint AND week < cutpoint + 91 GROUP BY ALL"""


@query("L5_rollforward", f"""
WITH rws AS (SELECT week, {SERIES}, base_units AS y, cutpoint FROM c_filtered, (VALUES {_CUTS_SQL}) v(cutpoint))
--
{_roll_sql('retrained', 0, 13)} UNION ALL {_roll_sql('stale', 13, 13)} UNION ALL {_roll_sql('ma4', 0, 4)}
""")
def _(t):
    return ev.rollforward(t.filtered, CUTS)


_P = range(len(refit.TERMS))
_X = ["CAST(1 AS DOUBLE)", "lag(y, 1) OVER p", "avg(y) OVER (p ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)", "lag(y, 13) OVER p",
      "sin(dayofyear(week) * (2 * pi() / 365.25))", "cos(dayofyear(week) * (2 * pi() / 365.25))"]
_FIT_SUMS = [(f"a{i}{j}", f"x{i} * x{j}") for i, j in refit.PAIRS] + [(f"b{i}", f"x{i} * y") for i in _P] + [
    ("yy", "y * y"), ("n", "CAST(1 AS DOUBLE)")]


def _cell(a: str, i: int, j: int) -> str:
    return f"{a}{min(i, j)}{max(i, j)}"


def _fit_sums_sql(cuts) -> str:
    """Sums of the training weeks (t..) and the gap (v..) per cutpoint."""
    values = ", ".join(f"(DATE '{d}')" for d in cuts)
    parts = ", ".join(f"coalesce(sum({e}) FILTER (WHERE {w}), 0) AS {k}{n}" for k, w in (
        ("t", "week < cutpoint - 56"), ("v", "week >= cutpoint - 56")) for n, e in _FIT_SUMS)
    return f"""
fp AS (SELECT week, {SERIES}, CAST(base_units AS DOUBLE) AS v, ln(1 + greatest(CAST(base_units AS DOUBLE), 0)) AS y
  FROM c_filtered WHERE base_units IS NOT NULL),
fx AS (SELECT week, y, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_X))} FROM fp
  WINDOW p AS (PARTITION BY {SERIES} ORDER BY week)),
fs AS (SELECT cutpoint, {parts} FROM fx, (VALUES {values}) q(cutpoint) WHERE x3 IS NOT NULL AND week < cutpoint
  GROUP BY 1 HAVING tn > 0)"""


def _fits_sql(cuts) -> str:
    """Ridge weights per cutpoint by elimination, a common table expression per pivot; fw: cutpoint, penalty, w."""
    cells = [f"({_cell('ta', i, j)} / tn){f' + penalty' if i == j > 0 else ''} AS m{i}{j}" for i in _P for j in _P]
    steps = [f"f0 AS (SELECT cutpoint, penalty, {', '.join(cells)}, {', '.join(f'tb{i} / tn AS r{i}' for i in _P)} "
             f"FROM fs, (VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in refit.PENALTIES)}) q(penalty))"]
    for k in _P:
        row = []
        for i in _P:
            for name, top in [(f"m{i}{j}", f"m{k}{j}") for j in _P] + [(f"r{i}", f"r{k}")]:
                row.append(f"{top} / m{k}{k} AS {name}" if i == k else f"{name} - m{i}{k} / m{k}{k} * {top} AS {name}")
        steps.append(f"f{k + 1} AS (SELECT cutpoint, penalty, {', '.join(row)} FROM f{k})")
    quad = " + ".join(f"r{i} * r{j} * {_cell('va', i, j)}" for i in _P for j in _P)
    line = " + ".join(f"r{i} * vb{i}" for i in _P)
    steps.append(f"fl AS (SELECT cutpoint, penalty, [{', '.join(f'r{i}' for i in _P)}] AS w, "
                 f"vyy - 2 * ({line}) + ({quad}) AS loss FROM f{len(refit.TERMS)} JOIN fs USING (cutpoint))")
    steps.append("fw AS (SELECT cutpoint, arg_min(penalty, loss) AS penalty, arg_min(w, loss) AS w FROM fl GROUP BY 1)")
    return _fit_sums_sql(cuts) + ",\n" + ",\n".join(steps)


def _paths_sql(use) -> str:
    """Recursive forecasts of (cutpoint, model, cutpoint of the fit): fr has a row per forecast week."""
    values = ", ".join(f"(DATE '{d}', '{m}', DATE '{f}')" for d, m, f in use)
    dot = ("w[1] + w[2] * hist[-1] + w[3] * ((hist[-1] + hist[-2] + hist[-3] + hist[-4]) / 4) + w[4] * hist[-13] "
           f"+ w[5] * {_X[4]} + w[6] * {_X[5]}")
    return f"""
fu AS (SELECT q.cutpoint, model, w FROM (VALUES {values}) q(cutpoint, model, fitted) JOIN fw ON fw.cutpoint = fitted),
fh AS (SELECT {SERIES}, cutpoint, model, any_value(w) AS w, list(y ORDER BY week)[-13:] AS hist, list(v ORDER BY week) AS seen,
    list(v ORDER BY week) FILTER (WHERE week < cutpoint - 56) AS learned
  FROM fp, fu WHERE week < cutpoint GROUP BY ALL HAVING count(*) >= 13),
ft AS (SELECT {SERIES}, cutpoint, model, week, v, row_number() OVER (PARTITION BY {SERIES}, cutpoint, model ORDER BY week) AS h
  FROM fp, fu WHERE week >= cutpoint AND week < cutpoint + 91),
fr AS (
  SELECT {SERIES}, cutpoint, model, w, hist, CAST(0 AS BIGINT) AS h, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS pred FROM fh
  UNION ALL
  SELECT {SERIES}, cutpoint, model, w, list_append(hist[2:], value), h, v, exp(value) - 1 FROM (
    SELECT {SERIES}, cutpoint, model, w, hist, ft.h, ft.v, greatest({dot}, 0) AS value
    FROM fr JOIN ft USING ({SERIES}, cutpoint, model) WHERE ft.h = fr.h + 1) q
)"""


@query("L3_refit_sums", f"""
WITH {_fit_sums_sql(CUTS)}
--
SELECT cutpoint, {', '.join(f"{k}{n} AS {k}_{s}" for k in "tv" for (n, _), s in zip(_FIT_SUMS, refit.SUMS))} FROM fs
""")
def _(t):
    sums = refit.cutpoint_sums(refit.weekly_sums(refit.lag_rows(t.filtered)), CUTS)
    return sums.select("cutpoint", *[F.element_at(part, i + 1).alias(f"{part[0]}_{s}")
                                     for part in ("train", "valid") for i, s in enumerate(refit.SUMS)])


@query("L3_refit_fits", f"""
WITH {_fits_sql(CUTS)}
--
SELECT cutpoint, tn AS n_train, vn AS n_valid, penalty, {', '.join(f"w[{i + 1}] AS w_{n}" for i, n in enumerate(refit.TERMS))}
FROM fw JOIN fs USING (cutpoint)
""")
def _(t):
    return refit.fit_cutpoints(t.filtered, CUTS).select(
        "cutpoint", "n_train", "n_valid", "penalty",
        *[F.element_at("weights", i + 1).alias(f"w_{n}") for i, n in enumerate(refit.TERMS)])


@query("L3_refit_cv", f"""
WITH RECURSIVE {_fits_sql(CUTS)}, {_paths_sql([(d, "ridge", d) for d in CUTS])}
--
SELECT {SERIES}, cutpoint, len(any_value(learned)) AS n_train, count(*) AS n_test_rows, sum(v) AS test_units,
  100 * sum(abs(v - pred)) / sum(abs(v)) AS wmape, 100 * sum(abs(v - greatest(learned[-1], 0))) / sum(abs(v)) AS naive_wmape
FROM fr JOIN (SELECT {SERIES}, cutpoint, learned FROM fh WHERE len(learned) >= 52) q USING ({SERIES}, cutpoint) WHERE h > 0
GROUP BY {SERIES}, cutpoint HAVING count(*) >= 8 AND sum(abs(v)) > 0
""")
def _(t):
    return refit.refit_cv(t.filtered, CUTS, min_test=8)


_STALE = [d - dt.timedelta(weeks=13) for d in CUTS]


@query("L5_refit_rollforward", f"""
WITH RECURSIVE {_fits_sql(sorted({*CUTS, *_STALE}))},
{_paths_sql([(d, "retrained", d) for d in CUTS] + [(d, "stale", s) for d, s in zip(CUTS, _STALE)])},
fa AS (SELECT cutpoint, model, v, pred FROM fr WHERE h > 0 UNION ALL
  SELECT cutpoint, 'ma4', ft.v, list_avg(seen[-4:]) FROM ft JOIN fh USING ({SERIES}, cutpoint, model) WHERE model = 'retrained')
--
SELECT cutpoint, model, count(*) AS n, 100 * sum(abs(v - pred)) / sum(abs(v)) AS wmape FROM fa GROUP BY 1, 2
""")
def _(t):
    return refit.refit_rollforward(t.filtered, CUTS)


@query("L6_backtest", """
WITH m AS (
  SELECT retail_account, channel_outlet, log_unit_change AS a, predicted_log_unit_change AS p FROM c_elas
), g AS (
  SELECT retail_account, channel_outlet, count(*) AS n,
    1 - sum((a - p) * (a - p)) / nullif(var_pop(a) * count(*), 0) AS r2, avg(abs(a - p)) AS mae,
    avg(CASE WHEN a <> 0 THEN CASE WHEN sign(a) = sign(p) THEN 1.0 ELSE 0.0 END END) AS direction_accuracy
  FROM m GROUP BY ALL HAVING count(*) >= 5
)
--
SELECT *, CASE WHEN r2 >= 0.7 THEN 'PASS' WHEN r2 >= 0.5 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM g
""")
def _(t):
    return ev.backtest(rule_elasticity(t), ["retail_account", "channel_outlet"], "log_unit_change",
                       "predicted_log_unit_change")


_Q = {"forecast_units_low": 0.1, "forecast_units_base": 0.5, "forecast_units_high": 0.9}


def flat_with_actuals(t):
    a = own_scored(t.enriched, t.cfg).select("week", *SERIES_KEYS, F.col("base_units").alias("actual"))
    return flat_forecast(t).join(a, ["week", *SERIES_KEYS])


_COV = " UNION ALL ".join(
    f"SELECT '{cut}' AS cut, {lv} AS level, count(*) AS n, avg(hi - lo) AS mean_width, '{q}' AS quantile, "
    f"{t} AS target, avg(CASE WHEN actual < {c} THEN 1.0 ELSE 0.0 END) AS coverage FROM fa GROUP BY ALL"
    for cut, lv in (("portfolio", "'all'"), ("maturity", "mat"), ("channel", "channel_outlet"))
    for q, t, c in (("forecast_units_low", 0.1, "lo"), ("forecast_units_base", 0.5, "mid"), ("forecast_units_high", 0.9, "hi")))


@query("L7_coverage_audit", f"""
WITH fa AS (
  SELECT f.channel_outlet, forecast_units_low AS lo, forecast_units_base AS mid, forecast_units_high AS hi,
    o.base_units AS actual, CASE WHEN weeks_since_launch < 13 THEN 'new' WHEN weeks_since_launch < 52
      THEN 'growing' ELSE 'mature' END AS mat
  FROM c_flat f JOIN c_own o USING (week, {SERIES})
), u AS ({_COV})
--
SELECT *, 100 * (coverage - target) AS error_pp, CASE WHEN abs(100 * (coverage - target)) > 5 THEN 'FAIL'
  ELSE 'PASS' END AS verdict FROM u
""")
def _(t):
    return ev.coverage_audit(flat_with_actuals(t), _Q)


@query("L8_recalibrate", f"""
WITH fa AS (
  SELECT forecast_units_high AS p, o.base_units AS a, CAST('0x' || substr(md5(concat_ws('|', {SERIES},
    CAST(week AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS fit
  FROM c_flat f JOIN c_own o USING (week, {SERIES})
), k AS (
  SELECT quantile_cont(a - p, 0.9) AS ka, quantile_cont(a / greatest(p, 1), 0.9) AS km FROM fa WHERE fit
), c AS (
  SELECT max(ka) AS additive_offset, max(km) AS multiplicative_factor,
    avg(CASE WHEN a < p THEN 1.0 ELSE 0.0 END) AS coverage_before,
    avg(CASE WHEN a < p + ka THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT fit) AS ca,
    avg(CASE WHEN a < p * km THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT fit) AS cm,
    avg(CASE WHEN a < p + ka THEN 1.0 ELSE 0.0 END) AS fa_, avg(CASE WHEN a < p * km THEN 1.0 ELSE 0.0 END) AS fm
  FROM fa, k
)
--
SELECT additive_offset, multiplicative_factor, coverage_before, ca AS coverage_additive_holdout,
  cm AS coverage_multiplicative_holdout,
  CASE WHEN abs(cm - 0.9) <= abs(ca - 0.9) THEN 'multiplicative' ELSE 'additive' END AS winner,
  CASE WHEN abs(cm - 0.9) <= abs(ca - 0.9) THEN multiplicative_factor ELSE additive_offset END AS constant,
  CASE WHEN abs(cm - 0.9) <= abs(ca - 0.9) THEN fm ELSE fa_ END AS coverage_after FROM c
""")
def _(t):
    return ev.recalibrate(flat_with_actuals(t))


def seg_errors(t):
    return cv(t).groupBy(F.concat_ws("|", "channel_outlet", "upc").alias("seg"), "cutpoint").agg(
        F.avg("wmape").alias("wmape"))


@query("L9_segment_drift", f"""
WITH {CV}, e AS (SELECT channel_outlet || '|' || upc AS seg, cutpoint, avg(wmape) AS wmape FROM cv GROUP BY ALL),
r AS (
  SELECT seg, wmape / m AS rr, CASE cutpoint {' '.join(f"WHEN DATE '{d}' THEN {i}.0" for i, d in enumerate(CUTS))} END AS x
  FROM e JOIN (SELECT cutpoint, quantile_cont(wmape, 0.5) AS m FROM e GROUP BY 1) q USING (cutpoint)
), b AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY x DESC) AS rb FROM r)
--
SELECT seg, count(*) AS n_cutpoints, CASE WHEN count(*) >= 4 THEN regr_slope(rr, CAST(x AS DOUBLE)) ELSE 0 END AS slope,
  avg(rr) FILTER (WHERE rb <= 3) AS drift_score, max(rr) FILTER (WHERE rb = 1) AS final_ratio
FROM b GROUP BY 1
""")
def _(t):
    return ev.segment_drift(seg_errors(t), CUTS).select(
        "seg", "n_cutpoints", "slope", "drift_score", "final_ratio")


_CUTSEL = " UNION ALL ".join(
    f"SELECT '{n}' AS cut, {e} AS level, b FROM bia" for n, e in (
        ("Portfolio", "'all'"), ("Retailer", "retail_account"),
        ("Maturity", "CASE WHEN wsl < 13 THEN 'new' WHEN wsl < 52 THEN 'growing' ELSE 'mature' END"),
        ("Quarter", "CASE WHEN weekofyear(week) <= 13 THEN 'Q1' WHEN weekofyear(week) <= 26 THEN 'Q2' "
                    "WHEN weekofyear(week) <= 39 THEN 'Q3' ELSE 'Q4' END"),
        ("Promo flag", "CASE WHEN units_promo > 0 THEN 'Promo week' ELSE 'Non-promo' END"),
        ("Pack format", "CASE WHEN pack_count = 1 THEN 'single' WHEN pack_count <= 12 THEN 'multipack' ELSE 'bulk' END")))


@query("L10_residual_audit", f"""
WITH {NAIVE}, bia AS (SELECT *, 100 * (actual - pred) / actual AS b FROM naive WHERE actual > 0 AND pred IS NOT NULL),
u AS ({_CUTSEL})
--
SELECT cut, level, count(*) AS n, avg(b) AS mean_bias_pct, avg(b) / (stddev_samp(b) / sqrt(count(*))) AS t_stat,
  100 * avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END) AS pct_positive_residual
FROM u GROUP BY ALL HAVING count(*) >= 5
""")
def _(t):
    return ev.residual_audit(naive_rows(t)).select(
        "cut", "level", "n", "mean_bias_pct", "t_stat", "pct_positive_residual")


_KS = ("units", "tdp", "arp", "avg_weekly_units_spm")


@query("L11_ks_shift", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS x, week >= DATE '2000-01-03' AS late FROM c_filtered WHERE {f} IS NOT NULL"
    for f in _KS) + """),
c AS (SELECT feature, x, count(*) FILTER (WHERE NOT late) AS n0, count(*) FILTER (WHERE late) AS n1 FROM l GROUP BY ALL),
k AS (SELECT feature, sum(n0) OVER f AS t0, sum(n1) OVER f AS t1, sum(n0) OVER r AS c0, sum(n1) OVER r AS c1 FROM c
  WINDOW f AS (PARTITION BY feature), r AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING)),
d AS (SELECT feature, max(t0) AS n_train, max(t1) AS n_val, max(abs(c0 / t0 - c1 / t1)) AS ks_stat FROM k GROUP BY 1),
m AS (SELECT feature, median(x) FILTER (WHERE NOT late) AS train_median, median(x) FILTER (WHERE late) AS val_median
  FROM l GROUP BY 1)
--
SELECT d.*, train_median, val_median, 100 * (val_median - train_median) / (abs(train_median) + 1e-6) AS pct_shift,
  CASE WHEN abs(val_median - train_median) < 1e-6 THEN 'same' WHEN val_median > train_median THEN 'higher'
    ELSE 'lower' END AS direction FROM d JOIN m USING (feature)
""")
def _(t):
    return ev.ks_shift(t.filtered, _KS, dt.date(2000, 1, 3)).drop("p_value", "material")


@query("L12_icc", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {SERIES}, {f} AS x FROM c_filtered" for f in _KS) + f"""),
s AS (SELECT feature, x, avg(x) OVER (PARTITION BY feature, {SERIES}) AS m, avg(x) OVER (PARTITION BY feature) AS g FROM l)
--
SELECT feature, sum((m - g) * (m - g)) / sum((x - g) * (x - g)) AS icc FROM s GROUP BY 1
""")
def _(t):
    return ev.icc(t.filtered, _KS)


@query("L13_coherence_audit", f"""
WITH s AS (
  SELECT {SERIES}, base_units, units, CASE WHEN least(1, units_promo / greatest(units, 1)) > 0.10 THEN 'units_promo'
      WHEN units_promo = 0 AND r8 IS NOT NULL AND dd0 > 0.05 THEN 'arp_inferred' ELSE 'none' END AS src,
    least(5, incr_units / greatest(base_units, 1)) AS lift FROM c_promo_panel
), q AS (SELECT bool_and(src = 'none') AS quiet FROM s GROUP BY {SERIES})
--
SELECT count(*) AS n_rows, 0 AS base_null, 0 AS total_null, count(*) FILTER (WHERE base_units > units) AS violations,
  count(*) FILTER (WHERE src = 'units_promo') AS rows_units_promo,
  count(*) FILTER (WHERE src = 'arp_inferred') AS rows_arp_inferred, count(*) FILTER (WHERE src = 'none') AS rows_none,
  100 * avg(CASE WHEN lift > 1 THEN 1.0 ELSE 0.0 END) AS lift_gt1_pct, median(lift) AS lift_median,
  quantile_cont(lift, 0.9) AS lift_p90, (SELECT count(*) FILTER (WHERE quiet) FROM q) AS none_series,
  (SELECT count(*) FILTER (WHERE NOT quiet) FROM q) AS promo_series
FROM s
""")
def _(t):
    p = own_scored(t.enriched, t.cfg).withColumn("total_units", F.col("units")).withColumn(
        "arp_roll8_avg", w.rolling_prior("arp", 8, 2))
    return ev.coherence_audit(pa.promo_signals(p))


@query("L14_event_context", f"""
WITH {NAIVE}, e AS (SELECT *, wsl <= 26 OR promo_weeks = 1 AS ev FROM naive)
--
SELECT 'global' AS context, count(*) AS n, 100 * sum(abs(actual - pred)) / sum(actual) FILTER (WHERE pred IS NOT NULL) AS wmape FROM e
UNION ALL SELECT CASE WHEN ev THEN 'event' ELSE 'stable' END, count(*),
  100 * sum(abs(actual - pred)) / sum(actual) FILTER (WHERE pred IS NOT NULL) FROM e GROUP BY 1
""")
def _(t):
    rows = naive_rows(t).withColumn("arp_pct_change", F.col("promo_weeks") * 1.0)
    return ev.event_split_metrics(rows, pa.event_context(rows))


@query("J10_pinball", f"""
WITH fa AS (SELECT forecast_units_low AS l, forecast_units_base AS m, forecast_units_high AS h, o.base_units AS a
  FROM c_flat JOIN c_own o USING (week, {SERIES}))
--
SELECT avg(CASE WHEN a >= l THEN 0.1 * (a - l) ELSE 0.9 * (l - a) END) AS pinball_forecast_units_low,
  avg(0.5 * abs(a - m)) AS pinball_forecast_units_base,
  avg(CASE WHEN a >= h THEN 0.9 * (a - h) ELSE 0.1 * (h - a) END) AS pinball_forecast_units_high FROM fa
""")
def _(t):
    return ev.pinball(flat_with_actuals(t), _Q)


@query("J8_temporal_split", f"""
WITH x AS (SELECT week, upc, lag(base_units) OVER (PARTITION BY {SERIES} ORDER BY week) AS l, base_units FROM c_filtered)
--
SELECT week <= (SELECT max(week) FROM c_filtered) - 91 AS is_train, count(*) AS n, sum(ln(1 + base_units)) AS target
FROM x WHERE l IS NOT NULL GROUP BY 1
""")
def _(t):
    from shelfwise.operators.models import lag_frame, temporal_split

    return temporal_split(lag_frame(t.filtered)).groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum("log_target").alias("target"))


@query("J16_ensemble_route", f"""
WITH te AS (
  SELECT {SERIES}, f.forecast_units_base AS m, o.base_units AS a, f.anchor_value AS e
  FROM c_flat f JOIN c_own o USING (week, {SERIES})
), s AS (
  SELECT {SERIES}, 100 * sum(abs(a - m)) / nullif(sum(a), 0) AS wmape_model,
    100 * sum(abs(a - e)) / nullif(sum(a), 0) AS wmape_ets, sum(a) AS total_actual FROM te GROUP BY ALL
), mt AS (SELECT {SERIES}, max(weeks_since_launch) AS max_wsl FROM c_flat GROUP BY ALL)
--
SELECT s.*, max_wsl, CASE WHEN wmape_ets < wmape_model - 5 THEN 'ets' WHEN wmape_model < wmape_ets - 5 THEN 'model'
    ELSE 'tied' END AS winner, CASE WHEN wmape_ets < wmape_model - 5 THEN 'ets' ELSE 'model' END AS route,
  CASE WHEN max_wsl <= 26 THEN 'New / Cold-start' WHEN max_wsl <= 52 THEN 'Expanding / Growth'
    ELSE 'Mature / Stable' END AS stage FROM s JOIN mt USING ({SERIES})
""")
def _(t):
    from shelfwise.operators.forecast import ensemble_route

    f = flat_with_actuals(t)
    test = f.select(*SERIES_KEYS, "actual", F.col("forecast_units_base").alias("pred_model"),
                    F.col("anchor_value").alias("pred_ets"))
    meta = flat_forecast(t).groupBy(*SERIES_KEYS).agg(F.max("weeks_since_launch").alias("max_wsl"))
    return ensemble_route(test, meta)
