"""Forecast metrics, cross-validation, calibration and drift audits (group L)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalar import case, flag, safe_div, segment_labels
from shelfwise.functions.stats import kolmogorov_sf, student_sf2
from shelfwise.scale import config_lookup, exact_quantiles, running_totals
from shelfwise.schema import SERIES_KEYS


def hash_unit(key: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1) from a row key."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 8), 16, 10).cast("bigint") / 2**32


def row_key() -> Column:
    return F.concat_ws("|", *SERIES_KEYS, F.col("week").cast("string"))


def wmape(actual: str, pred: str, denominator: str = "abs") -> Column:
    """Aggregate: weighted absolute percentage error; NULL pairs are ignored.

    Denominator: sum of |actual| (`abs`), of actual (`sum`) or of positive actual (`positive`).
    """
    a = F.when(F.col(pred).isNotNull(), F.col(actual))
    err = F.sum(F.abs(a - F.col(pred)))
    den = {"abs": F.sum(F.abs(a)), "sum": F.sum(a), "positive": F.sum(F.when(a > 0, a))}[denominator]
    return 100 * F.when(den > 0, safe_div(err, den))


def forecast_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred",
                     denominator: str = "abs") -> DataFrame:
    """L1: wMAPE, capped MAPE, symmetric MAPE, RMSE and bias per key."""
    a, p = F.col(actual), F.col(pred)
    err = a - p
    ape = F.when(a >= 1, F.least(F.abs(err) / a, F.lit(5.0)))
    half = (F.abs(a) + F.abs(p)) / 2
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        wmape(actual, pred, denominator).alias("wmape"),
        (100 * F.avg(ape)).alias("mape_safe"),
        (100 * F.avg(F.when(half > 0, F.abs(err) / half))).alias("smape"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (100 * safe_div(F.sum(p - a), F.sum(a))).alias("bias_pct"),
    )


def pinball(df: DataFrame, quantiles: dict[str, float], actual: str = "actual") -> DataFrame:
    """Mean pinball loss per quantile column."""
    aggs = []
    for c, q in quantiles.items():
        e = F.col(actual) - F.col(c)
        aggs.append(F.avg(F.when(e >= 0, q * e).otherwise((q - 1) * e)).alias(f"pinball_{c}"))
    return df.agg(*aggs)


def rolling_cv(panel: DataFrame, cutpoints: Sequence[date], min_train: int = 52, min_test: int = 10,
               horizon: int = 13, gap_weeks: int = 8, c: str = "base_units") -> DataFrame:
    """L3: error per series and cutpoint of the 13-row mean against the last value.

    The cutpoints are a small table multiplied into the rows, so all of them are scored in one pass.
    Training ends `gap_weeks` before the cutpoint (the gap belongs to validation).
    """
    cuts = F.explode(F.array(*[F.lit(d) for d in cutpoints]))
    rows = panel.select("week", *SERIES_KEYS, F.col(c).alias("y")).select("*", cuts.alias("cutpoint"))
    train = rows.where(F.col("week") < F.date_sub("cutpoint", 7 * gap_weeks))
    test = rows.where((F.col("week") >= F.col("cutpoint"))
                      & (F.col("week") < F.date_add("cutpoint", 7 * horizon)))
    keys = [*SERIES_KEYS, "cutpoint"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("week"))
    learned = train.withColumn("_r", F.row_number().over(newest)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"),
        F.avg(F.when(F.col("_r") <= horizon, F.col("y"))).alias("pred"),
        F.max(F.when(F.col("_r") == 1, F.col("y"))).alias("naive"),
    ).where(F.col("n_train") >= min_train)
    return test.join(learned, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test_rows"), F.sum("y").alias("test_units"),
        wmape("y", "pred").alias("wmape"), wmape("y", "naive").alias("naive_wmape"),
    ).where((F.col("n_test_rows") >= min_test) & F.col("wmape").isNotNull())


def summarise_cv(cv: DataFrame) -> DataFrame:
    """L4: spread over series per cutpoint and the gain over the naive forecast."""
    base = cv.groupBy("cutpoint").agg(F.count(F.lit(1)).alias("n_series"), F.avg("wmape").alias("mean_wmape"))
    q = exact_quantiles(cv, ["cutpoint"], "wmape", {"p25_wmape": 0.25, "median_wmape": 0.5, "p75_wmape": 0.75})
    n = exact_quantiles(cv, ["cutpoint"], "naive_wmape", {"naive_median": 0.5})
    return base.join(q, "cutpoint").join(n, "cutpoint").withColumn(
        "gap_vs_naive", F.col("naive_median") - F.col("median_wmape"))


def rollforward(panel: DataFrame, quarters: Sequence[date], horizon: int = 13, c: str = "base_units") -> DataFrame:
    """Forecasts refreshed each quarter against ones a quarter old, and the 4-row mean."""
    out = None
    for name, lag_weeks, span in (("retrained", 0, 13), ("stale", 13, 13), ("ma4", 0, 4)):
        cuts = F.explode(F.array(*[F.lit(d) for d in quarters]))
        rows = panel.select("week", *SERIES_KEYS, F.col(c).alias("y")).select("*", cuts.alias("cutpoint"))
        known = rows.where(F.col("week") < F.date_sub("cutpoint", 7 * lag_weeks))
        newest = Window.partitionBy(*SERIES_KEYS, "cutpoint").orderBy(F.desc("week"))
        level = known.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= span).groupBy(
            *SERIES_KEYS, "cutpoint").agg(F.avg("y").alias("pred"))
        test = rows.where((F.col("week") >= F.col("cutpoint")) & (F.col("week") < F.date_add("cutpoint", 7 * horizon)))
        m = test.join(level, [*SERIES_KEYS, "cutpoint"]).groupBy("cutpoint").agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), wmape("y", "pred").alias("wmape"))
        out = m if out is None else out.unionByName(m)
    return out


def backtest(df: DataFrame, keys: Sequence[str], actual: str, pred: str, min_rows: int = 5) -> DataFrame:
    """Fit, error and direction of predictions per key; verdict on R2 (0.70 pass, 0.50 marginal)."""
    a, p = F.col(actual), F.col(pred)
    s = df.where(a.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((a - p) * (a - p)).alias("_sse"), (F.var_pop(a) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.avg(F.when(a != 0, flag(F.signum(a) == F.signum(p)).cast("double"))).alias("direction_accuracy"),
    ).where(F.col("n") >= min_rows)
    r2 = 1 - safe_div("_sse", "_sst")
    return s.select(*keys, "n", r2.alias("r2"), "mae", "direction_accuracy",
                    case([(r2 >= 0.70, "PASS"), (r2 >= 0.50, "MARGINAL")], "FAIL").alias("verdict"))


def coverage_audit(df: DataFrame, quantiles: dict[str, float], actual: str = "actual",
                   tolerance_pp: float = 5.0) -> DataFrame:
    """Share of actuals below each quantile, for the portfolio, by maturity and by channel.

    Needs weeks_since_launch and channel_outlet.
    """
    segment = F.explode(F.array(
        F.struct(F.lit("portfolio").alias("cut"), F.lit("all").alias("level")),
        F.struct(F.lit("maturity").alias("cut"), segment_labels("maturity", "weeks_since_launch").alias("level")),
        F.struct(F.lit("channel").alias("cut"), F.col("channel_outlet").alias("level")),
    ))
    names = list(quantiles)
    s = df.select("*", segment.alias("_s")).groupBy("_s.cut", "_s.level").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(flag(F.col(actual) < F.col(c)).cast("double")).alias(f"_c_{c}") for c in names],
        F.avg(F.col(names[-1]) - F.col(names[0])).alias("mean_width"))
    q = F.explode(F.array(*[
        F.struct(F.lit(c).alias("quantile"), F.lit(v).alias("target"), F.col(f"_c_{c}").alias("coverage"))
        for c, v in quantiles.items()]))
    err = 100 * (F.col("coverage") - F.col("target"))
    return s.select("cut", "level", "n", "mean_width", q.alias("q")).select(
        "cut", "level", "n", "mean_width", "q.*").select(
        "*", err.alias("error_pp"),
        F.when(F.abs(err) > tolerance_pp, "FAIL").otherwise("PASS").alias("verdict"))


def recalibrate(df: DataFrame, pred: str = "forecast_units_high", actual: str = "actual",
                target: float = 0.9) -> DataFrame:
    """Split-conformal correction of a quantile: additive or multiplicative, whichever covers closer.

    Half the rows (by hash) set both constants, the other half decides. One result row.
    """
    half = df.withColumn("_a", hash_unit(row_key()) < 0.5)
    fit = half.where("_a").select(
        (F.col(actual) - F.col(pred)).alias("_add"),
        (F.col(actual) / F.greatest(F.col(pred), F.lit(1.0))).alias("_mul"))
    add = exact_quantiles(fit, [], "_add", {"q": target}).select("q").scalar()
    mul = exact_quantiles(fit, [], "_mul", {"q": target}).select("q").scalar()

    def cover(bound: Column, test_only: bool) -> Column:
        hit = flag(F.col(actual) < bound).cast("double")
        return F.avg(F.when(~F.col("_a"), hit) if test_only else hit)

    p = F.col(pred)
    s = half.select("*", add.alias("_ka"), mul.alias("_km")).agg(
        F.max("_ka").alias("additive_offset"), F.max("_km").alias("multiplicative_factor"),
        cover(p, False).alias("coverage_before"),
        cover(p + F.col("_ka"), True).alias("coverage_additive_holdout"),
        cover(p * F.col("_km"), True).alias("coverage_multiplicative_holdout"),
        cover(p + F.col("_ka"), False).alias("_fa"), cover(p * F.col("_km"), False).alias("_fm"))
    mult = F.abs(F.col("coverage_multiplicative_holdout") - target) <= F.abs(
        F.col("coverage_additive_holdout") - target)
    return s.select(
        "additive_offset", "multiplicative_factor", "coverage_before", "coverage_additive_holdout",
        "coverage_multiplicative_holdout",
        F.when(mult, "multiplicative").otherwise("additive").alias("winner"),
        F.when(mult, F.col("multiplicative_factor")).otherwise(F.col("additive_offset")).alias("constant"),
        F.when(mult, F.col("_fm")).otherwise(F.col("_fa")).alias("coverage_after"))


def segment_drift(errors: DataFrame, cutpoints: Sequence[date], ratio: float = 2.0, min_over: int = 2,
                  slope_limit: float = 0.15, p_limit: float = 0.10) -> DataFrame:
    """Segments whose error grows against the portfolio median over the cutpoints.

    `errors`: seg, cutpoint, wmape. Drift means a significant upward slope of the ratio ending above
    1.5, or at least `min_over` of the last three ratios (the last one included) above `ratio`
    unless the slope is clearly falling. A segment has one row per cutpoint.
    """
    order = config_lookup(errors.sparkSession, [(d, i) for i, d in enumerate(sorted(cutpoints))],
                          "cutpoint date, idx int")
    med = exact_quantiles(errors, ["cutpoint"], "wmape", {"_med": 0.5}).where("_med > 0")
    r = errors.join(med, "cutpoint").join(order, "cutpoint").withColumn("rr", F.col("wmape") / F.col("_med"))
    back = Window.partitionBy("seg").orderBy(F.desc("idx"))
    x = F.col("idx").cast("double")
    s = r.withColumn("_b", F.row_number().over(back)).groupBy("seg").agg(
        F.count(F.lit(1)).alias("n_cutpoints"),
        F.covar_pop("rr", x).alias("_cxy"), F.var_pop(x).alias("_vx"), F.var_pop("rr").alias("_vy"),
        F.avg(F.when(F.col("_b") <= 3, F.col("rr"))).alias("drift_score"),
        F.count_if((F.col("_b") <= 3) & (F.col("rr") >= ratio)).alias("_over"),
        F.max(F.when(F.col("_b") == 1, F.col("rr"))).alias("final_ratio"),
    )
    n = F.col("n_cutpoints")
    slope = F.when(n >= 4, safe_div("_cxy", "_vx"))
    s = s.withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    resid = F.greatest(F.col("_vy") - F.col("slope") * F.col("_cxy"), F.lit(0.0)) * n / (n - 2)
    t = safe_div("slope", F.sqrt(safe_div(resid, F.col("_vx") * n)))
    p = F.when((n >= 4) & (resid > 0), student_sf2(t, (n - 2).cast("double")))
    # without residual spread the slope is exact
    p = F.coalesce(p, F.when((n >= 4) & (F.col("slope") != 0), F.lit(0.0)), F.lit(1.0))
    s = s.withColumn("p_value", p)
    rising = (F.col("slope") > slope_limit) & (F.col("p_value") < p_limit) & (F.col("final_ratio") > 1.5)
    high = (F.col("_over") >= min_over) & (F.col("final_ratio") >= ratio) & (F.col("slope") >= -0.5)
    return s.select("seg", "n_cutpoints", "slope", "p_value", "drift_score", "final_ratio",
                    ((n >= 3) & (rising | high)).alias("is_drifting"))


def residual_audit(df: DataFrame, actual: str = "actual", pred: str = "pred", min_rows: int = 5,
                   bias_limit: float = 5.0, p_limit: float = 0.05) -> DataFrame:
    """Mean relative residual per account, maturity, quarter, promotion and pack, with t test.

    Needs retail_account, weeks_since_launch, week, units_promo, pack_count.
    """
    cuts = {
        "Portfolio": F.lit("all"), "Retailer": F.col("retail_account"),
        "Maturity": segment_labels("maturity", "weeks_since_launch"),
        "Quarter": segment_labels("quarter", F.weekofyear("week")),
        "Promo flag": F.when(F.col("units_promo") > 0, "Promo week").otherwise("Non-promo"),
        "Pack format": segment_labels("pack_format", "pack_count"),
    }
    bias = 100 * (F.col(actual) - F.col(pred)) / F.col(actual)
    rows = df.where((F.col(actual) > 0) & F.col(pred).isNotNull()).select(
        bias.alias("b"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), c.alias("level")) for n, c in cuts.items()])).alias("s"))
    g = rows.groupBy("s.cut", "s.level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("b").alias("mean_bias_pct"), F.stddev_samp("b").alias("_sd"),
        (100 * F.avg(flag(F.col("b") > 0).cast("double"))).alias("pct_positive_residual"),
    ).where(F.col("n") >= min_rows)
    g = g.withColumn("t_stat", F.try_divide("mean_bias_pct", F.col("_sd") / F.sqrt("n")))
    g = g.withColumn("p_value", student_sf2("t_stat", (F.col("n") - 1).cast("double")))
    return g.select("cut", "level", "n", "mean_bias_pct", "t_stat", "p_value", "pct_positive_residual",
                    F.coalesce((F.abs("mean_bias_pct") > bias_limit) & (F.col("p_value") < p_limit),
                               F.lit(False)).alias("material"))


def ks_shift(df: DataFrame, features: Sequence[str], split: date, min_rows: int = 100,
             ks_limit: float = 0.05, p_limit: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov shift of features before and from a date on.

    Values are counted first; the cumulative counts run in two levels, so no feature is sorted in
    one task. Medians are exact and distributed too.
    """
    late = F.col("week") >= F.lit(split)
    long = df.select(late.alias("_late"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")
    ).select("_late", "s.feature", "s.x").where("x is not null")
    counts = long.groupBy("feature", "x").agg(
        F.count_if(~F.col("_late")).alias("_n0"), F.count_if("_late").alias("_n1"))
    totals = counts.groupBy("feature").agg(F.sum("_n0").alias("n_train"), F.sum("_n1").alias("n_val"))
    cum = running_totals(counts, ["feature"], "x", {"_c0": "_n0", "_c1": "_n1"})
    d = cum.join(totals, "feature").where((F.col("n_train") >= min_rows) & (F.col("n_val") >= min_rows)).groupBy(
        "feature", "n_train", "n_val").agg(
        F.max(F.abs(F.col("_c0") / F.col("n_train") - F.col("_c1") / F.col("n_val"))).alias("ks_stat"))
    m0 = exact_quantiles(long.where(~F.col("_late")), ["feature"], "x", {"train_median": 0.5})
    m1 = exact_quantiles(long.where("_late"), ["feature"], "x", {"val_median": 0.5})
    s = d.join(m0, "feature").join(m1, "feature").withColumn(
        "p_value", kolmogorov_sf("ks_stat", F.col("n_train").cast("double"), F.col("n_val").cast("double")))
    diff = F.col("val_median") - F.col("train_median")
    return s.select(
        "feature", "n_train", "n_val", "ks_stat", "p_value", "train_median", "val_median",
        (100 * diff / (F.abs("train_median") + 1e-6)).alias("pct_shift"),
        case([(F.abs(diff) < 1e-6, "same"), (diff > 0, "higher")], "lower").alias("direction"),
        ((F.col("ks_stat") > ks_limit) & (F.col("p_value") < p_limit)).alias("material"))


def icc(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of a feature's variance that lies between series."""
    long = panel.select(*SERIES_KEYS, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")
    ).select(*SERIES_KEYS, "s.feature", "s.x").where("x is not null")
    per = long.groupBy("feature", *SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_m"), (F.var_pop("x") * F.count(F.lit(1))).alias("_w"))
    grand = per.groupBy("feature").agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"))
    b = per.join(grand, "feature").groupBy("feature").agg(
        F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) * (F.col("_m") - F.col("_g"))).alias("_b"),
        F.sum("_w").alias("_w"))
    return b.select("feature", F.coalesce(safe_div("_b", F.col("_b") + F.col("_w")), F.lit(0.0)).alias("icc"))


def coherence_audit(panel: DataFrame) -> DataFrame:
    """Base against total units, promotion evidence mix and lift spread, one row.

    Needs base_units, total_units, promo_source, promo_lift_ratio.
    """
    src = F.col("promo_source")
    q = exact_quantiles(panel, [], "promo_lift_ratio", {"p50": 0.5, "p90": 0.9})
    s = panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("base_units").isNull()).alias("base_null"),
        F.count_if(F.col("total_units").isNull()).alias("total_null"),
        F.count_if(F.col("base_units") > F.col("total_units")).alias("violations"),
        *[F.count_if(src == v).alias(f"rows_{v}") for v in ("units_promo", "arp_inferred", "none")],
        (100 * F.avg(flag(F.col("promo_lift_ratio") > 1).cast("double"))).alias("lift_gt1_pct"))
    quiet = panel.groupBy(*SERIES_KEYS).agg(F.min(src == "none").alias("_quiet")).agg(
        F.count_if("_quiet").alias("none_series"), F.count_if(~F.col("_quiet")).alias("promo_series"))
    return s.select(
        "*", q.select("p50").scalar().alias("lift_median"), q.select("p90").scalar().alias("lift_p90"),
        quiet.select("none_series").scalar().alias("none_series"),
        quiet.select("promo_series").scalar().alias("promo_series"))


def event_split_metrics(df: DataFrame, mask: Column, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Error on all rows, on event rows and on stable rows."""
    ctx = F.explode(F.array(F.lit("global"), F.when(mask, "event").otherwise("stable")))
    return df.select("*", ctx.alias("context")).groupBy("context").agg(
        F.count(F.lit(1)).alias("n"), wmape(actual, pred).alias("wmape"))
