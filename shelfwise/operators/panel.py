"""Forecast panel: feature joins and row-level features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import HOLIDAY_WEEKS, RetailConfig
from shelfwise.functions.scalar import case, clamp, flag, safe_div, week_of_year, weeks_between
from shelfwise.operators import windows as w
from shelfwise.operators.aggregates import category_share, donor_signals
from shelfwise.operators.enrich import own_scored
from shelfwise.operators.transfer import rank_donors
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS


def price_cascade(panel: DataFrame, launch_price: str = "launch_arp") -> DataFrame:
    """Live price, else the mean of up to 13 previous live prices, else the launch price."""
    prior = w.rolling_prior("arp", 13, 4)
    live = F.col("arp")
    staged = panel.withColumn("_prior", prior)
    return staged.select(
        *[c for c in panel.columns if c != "arp"],
        F.coalesce(live, "_prior", launch_price).alias("arp"),
        flag(live.isNull() & F.coalesce("_prior", launch_price).isNotNull()).alias("arp_fallback"),
        case(
            [(live.isNotNull(), "live"), (F.col("_prior").isNotNull(), "roll13"),
             (F.col(launch_price).isNotNull(), "prepost")],
            "live",
        ).alias("arp_source"),
    )


def calendar_features(panel: DataFrame) -> DataFrame:
    """ISO week, holiday code, event flags and annual sine and cosine."""
    woy = week_of_year()
    sin, cos = w.fourier(woy)
    flags = {"new_year": (1, 2), "big_game": (5,), "memorial_day": (21,), "labor_day": (36,),
             "thanksgiving": (47,), "christmas": (52,)}
    return panel.select(
        "*",
        woy.alias("week_of_year"),
        case([(woy == k, v) for k, v in HOLIDAY_WEEKS.items()], 0).alias("holiday_week"),
        *[flag(woy.isin(*ws)).alias(f"is_{n}_week") for n, ws in flags.items()],
        sin.alias("week_sin"), cos.alias("week_cos"),
    )


def price_change_bin(panel: DataFrame, elasticity: str = "implied_elasticity") -> DataFrame:
    """Price moves as share, four-level bin and expected demand effect."""
    lag = F.lag("arp", 1).over(w.series())
    p = panel.select(
        "*", lag.alias("arp_lag1"), F.lag("arp", 4).over(w.series()).alias("arp_lag4"),
        (F.col("arp") - lag).alias("arp_wow_delta"),
        w.rolling_prior("arp", 8, 2).alias("arp_roll8_avg"),
        w.rolling_prior("arp", 8, 2, F.stddev_samp).alias("arp_roll8_std"),
    )
    delta = F.col("arp_wow_delta")
    pct = F.coalesce(
        clamp(delta / F.greatest("arp_lag1", F.lit(0.01)), -0.5, 0.5), F.lit(0.0))
    p = p.withColumn("arp_pct_change", pct)
    drop = F.greatest(-delta, F.lit(0.0))
    level = case(
        [
            (delta.isNull() | (F.abs("arp_pct_change") < 0.02), 0), (delta > 0.05, -1),
            (drop <= 0.05, 0), (drop <= 0.25, 1),
        ],
        2,
    )
    effect = F.col("arp_pct_change") * F.coalesce(elasticity, F.lit(0.0))
    return p.select(
        "*", level.alias("price_change_bin"),
        clamp(effect, -1.5, 1.5).alias("price_elasticity_effect"),
    )


def promo_signals(panel: DataFrame) -> DataFrame:
    """Promotion intensity, discount against the 8-row base, lift and its evidence source.

    Needs arp_roll8_avg, total_units, units_promo, incr_units.
    """
    base = F.col("arp_roll8_avg")
    intensity = F.coalesce(
        clamp(F.col("units_promo") / F.greatest("total_units", F.lit(1.0)), 0.0, 1.0), F.lit(0.0))
    dollar = F.coalesce(F.greatest(base - F.col("arp"), base * 0), F.lit(0.0))
    by_units = intensity > 0.10
    by_price = F.coalesce(F.col("units_promo") == 0, F.lit(True)) & (dollar > 0.05)
    return panel.select(
        "*",
        intensity.alias("promo_intensity"),
        F.coalesce(
            clamp((base - F.col("arp")) / F.greatest(base, F.lit(0.01)), 0.0, 1.0), F.lit(0.0)
        ).alias("arp_discount_pct"),
        dollar.alias("arp_dollar_discount"),
        clamp(
            F.coalesce("incr_units", F.lit(0.0)) / F.greatest("base_units", F.lit(1.0)), 0.0, 5.0
        ).alias("promo_lift_ratio"),
        flag(by_units | by_price).alias("is_promo_week"),
        case([(by_units, "units_promo"), (by_price, "arp_inferred")], "none").alias("promo_source"),
    )


def rolling_signals(panel: DataFrame) -> DataFrame:
    """Rolling competitive pressure and price response of each row."""
    out = w.rolling_elasticity(w.cannibal_pressure(panel, donors="top_donor_units_sum"))
    known = F.col("top_donor_units_sum").isNotNull()
    return out.select(
        *[c for c in out.columns if not c.startswith("rolling_cannibal")],
        *[F.when(known, F.col(c)).alias(c)
          for c in ("rolling_cannibal_pressure", "rolling_cannibal_trend")],
    )


def add_history(panel: DataFrame) -> DataFrame:
    """Lags and differences that a model may use for the row's own week."""
    lags = {"base_units": (1, 2, 3, 4, 13, 52), "total_units": (1, 4, 13, 52),
            "avg_weekly_units_spm": (52,)}
    s = w.series()
    return panel.select(
        "*",
        *[F.lag(c, k).over(s).alias(f"{c}_lag{k}") for c, ks in lags.items() for k in ks],
        (F.col("tdp") - F.lag("tdp", 1).over(s)).alias("tdp_wow_delta"),
        (F.col("tdp") - F.lag("tdp", 4).over(s)).alias("tdp_4w_momentum"),
        *[(F.col(c) - F.lag(c).over(s)).alias(n) for c, n in (
            ("top_donor_units_sum", "top_donor_units_wow"),
            ("competitor_donor_units_sum", "competitor_donor_units_wow"),
            ("own_donor_units_sum", "own_donor_units_wow"))],
        # measures of the row's own week would give the target away; models use last week's
        *[F.lag(c).over(s).alias(f"prev_{c}")
          for c in ("base_units_roll4_avg", "base_units_roll8_avg", "base_units_roll13_avg",
                    "base_units_z13", "tdp_z8", "avg_weekly_units_spm")],
    )


def forecast_panel(
    events: DataFrame, prepost: DataFrame, scored: DataFrame, rates: DataFrame,
    elasticity: DataFrame, category: DataFrame, cfg: RetailConfig, min_weeks: int = 13,
    top_donors: int = 3,
) -> DataFrame:
    """One row per own series and week with every signal attached.

    `events`: event-detection rows of all products. `elasticity`: series keys and
    implied_elasticity. Left joins keep every panel row; absence means zero only for counts,
    probabilities and rates.
    """
    own = own_scored(events, cfg)
    meta = prepost.select(*SERIES_KEYS, F.col("post_13w_arp").alias("launch_arp"))
    p = own.join(meta, SERIES_KEYS, "left").withColumn("total_units", F.coalesce("units", "base_units"))
    p = price_cascade(p).withColumn(
        "weeks_since_launch",
        F.greatest(F.coalesce(weeks_between("week", "first_week_selling"), F.lit(0)), F.lit(0)),
    )
    ranked = rank_donors(scored)
    donors = ranked.groupBy(F.col("focal_upc").alias("upc"), *MARKET_KEYS).agg(
        F.max("transfer_prob").alias("max_donor_prob"),
        F.count(F.lit(1)).alias("donor_count"),
        F.count_if(F.col("donor_brand") == cfg.own_parent).alias("own_donor_count"),
    )
    rate = rates.select(
        "week", F.col("focal_upc").alias("upc"), *MARKET_KEYS,
        F.col("cannibalization_rate").alias("cannibal_rate"))
    signals = donor_signals(ranked.where(F.col("donor_rank") <= top_donors), category, cfg)
    p = (
        p.join(donors, SERIES_KEYS, "left")
        .join(elasticity, SERIES_KEYS, "left")
        .join(rate, ["week", *SERIES_KEYS], "left")
        .join(signals, ["week", *SERIES_KEYS], "left")
        .na.fill(0, ["max_donor_prob", "donor_count", "own_donor_count", "cannibal_rate"])
    )
    p = category_share(p, category).withColumn(
        "competitor_price_gap", F.col("arp") - F.col("competitor_donor_arp_wavg"))
    p = promo_signals(price_change_bin(calendar_features(add_history(p))))
    p = rolling_signals(p)
    return w.min_history(p, min_weeks).where(F.col("base_units_lag1").isNotNull())


def event_context(panel: DataFrame, launch_weeks: int = 26, price_move: float = 0.05) -> Column:
    """Rows inside a launch window or with a notable price move."""
    return (F.col("weeks_since_launch") <= launch_weeks) | (
        F.abs("arp_pct_change") >= price_move)


def future_frame(panel: DataFrame, horizon: int = 13) -> DataFrame:
    """One row per series and forecast week with the covariates known in advance."""
    keep = ["pack_count", "arp", "tdp", "weeks_since_launch"]
    anchor = panel.groupBy(*SERIES_KEYS).agg(
        F.max("week").alias("anchor_week"), *[F.max_by(c, "week").alias(c) for c in keep])
    steps = anchor.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("forecast_week_number"))
    rows = steps.select(
        *SERIES_KEYS, "forecast_week_number",
        F.date_add("anchor_week", F.col("forecast_week_number") * 7).alias("week"),
        "pack_count", "arp", "tdp",
        (F.col("weeks_since_launch") + F.col("forecast_week_number")).alias("weeks_since_launch"),
    )
    return calendar_features(rows)


def forecast_velocity(forecast: DataFrame, panel: DataFrame, min_tdp: float = 0.5) -> DataFrame:
    """Forecast units per mean reach of the last year; no value on thin distribution."""
    keys = ["upc", "channel_outlet", "retail_account"]
    anchor = panel.where(F.col("tdp") > 0).groupBy(*keys).agg(F.avg("tdp").alias("avg_tdp_anchor"))
    by = ["forecast_week_number", *keys]
    f = forecast.groupBy(*by).agg(
        *[F.avg(f"forecast_units_{q}").alias(f"forecast_units_{q}") for q in ("low", "base", "high")])
    wide = F.when(F.col("avg_tdp_anchor") >= min_tdp, F.col("avg_tdp_anchor"))
    return f.join(anchor, keys, "left").select(
        *by, "avg_tdp_anchor",
        *[safe_div(f"forecast_units_{q}", wide).alias(f"forecast_vel_{q}")
          for q in ("low", "base", "high")])


def sku_contribution(panel: DataFrame) -> DataFrame:
    """Share of an account in a product's base dollars."""
    by = panel.groupBy("upc", "retail_account").agg(F.sum("base_dollars").alias("base_dollars"))
    total = by.groupBy("upc").agg(F.sum("base_dollars").alias("_t"))
    return by.join(total, "upc").select(
        "upc", "retail_account", "base_dollars",
        safe_div("base_dollars", "_t").alias("sku_contribution"))


def promo_roi(summary: DataFrame, panel: DataFrame, spend: float) -> DataFrame:
    """Expected dollars of a promotion: lift x base units x price, against its cost."""
    base = panel.groupBy("upc", "channel_outlet", "retail_account").agg(
        F.avg("base_units").alias("avg_base_units"), F.avg("arp").alias("avg_arp"))
    dollars = F.col("best_lift_estimate") * F.col("avg_base_units") * F.col("avg_arp")
    return summary.join(base, ["upc", "channel_outlet", "retail_account"]).select(
        "upc", "channel_outlet", "retail_account", "discount_bucket", "best_lift_estimate",
        dollars.alias("expected_lift_dollars"),
        safe_div(dollars - spend, F.lit(float(spend))).alias("promo_roi"))
