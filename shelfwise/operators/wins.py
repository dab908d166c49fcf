"""Weekly wins, pool health and association views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.beta import beta_quantile
from shelfwise.functions.scalar import case, flag, pct_change, safe_div
from shelfwise.operators import windows as w
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS, SERIES_KEYS

PRODUCTIVITY = "avg_weekly_units_spm"


def win_flags(panel: DataFrame) -> DataFrame:
    """Did a product beat its previous four rows; NULL without any baseline."""
    base = {
        "velocity": PRODUCTIVITY, "base_units": "base_units", "dollars": "dollars", "tdp": "tdp",
    }
    prior = w.prior_rows(4)
    df = panel.select(
        "*", *[F.avg(c).over(prior).alias(f"trailing_4w_avg_{n}") for n, c in base.items()]
    )

    def beats(n: str, factor: float = 1.0) -> Column:
        t = F.col(f"trailing_4w_avg_{n}")
        return F.when(
            t.isNotNull(), F.coalesce(F.col(base[n]) > t * factor, F.lit(False))
        )

    promo = F.coalesce((F.col("promo_weeks") > 0) | (F.col("incr_units") > 0), F.lit(False))
    return df.select(
        "*",
        beats("velocity").alias("velocity_win_flag"),
        beats("base_units").alias("base_units_win_flag"),
        beats("dollars").alias("dollars_win_flag"),
        beats("tdp", 1.15).alias("distribution_jump_flag"),
        promo.alias("promo_confounded_flag"),
        # without a baseline the result is unknown, also in a promoted week
        F.when(F.col("trailing_4w_avg_velocity").isNotNull(), beats("velocity") & ~promo).alias(
            "sku_week_win_flag"),
        F.when(
            F.col("trailing_4w_avg_velocity").isNotNull()
            & F.col("trailing_4w_avg_base_units").isNotNull(),
            beats("base_units") & beats("velocity") & ~promo,
        ).alias("quality_win_flag"),
    )


GROUP_KEYS = [*MARKET_WEEK_KEYS, "specific_flavor_normalized", "flavor", "parent_brand"]


def group_wins(flags: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Win counts and totals of a product group per week."""
    won = F.col("sku_week_win_flag")
    return flags.groupBy(*keys).agg(
        F.count(won).alias("active_sku_count"),
        F.count_if(won).alias("weekly_win_count"),
        F.count_if(~won).alias("weekly_loss_count"),
        safe_div(F.count_if(won), F.count(won)).alias("weekly_win_pct"),
        F.sum("units").alias("group_units"),
        F.sum("dollars").alias("group_dollars"),
        F.sum("base_units").alias("group_base_units"),
        F.avg(PRODUCTIVITY).alias("group_avg_velocity"),
        F.sum("tdp").alias("group_tdp"),
    )


def win_association(pool: DataFrame, flags: DataFrame) -> DataFrame:
    """How wins of the focal product and losses of the comparison product coincide."""
    side = flags.select("week", *SERIES_KEYS, "sku_week_win_flag")
    f = side.withColumnsRenamed({"upc": "focal_upc", "sku_week_win_flag": "_f"})
    c = side.withColumnsRenamed({"upc": "candidate_upc", "sku_week_win_flag": "_c"})
    pairs = pool.select(
        *MARKET_WEEK_KEYS, "focal_upc", "candidate_upc", "comparison_type", "relationship_distance"
    )
    j = pairs.join(f, [*MARKET_WEEK_KEYS, "focal_upc"]).join(
        c, [*MARKET_WEEK_KEYS, "candidate_upc"])
    both, opposed = F.col("_f") & F.col("_c"), F.col("_f") & ~F.col("_c")
    s = j.groupBy(
        "focal_upc", F.col("candidate_upc").alias("comparison_upc"), "comparison_type",
        "relationship_distance", *MARKET_KEYS,
    ).agg(
        F.count(F.lit(1)).alias("active_pair_weeks"),
        F.count_if("_f").alias("focal_win_weeks"),
        F.count_if("_c").alias("comparison_win_weeks"),
        F.count_if(~F.col("_c")).alias("_c_losses"),
        F.count_if(both).alias("co_win_weeks"),
        F.count_if(opposed).alias("focal_win_comparison_loss_weeks"),
    )
    given = safe_div("focal_win_comparison_loss_weeks", "focal_win_weeks")
    return s.select(
        "*",
        safe_div("co_win_weeks", "active_pair_weeks").alias("co_win_rate"),
        safe_div("focal_win_comparison_loss_weeks", "active_pair_weeks").alias("opposition_rate"),
        given.alias("comparison_loss_given_focal_win"),
        safe_div(given, safe_div("_c_losses", "active_pair_weeks")).alias("conditional_loss_lift"),
    ).drop("_c_losses")


def pool_pattern(health: DataFrame, flat: float = 0.02, tdp_up: float = 0.15) -> DataFrame:
    """Pattern of a group by its demand change, win share and reach.

    Needs demand_change, tdp_change, weekly_win_pct, focal_won and related_loss_pct.
    """
    up, win = F.col("demand_change") > 0, F.col("weekly_win_pct")
    stealing = (
        F.col("focal_won") & (F.col("related_loss_pct") >= 0.5) & (F.col("demand_change") <= flat)
    )
    return health.withColumn(
        "pattern",
        case(
            [
                (stealing, "Possible Cannibalization"),
                (up & (F.col("tdp_change") > tdp_up) & (win < 0.5), "Distribution-Led Growth"),
                (up & (win >= 0.7), "Broad Growth"),
                (up & (win >= 0.5), "Healthy Mix"),
                (up, "Concentrated Growth"),
                ((F.col("demand_change") < 0) & (win < 0.5), "Portfolio Decline"),
            ],
            "Mixed",
        ),
    )


def concentration(flags: DataFrame, focal: str, keys: Sequence[str] = MARKET_WEEK_KEYS) -> DataFrame:
    """How much of a group's gain one product takes, against the previous row of each."""
    d = F.col("units") - F.lag("units").over(w.series())
    rows = flags.withColumn("_d", d)
    is_focal, won = F.col("upc") == focal, F.col("sku_week_win_flag")
    focal_d = F.sum(F.when(is_focal, F.col("_d")))
    return rows.groupBy(*keys).agg(
        focal_d.alias("focal_units_change"),
        F.sum("_d").alias("group_units_change"),
        safe_div(F.greatest(focal_d, F.lit(0.0)), F.sum(F.when(F.col("_d") > 0, F.col("_d")))).alias(
            "win_concentration_ratio"),
        safe_div(focal_d, F.sum("_d")).alias("focal_share_of_group_gain"),
        safe_div(F.count_if(~is_focal & ~won), F.count(F.when(~is_focal, won))).alias(
            "related_loss_pct"),
        F.max(F.when(is_focal, won)).alias("focal_won"),
    )


def win_cells(flags: DataFrame, flat: float = 0.02) -> DataFrame:
    """One symbol per product and week."""
    base, now = F.col("trailing_4w_avg_velocity"), F.col(PRODUCTIVITY)
    return flags.select(
        "week", *SERIES_KEYS,
        case(
            [
                (base.isNull(), "."),
                (F.col("promo_confounded_flag"), "P"),
                (F.col("distribution_jump_flag"), "D"),
                (F.abs(now - base) <= flat * base, "0"),
                (now > base, "+"),
            ],
            "-",
        ).alias("cell"),
    )


def win_matrix(flags: DataFrame, weeks: Sequence) -> DataFrame:
    """SKU x week matrix of the given weeks. Naming the weeks avoids a pass to find them."""
    cells = win_cells(flags.where(F.col("week").between(min(weeks), max(weeks))))
    labels = [d.isoformat() for d in weeks]
    return cells.withColumn("week", F.col("week").cast("string")).groupBy(*SERIES_KEYS).pivot(
        "week", labels).agg(F.min("cell"))


def relation_map(assoc: DataFrame, min_weeks: int = 8) -> DataFrame:
    """Cell label of a focal x comparison pair."""
    opp, co = F.col("opposition_rate"), F.col("co_win_rate")
    lift, given = F.col("conditional_loss_lift"), F.col("comparison_loss_given_focal_win")
    return assoc.withColumn(
        "relation",
        case(
            [
                (F.col("active_pair_weeks") < min_weeks, "Watch"),
                ((opp >= 0.30) & (lift > 1.1), "Pressure"),
                ((given >= 0.60) & (lift > 1.0), "Donates?"),
                (co >= 0.30, "Co-wins"),
                ((opp < 0.10) & (co < 0.10), "Low"),
            ],
            "Neutral",
        ),
    )


def win_posterior(wins: DataFrame, a0: float = 1.0, b0: float = 1.0, z: float = 1.959964) -> DataFrame:
    """Beta-binomial posterior of the win share; interval by the normal approximation."""
    a, b = F.col("weekly_win_count") + a0, F.col("weekly_loss_count") + b0
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return wins.select(
        "*",
        mean.alias("win_rate_mean"),
        F.greatest(F.lit(0.0), mean - z * sd).alias("win_rate_low"),
        F.least(F.lit(1.0), mean + z * sd).alias("win_rate_high"),
    )


def win_interval(wins: DataFrame, a0: float = 1.0, b0: float = 1.0, level: float = 0.95) -> DataFrame:
    """Beta-binomial posterior of the win share with the equal-tailed interval of the beta distribution itself.

    Small groups get the skewed interval they have; it stays inside 0 and 1 by itself. Null counts give nulls.
    """
    a, b = F.col("weekly_win_count") + a0, F.col("weekly_loss_count") + b0
    return wins.select(
        "*", (a / (a + b)).alias("win_rate_mean"),
        beta_quantile((1 - level) / 2, a, b).alias("win_rate_low"),
        beta_quantile((1 + level) / 2, a, b).alias("win_rate_high"))


def competitor_pressure(pool: DataFrame, cfg: RetailConfig, new_within_weeks: int = 13) -> DataFrame:
    """Similarity-weighted pressure on each own product per market-week."""
    sim = 1 / F.col("relationship_distance")
    foreign = (F.col("focal_brand") == cfg.own_parent) & (F.col("candidate_brand") != cfg.own_parent)
    is_new = F.datediff("week", "candidate_first_week_selling") < 7 * new_within_weeks
    weight = F.sum(sim)
    return pool.where(foreign).groupBy("focal_upc", *MARKET_WEEK_KEYS).agg(
        F.count(F.lit(1)).alias("competitor_count"),
        weight.alias("weighted_competitor_count"),
        F.sum(sim * F.col("candidate_tdp")).alias("weighted_competitor_tdp"),
        safe_div(F.sum(sim * F.col("candidate_units_pct_promo")), weight).alias(
            "weighted_promo_intensity"),
        safe_div(F.sum(sim * F.col("candidate_arp")), weight).alias("weighted_competitor_price"),
        F.min("candidate_arp").alias("min_competitor_price"),
        F.max(flag(is_new)).alias("competitor_new_launch_flag"),
    )


def view_metrics(prepost: DataFrame) -> DataFrame:
    """Change measures, signals and scorecard colour of a series."""

    def per_tdp(side: str) -> Column:
        return safe_div(f"{side}_13w_base_units", f"{side}_13w_tdp")

    base = pct_change("post_13w_base_units", "pre_13w_base_units")
    tdp = pct_change("post_13w_tdp", "pre_13w_tdp")
    prod = pct_change(per_tdp("post"), per_tdp("pre"))
    return prepost.select(
        *SERIES_KEYS,
        (F.col("post_13w_base_units") - F.col("pre_13w_base_units")).alias("change_abs"),
        base.alias("base_units_change_pct"), tdp.alias("tdp_change_pct"),
        prod.alias("units_tdp_change_pct"),
        F.signum(base).alias("demand_signal"), F.signum(tdp).alias("reach_signal"),
        F.signum(prod).alias("productivity_signal"),
        case(
            [((base > 0) & (prod > 0), "Green"), ((base > 0) & (tdp > 0), "Yellow"),
             (base.isNull(), "No data")],
            "Red",
        ).alias("scorecard"),
    )


def incrementality_proxy(pairs: DataFrame) -> DataFrame:
    """Focal change minus the mean change of its donors."""
    return pairs.groupBy("focal_upc", *MARKET_KEYS).agg(
        F.max("focal_base_units_pct_chg").alias("focal_base_units_pct_chg"),
        F.avg("donor_base_units_pct_chg").alias("avg_donor_base_units_pct_chg"),
        (F.max("focal_base_units_pct_chg") - F.avg("donor_base_units_pct_chg")).alias(
            "incrementality_proxy"),
    )


def derived_families(panel: DataFrame) -> DataFrame:
    """Row-level feature families (year on year, reach, promotion, pack, revenue)."""
    yoy = {"units": "units", "base_units": "base_units", "tdp": "tdp",
           "velocity": PRODUCTIVITY, "dollars": "dollars"}
    lift = F.greatest("units_lift_tpr", "units_lift_any_display", "units_lift_any_feature")
    unit_down = F.col("units") < F.col("units_yago")
    return panel.select(
        "week", *SERIES_KEYS,
        *[pct_change(c, f"{c}_yago").alias(f"{n}_yoy_pct") for n, c in yoy.items()],
        (F.col("max_acv") - F.col("avg_acv")).alias("acv_gap"),
        safe_div("incr_units", "units").alias("incr_units_share"),
        lift.alias("promo_lift_max"),
        flag((F.col("units_lift_any_display") > 0) | (F.col("units_lift_any_feature") > 0)).alias(
            "display_or_feature_flag"),
        (1 - safe_div("arp", "base_arp")).alias("discount_depth"),
        safe_div("arp", "pack_count").alias("price_per_pack_unit"),
        safe_div("dollars", "tdp").alias("dollars_per_tdp"),
        flag(unit_down & (F.col("dollars") > F.col("dollars_yago"))).alias(
            "unit_loss_but_dollar_gain_flag"),
    )


def pool_health(flags: DataFrame, focal: str, cfg: RetailConfig) -> DataFrame:
    """Weekly health of all products in a market against the week before, with its pattern."""
    wins = group_wins(flags, MARKET_WEEK_KEYS)
    share = concentration(flags, focal)
    lag = Window.partitionBy(*MARKET_KEYS).orderBy("week")
    joined = wins.join(share, MARKET_WEEK_KEYS).select(
        *MARKET_WEEK_KEYS, "active_sku_count", "weekly_win_count", "weekly_win_pct",
        "win_concentration_ratio", "related_loss_pct",
        F.coalesce("focal_won", F.lit(False)).alias("focal_won"),
        pct_change("group_base_units", F.lag("group_base_units").over(lag)).alias("demand_change"),
        pct_change("group_tdp", F.lag("group_tdp").over(lag)).alias("tdp_change"),
        pct_change(
            safe_div("group_units", "group_tdp"),
            F.lag(safe_div("group_units", "group_tdp")).over(lag),
        ).alias("units_tdp_change"),
    )
    return pool_pattern(joined)
