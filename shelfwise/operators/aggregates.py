"""Shares, donor signals, summaries and pack-family features (group D, E17, E18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import clamp, flag, safe_div, weighted_avg
from shelfwise.operators.enrich import is_own
from shelfwise.scale import exact_quantiles, join_null_safe
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS, SERIES_KEYS


def category_share(own: DataFrame, category: DataFrame) -> DataFrame:
    """Category totals per market-week and the product's share of shelf points."""
    totals = category.groupBy(*MARKET_WEEK_KEYS).agg(
        F.sum("tdp").alias("category_tdp_sum"), F.sum("base_units").alias("category_units_sum"))
    return own.join(totals, MARKET_WEEK_KEYS, "left").withColumn(
        "own_tdp_share",
        clamp(F.col("tdp") / F.greatest("category_tdp_sum", F.lit(0.001)), 0.0, 1.0),
    )


def donor_signals(top_donors: DataFrame, panel: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Weekly reach, units and weighted price of a product's top donors.

    One aggregation; own and foreign donors are conditional sums of it. `top_donors`: focal_upc,
    donor_upc, market keys.
    """
    weeks = panel.select(
        "week", F.col("upc").alias("donor_upc"), *MARKET_KEYS, is_own(cfg).alias("_own"),
        "tdp", "base_units", "arp",
    )
    rows = top_donors.select("focal_upc", "donor_upc", *MARKET_KEYS).join(
        weeks, ["donor_upc", *MARKET_KEYS])

    def only(own: bool, c: str) -> Column:
        return F.when(F.col("_own") == own, F.col(c))

    agg = rows.groupBy("week", "focal_upc", *MARKET_KEYS).agg(
        F.sum("tdp").alias("top_donor_tdp_sum"),
        F.sum("base_units").alias("top_donor_units_sum"),
        weighted_avg("arp", "tdp").alias("top_donor_arp_wavg"),
        F.sum(only(False, "tdp")).alias("competitor_donor_tdp_sum"),
        F.sum(only(False, "base_units")).alias("competitor_donor_units_sum"),
        weighted_avg(only(False, "arp"), only(False, "tdp")).alias("competitor_donor_arp_wavg"),
        F.sum(only(True, "tdp")).alias("own_donor_tdp_sum"),
        F.sum(only(True, "base_units")).alias("own_donor_units_sum"),
    )
    return agg.withColumnRenamed("focal_upc", "upc")


def mix_share(panel: DataFrame) -> DataFrame:
    """Share of a product in its flavor's pack set, and of a channel in its product's week."""
    pack_keys = [*MARKET_WEEK_KEYS, "specific_flavor_normalized"]
    pack = panel.groupBy(*pack_keys).agg(
        F.sum("units").alias("_pu"), F.sum("base_units").alias("_pb"))
    item = panel.groupBy("week", "upc").agg(F.sum("units").alias("_iu"))
    return join_null_safe(panel, pack, pack_keys).join(item, ["week", "upc"]).select(
        "week", *SERIES_KEYS,
        safe_div("units", "_pu").alias("pack_mix_share"),
        safe_div("base_units", "_pb").alias("pack_mix_base_share"),
        safe_div("units", "_iu").alias("channel_mix_share"),
    )


def newest_week(panel: DataFrame) -> Column:
    """Newest week of a table as a scalar subquery (no collect on the driver)."""
    return panel.agg(F.max("week").alias("m")).scalar()


def category_summary(panel: DataFrame, weeks: int = 13) -> DataFrame:
    """The last weeks of every selling product per channel and account."""
    recent = panel.where(
        (F.col("base_units") > 0) & (F.col("week") >= F.date_sub(newest_week(panel), 7 * weeks)))
    return recent.groupBy("upc", "channel_outlet", "retail_account").agg(
        F.sum("base_units").alias("base_units_13w"),
        F.avg("avg_weekly_units_spm").alias("avg_velocity_spm"),
        F.avg("tdp").alias("avg_tdp"), F.avg("pct_stores_selling").alias("avg_pct_stores"),
        F.avg("arp").alias("avg_arp"), F.count_distinct("week").alias("weeks_present"),
    )


def velocity_summary(panel: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """13- and 52-week velocity per product, channel and account.

    `forecast`: upc, channel_outlet, retail_account, forecast_vel_base; its mean is dropped where
    it exceeds five times the best actual week. Groups hold at most 53 weeks per market.
    """
    keys = ["upc", "channel_outlet", "retail_account"]
    last = newest_week(panel)
    rows = panel.where((F.col("base_units") > 0) & (F.col("week") >= F.date_sub(last, 364)))
    fresh = F.col("week") >= F.date_sub(last, 91)
    v = F.col("avg_weekly_units_spm")
    s = rows.groupBy(*keys).agg(
        F.avg(F.when(fresh, v)).alias("vel_13w_avg"),
        F.count(F.when(fresh, v)).alias("weeks_13"),
        F.avg(v).alias("vel_52w_avg"), F.min(v).alias("vel_52w_min"),
        F.max(v).alias("vel_52w_max"), F.median(v).alias("vel_52w_med"),
    ).where(F.col("weeks_13") > 0)
    if forecast is None:
        return s
    f = forecast.groupBy(*keys).agg(F.avg("forecast_vel_base").alias("_f"))
    return s.join(f, keys, "left").select(
        *s.columns, F.when(F.col("_f") <= 5 * F.col("vel_52w_max"), F.col("_f")).alias("fct_vel_avg"))


def retailer_summary(panel: DataFrame, events: DataFrame, cfg: RetailConfig, as_of) -> DataFrame:
    """Account scorecard of own products: 13-week and year-to-date dollars, active events."""
    rows = panel.where(is_own(cfg) & (F.col("week") <= F.lit(as_of)))
    last13 = F.col("week") > F.date_sub(F.lit(as_of), 91)
    ytd = F.year("week") == F.year(F.lit(as_of))
    sales = rows.groupBy("retail_account").agg(
        F.sum(F.when(last13, F.col("dollars")).otherwise(0.0)).alias("dollars_13w"),
        F.sum(F.when(ytd, F.col("dollars")).otherwise(0.0)).alias("dollars_ytd"),
        F.count_distinct(F.when(last13, F.col("upc"))).alias("active_skus"),
    )
    n = events.groupBy("retail_account").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("focal_upc").alias("skus_with_issues"))
    return sales.join(n, "retail_account", "left").na.fill(0, ["n_events", "skus_with_issues"])


def sku_summary(panel: DataFrame, scored: DataFrame, upc: str, as_of) -> DataFrame:
    """One product across accounts with its strongest transfer status."""
    rows = panel.where((F.col("upc") == upc) & (F.col("week") <= F.lit(as_of)))
    last13 = F.col("week") > F.date_sub(F.lit(as_of), 91)
    sales = rows.groupBy("upc", "retail_account", "channel_outlet").agg(
        F.sum(F.when(last13, F.col("dollars")).otherwise(0.0)).alias("dollars_13w"),
        F.avg(F.when(last13, F.col("avg_weekly_units_spm"))).alias("velocity_13w"))
    status = scored.groupBy(
        F.col("focal_upc").alias("upc"), "retail_account", "channel_outlet"
    ).agg(F.max("transfer_prob").alias("max_transfer_prob"),
          F.count(F.lit(1)).alias("donor_pairs"))
    return sales.join(status, ["upc", "retail_account", "channel_outlet"], "left")


def pack_family_features(panel: DataFrame) -> DataFrame:
    """Position of a pack inside its brand and flavor on one shelf, and sibling pressure.

    The family is one brand's packs of one flavor in one market-week: a handful of rows.
    """
    keys = [*MARKET_WEEK_KEYS, "parent_brand", "flavor", "specific_flavor_normalized"]
    family = Window.partitionBy(*keys)
    by_pack = family.orderBy("pack_count")
    same = Window.partitionBy(*keys, "pack_count")
    below = by_pack.rangeBetween(Window.unboundedPreceding, -1)
    above = by_pack.rangeBetween(1, Window.unboundedFollowing)
    p, arp = F.col("pack_count"), F.col("arp")
    lo, hi = F.max("pack_count").over(below), F.min("pack_count").over(above)
    lo_arp = F.max_by("arp", F.struct("pack_count", "upc")).over(below)
    hi_arp = F.min_by("arp", F.struct("pack_count", "upc")).over(above)
    take_low = lo.isNotNull() & (hi.isNull() | (p - lo <= hi - p))
    near = F.when(take_low, lo).otherwise(hi)
    near_arp = F.when(take_low, lo_arp).otherwise(hi_arp)

    def siblings(c: str) -> Column:
        return F.sum(c).over(family) - F.sum(c).over(same)

    alt = F.count(F.lit(1)).over(family) - F.count(F.lit(1)).over(same)
    promo = F.col("units_pct_promo")
    return panel.select(
        "week", *SERIES_KEYS, "pack_count",
        F.dense_rank().over(by_pack).alias("pack_rank_within_brand"),
        alt.alias("alt_pack_count"),
        flag(alt > 0).alias("same_flavor_diff_pack_flag"),
        F.abs(p - near).alias("pack_gap_to_nearest"),
        (arp - near_arp).alias("price_gap_to_alt_pack"),
        (safe_div(arp, p) - safe_div(near_arp, near)).alias("price_per_count_gap"),
        safe_div("units", F.sum("units").over(family)).alias("share_of_pack_architecture"),
        siblings("tdp").alias("alt_pack_distribution_pressure"),
        (F.sum(promo).over(family) - F.sum(promo).over(same)).alias("alt_pack_promo_pressure"),
    )


def pack_behaviour(panel: DataFrame) -> DataFrame:
    """Reach and promotion dependence by pack count; medians stay distributed."""
    mean = panel.groupBy("pack_count").agg(
        F.avg("tdp").alias("tdp_by_pack_count"), F.avg("avg_acv").alias("acv_by_pack_count"),
        safe_div(F.sum("units_promo"), F.sum("units")).alias("promo_share_by_pack_count"),
        F.avg("arp_pct_discount_any_promo").alias("promo_discount_by_pack_count"),
        safe_div(F.sum("base_units"), F.sum("units")).alias("base_vs_promo_mix"),
    )
    med = exact_quantiles(panel, ["pack_count"], "tdp", {"median_tdp_by_pack_count": 0.5})
    return mean.join(med, "pack_count")
