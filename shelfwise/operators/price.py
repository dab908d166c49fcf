"""Price features, ladders, norms, price events and promotion lift (group I, C6-C8, D9-D10)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DISCOUNT_SHIFT, PROMO_WEEK_SHIFT, RetailConfig
from shelfwise.functions.scalar import (
    case, flag, pack_bucket, pct_change, promo_depth_bucket, protein_tier, safe_div, week_of_year,
    weeks_between,
)
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import attach_tier, excluded_market, is_own, own_scored, price_quality
from shelfwise.scale import exact_quantiles, growing, join_null_safe, sizes_measured, written
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS, PRICE_EVENT_SCHEMA, SERIES_KEYS

#: Fixed value: log price moves from here on are drastic (15 percent).
DRASTIC_LOG_MOVE = math.log(1.15)
#: Fixed value: smallest price move per unit that is more than rounding.
MIN_PRICE_MOVE = 0.05


def price_weekly(enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Price per unit, logs with floors, promotion depth and confounding of own rows."""
    per_unit = safe_div("arp", "pack_count")
    return own_scored(enriched, cfg).where(price_quality(cfg)).select(
        "week", *SERIES_KEYS, "description", "parent_brand", "specific_flavor_normalized", "flavor",
        "pack_count", "first_week_selling",
        per_unit.alias("price_per_unit"),
        safe_div("base_arp", "pack_count").alias("base_price_per_unit"),
        F.ln(F.greatest(per_unit, F.lit(0.01))).alias("ln_price_per_unit"),
        F.ln(F.greatest("base_units", F.lit(1.0))).alias("ln_base_units"),
        F.ln(F.greatest("avg_weekly_units_spm", F.lit(0.01))).alias("ln_velocity_spm"),
        promo_depth_bucket("arp_pct_discount_any_promo").alias("promo_depth_bucket"),
        flag(
            (F.col("promo_weeks") > PROMO_WEEK_SHIFT)
            | (F.col("arp_pct_discount_any_promo") > DISCOUNT_SHIFT)
        ).alias("promo_confounded"),
        week_of_year().alias("week_of_year"),
        pct_change("base_units", "base_units_yago").alias("base_units_yago_pct_chg"),
        "base_units", "units", "tdp", "avg_weekly_units_spm", "pct_stores_selling", "arp",
        "base_arp", "arp_pct_discount_any_promo", "promo_weeks", "incr_units",
    )


def pack_ladder(prices: DataFrame) -> DataFrame:
    """Products of one specific flavor and brand against each other, per market-week."""
    keys = [*MARKET_WEEK_KEYS, "specific_flavor_normalized", "flavor", "parent_brand"]
    own_cols = ["upc", "description", "pack_count", "price_per_unit", "arp", "base_units",
                "avg_weekly_units_spm"]
    f = prices.select(*keys, *[F.col(c).alias(f"focal_{c}") for c in own_cols])
    p = prices.select(*keys, *[F.col(c).alias(f"partner_{c}") for c in own_cols])
    fp, pp = F.col("focal_price_per_unit"), F.col("partner_price_per_unit")
    fn, pn = F.col("focal_pack_count"), F.col("partner_pack_count")
    saving = F.when(pn > fn, safe_div(fp - pp, fp))
    return f.join(p, keys).where(F.col("focal_upc") != F.col("partner_upc")).select(
        "*",
        safe_div(fp - pp, pp).alias("price_per_unit_gap_pct"),
        F.abs(fn - pn).alias("pack_distance"),
        case([(fn < pn, "TRADE_UP_AVAILABLE"), (fn > pn, "TRADE_DOWN_AVAILABLE")], "SAME_PACK").alias(
            "pack_direction"),
        saving.alias("trade_up_savings_pct"),
        flag(saving < 0.10).alias("ladder_compression_flag"),
    )


def competitive_price(prices: DataFrame, filtered: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Own prices against every foreign product of the market-week."""
    rivals = filtered.where(
        ~is_own(cfg) & (F.col("arp") > 0) & (F.col("source_pack_count") > 0) & ~excluded_market(cfg)
    ).select(
        *MARKET_WEEK_KEYS, F.col("upc").alias("competitor_upc"),
        F.col("description").alias("competitor_description"),
        F.col("source_brand").alias("competitor_brand"),
        F.col("flavor_raw").alias("competitor_flavor_raw"),
        F.col("source_pack_count").alias("competitor_pack_count"),
        F.col("arp").alias("competitor_arp"),
        safe_div("arp", "source_pack_count").alias("competitor_price_per_unit"),
        F.col("base_units").alias("competitor_base_units"),
        F.col("avg_weekly_units_spm").alias("competitor_velocity_spm"),
    )
    rivals = attach_tier(rivals, cfg, "competitor_brand", "competitor_tier")
    own = prices.select(
        *MARKET_WEEK_KEYS, F.col("upc").alias("focal_upc"),
        F.col("description").alias("focal_description"), F.col("flavor").alias("focal_flavor"),
        F.col("pack_count").alias("focal_pack_count"),
        F.col("price_per_unit").alias("focal_price_per_unit"),
        F.col("base_units").alias("focal_base_units"),
    )
    gap = safe_div(
        F.col("focal_price_per_unit") - F.col("competitor_price_per_unit"),
        "competitor_price_per_unit",
    )
    same = F.col("focal_flavor") == F.col("competitor_flavor_raw")
    return own.join(rivals, MARKET_WEEK_KEYS).select(
        "*",
        gap.alias("price_gap_pct"),
        flag((F.col("competitor_tier") == 1) & same & (gap >= 0.09)).alias(
            "competitive_gap_watch_flag"),
        F.when(same, "SAME_FLAVOR").otherwise("DIFFERENT_FLAVOR").alias("flavor_relationship"),
    )


def price_windows(prices: DataFrame, min_weeks: int = 8) -> DataFrame:
    """13 weeks ending at the row against the 13 before, by calendar frames.

    Two RANGE windows over the series replace the range self-join; both share one sort.
    """
    post, pre = w.trailing_weeks(-12, 0), w.trailing_weeks(-25, -13)
    avgs = {"avg_price_per_unit": "price_per_unit", "velocity_spm": "avg_weekly_units_spm",
            "arp_discount": "arp_pct_discount_any_promo", "tdp": "tdp"}
    sums = {"base_units": "base_units", "promo_weeks": "promo_weeks"}
    cols = []
    for name, frame in (("post", post), ("pre", pre)):
        cols += [F.avg(c).over(frame).alias(f"{name}_13w_{n}") for n, c in avgs.items()]
        cols += [F.sum(c).over(frame).alias(f"{name}_13w_{n}") for n, c in sums.items()]
        cols.append(F.count("week").over(frame).alias(f"{name}_13w_weeks_count"))
    cols.append(F.stddev_samp("price_per_unit").over(post).alias("post_13w_std_price_per_unit"))
    win = prices.select(
        "week", *SERIES_KEYS, "description", "pack_count", "flavor", "specific_flavor_normalized",
        *cols,
    ).where(
        (F.col("pre_13w_weeks_count") >= min_weeks) & (F.col("post_13w_weeks_count") >= min_weeks)
        & (F.col("pre_13w_base_units") > 0)
    )

    def chg(m: str) -> Column:
        return pct_change(f"post_13w_{m}", f"pre_13w_{m}")

    price = chg("avg_price_per_unit")
    shifted = (
        F.abs(F.col("post_13w_promo_weeks") - F.col("pre_13w_promo_weeks")) > PROMO_WEEK_SHIFT
    ) | (F.abs(F.col("post_13w_arp_discount") - F.col("pre_13w_arp_discount")) > DISCOUNT_SHIFT)
    return win.select(
        "*",
        price.alias("price_pct_chg"),
        chg("base_units").alias("base_units_pct_chg"),
        chg("velocity_spm").alias("velocity_spm_pct_chg"),
        chg("tdp").alias("tdp_pct_chg"),
        flag(shifted).alias("promo_confounded"),
        F.when(F.abs(price) > 0.01, safe_div(chg("base_units"), price)).alias(
            "naive_price_elasticity"),
    )


# ---------------------------------------------------------------- norms, drivers


def category_norms(filtered: DataFrame, cfg: RetailConfig, keys: Sequence[str] = MARKET_WEEK_KEYS) -> DataFrame:
    """Category averages by pack size, own brands excluded, with the median price.

    Groups are one market-week and pack, so bounded by the products on one shelf; use
    `exact_quantiles` for medians of coarser groups.
    """
    ppu = safe_div("arp", "source_pack_count")
    return filtered.where(
        (F.col("subcategory") == cfg.subcategory) & ~is_own(cfg) & ~excluded_market(cfg)
        & (F.col("arp") > 0) & (F.col("source_pack_count") > 0)
    ).groupBy(
        *keys, pack_bucket("source_pack_count").alias("pack_size_bucket"),
        F.col("source_pack_count").alias("pack_count"),
    ).agg(
        F.count_distinct("upc").alias("norm_sku_count"),
        F.avg(ppu).alias("norm_avg_price_per_unit"),
        F.median(ppu).alias("norm_median_price_per_unit"),
        F.avg("avg_weekly_units_spm").alias("norm_avg_velocity_spm"),
        F.avg("avg_weekly_units_per_store_selling_per_item").alias(
            "norm_avg_velocity_store_selling"),
        F.avg("pct_stores_selling").alias("norm_avg_pct_stores_selling"),
        F.avg("tdp").alias("norm_avg_tdp"),
    )


def pack_norms(competitive: DataFrame, min_skus: int = 3) -> DataFrame:
    """Median price and velocity by pack at account, channel and overall scope.

    Each product counts once per market. A coarse scope can hold any number of products, so
    medians come from `exact_quantiles`. Step discount compares with the single pack of the scope.
    """
    item = competitive.where(F.col("competitor_price_per_unit").isNotNull()).groupBy(
        *MARKET_KEYS, "competitor_upc", "competitor_pack_count"
    ).agg(
        F.avg("competitor_price_per_unit").alias("price"),
        F.avg("competitor_velocity_spm").alias("velocity"),
    )
    # one row per product and market; counts and both medians scan it, the price join runs once
    item = written(item)
    scopes = F.array(
        F.struct(F.lit("account").alias("norm_scope"), F.col("channel_outlet").alias("ch"),
                 F.col("retail_account").alias("ac")),
        F.struct(F.lit("channel").alias("norm_scope"), F.col("channel_outlet").alias("ch"),
                 F.lit("ALL").alias("ac")),
        F.struct(F.lit("overall").alias("norm_scope"), F.lit("ALL").alias("ch"),
                 F.lit("ALL").alias("ac")),
    )
    keys = ["norm_scope", "channel_outlet", "retail_account", "pack_count"]
    spread = item.select(
        F.explode(scopes).alias("s"), F.col("competitor_pack_count").alias("pack_count"),
        "competitor_upc", "price", "velocity",
    ).select(
        F.col("s.norm_scope").alias("norm_scope"), F.col("s.ch").alias("channel_outlet"),
        F.col("s.ac").alias("retail_account"), "pack_count", "competitor_upc", "price", "velocity",
    )
    counts = spread.groupBy(*keys).agg(F.count_distinct("competitor_upc").alias("norm_sku_count"))
    price = exact_quantiles(spread, keys, "price", {"norm_median_price": 0.5})
    velocity = exact_quantiles(spread, keys, "velocity", {"norm_median_velocity": 0.5})
    norms = counts.where(F.col("norm_sku_count") >= min_skus).join(growing(price), keys).join(
        growing(velocity), keys, "left")
    # a scope has few keys or as many as there are accounts, with few values each or most of them
    with sizes_measured(item.sparkSession):
        norms = written(norms)
    return step_discount(norms).withColumn("pack_size_bucket", pack_bucket("pack_count", "range"))


def step_discount(norms: DataFrame, price: str = "norm_median_price") -> DataFrame:
    """Discount of a pack against the single pack in the same scope (a handful of rows each)."""
    scope = Window.partitionBy("norm_scope", "channel_outlet", "retail_account")
    single = F.max(F.when(F.col("pack_count") == 1, F.col(price))).over(scope)
    return norms.withColumn(
        "step_discount_vs_1ct",
        F.when(F.col("pack_count") != 1, safe_div(single - F.col(price), single)),
    )


def norm_lookup(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """The narrowest published norm for a market and pack: account, channel, then overall."""
    val = ["norm_median_price", "norm_median_velocity"]

    def scope(name: str, keys: list[str], tag: str) -> DataFrame:
        return norms.where(F.col("norm_scope") == name).select(
            *keys, "pack_count", *[F.col(v).alias(f"{tag}_{v}") for v in val])

    out = rows.join(growing(scope("account", ["channel_outlet", "retail_account"], "_a")),
                    ["channel_outlet", "retail_account", "pack_count"], "left")
    out = out.join(scope("channel", ["channel_outlet"], "_c"), ["channel_outlet", "pack_count"], "left")
    out = out.join(scope("overall", [], "_o"), ["pack_count"], "left")
    used = case(
        [(F.col("_a_norm_median_price").isNotNull(), "account"),
         (F.col("_c_norm_median_price").isNotNull(), "channel"),
         (F.col("_o_norm_median_price").isNotNull(), "overall")],
        None,
    )
    return out.select(
        *rows.columns, used.cast("string").alias("norm_scope"),
        *[F.coalesce(f"_a_{v}", f"_c_{v}", f"_o_{v}").alias(v) for v in val],
    )


def driver_features(filtered: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Velocity and penetration against the flavor group of the market-week; protein tier.

    Group means are aggregated and joined back, which pre-aggregates before the shuffle; a window
    would move every row of a hot group to one task.
    """
    keys = [*MARKET_WEEK_KEYS, "flavor_raw"]
    rows = filtered.where(
        (F.col("subcategory") == cfg.subcategory) & ~excluded_market(cfg) & (F.col("arp") > 0)
        & (F.col("source_pack_count") > 0) & F.col("nfp_protein").isNotNull()
    )
    means = rows.groupBy(*keys).agg(
        F.avg("avg_weekly_units_spm").alias("_v"), F.avg("pct_stores_selling").alias("_p"))
    return join_null_safe(rows, means, keys).select(
        "week", *SERIES_KEYS, "source_brand", "flavor_raw", "nfp_protein", "nfp_protein_range",
        safe_div("arp", "source_pack_count").alias("price_per_unit"),
        safe_div("avg_weekly_units_spm", "_v").alias("velocity_flavor_index"),
        protein_tier("nfp_protein_range").alias("protein_tier"),
        safe_div("pct_stores_selling", "_p").alias("penetration_flavor_index"),
    )


# ---------------------------------------------------------------- elasticity frame and score


def elasticity_frame(windows: DataFrame, guard: bool = True) -> DataFrame:
    """I8: log price and unit changes; `guard` keeps real price moves only."""
    post, pre = F.col("post_13w_avg_price_per_unit"), F.col("pre_13w_avg_price_per_unit")
    out = windows.select(
        "*",
        F.ln(F.greatest(post, F.lit(0.01)) / F.greatest(pre, F.lit(0.01))).alias("log_price_change"),
        F.ln((F.col("post_13w_base_units") + 1) / (F.col("pre_13w_base_units") + 1)).alias(
            "log_unit_change"),
        (F.abs(post - pre) >= MIN_PRICE_MOVE).alias("real_price_move"),
    )
    return out.where("real_price_move") if guard else out


def elasticity_score(frame: DataFrame, predicted: str = "predicted_log_unit_change") -> DataFrame:
    """Predicted unit change over price change, in bands."""
    e = F.when(F.col("real_price_move"), safe_div(predicted, "log_price_change"))
    band = case(
        [(e <= -2, "Highly Elastic"), (e <= -1, "Elastic"), (e <= -0.5, "Moderately Elastic"),
         (e <= 0, "Inelastic"), (e > 0, "Positive")],
        "Insufficient Price Variation",
    )
    return frame.select("*", e.alias("implied_elasticity"), band.alias("elasticity_band"))


#: Price change per scenario, and half width of the unit band per elasticity band.
SCENARIOS = [("low", -0.10), ("base", 0.0), ("high", 0.10)]
BAND_WIDTH = {"Highly Elastic": 0.25, "Elastic": 0.20, "Moderately Elastic": 0.15,
              "Inelastic": 0.10, "Positive": 0.20}


def price_scenarios(scored: DataFrame) -> DataFrame:
    """Unit forecast under the three price scenarios."""
    rows = scored.where(
        F.col("post_13w_avg_price_per_unit").isNotNull() & F.col("pre_13w_velocity_spm").isNotNull()
        & F.col("implied_elasticity").between(-10, 5)
    )
    scenario = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario_name"), F.lit(p).alias("price_change_pct"))
        for n, p in SCENARIOS
    ]))
    width = case([(F.col("elasticity_band") == b, v) for b, v in BAND_WIDTH.items()], 0.15)
    pct = F.col("implied_elasticity") * F.col("price_change_pct")
    units = F.greatest(F.col("pre_13w_velocity_spm") * (1 + pct), F.lit(0.0))
    return rows.select("*", scenario.alias("_s")).select(
        "*", F.col("_s.scenario_name").alias("scenario_name"),
        F.col("_s.price_change_pct").alias("price_change_pct"),
    ).select(
        "week", *SERIES_KEYS, "scenario_name",
        (F.col("post_13w_avg_price_per_unit") * (1 + F.col("price_change_pct"))).alias("price_input"),
        pct.alias("forecast_pct_change"), units.alias("forecast_units"),
        (units * (1 - width)).alias("confidence_band_low"),
        (units * (1 + width)).alias("confidence_band_high"),
    )


# ---------------------------------------------------------------- price events


def price_event(df: DataFrame, **cols) -> DataFrame:
    """Project detector hits onto the shared event shape; columns not given are NULL."""
    out = []
    for f in PRICE_EVENT_SCHEMA.fields:
        c = cols.get(f.name)
        c = F.lit(None) if c is None else (c if isinstance(c, Column) else F.lit(c))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _where() -> dict[str, Column]:
    return {k: F.col(k) for k in MARKET_KEYS}


def _pct_text(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", x)


def ev_price_gap(competitive: DataFrame) -> DataFrame:
    """Own products that on average sit 9 percent above a tier-one rival of the flavor."""
    g = competitive.where(
        (F.col("competitive_gap_watch_flag") == 1) & (F.col("flavor_relationship") == "SAME_FLAVOR")
    ).groupBy("focal_upc", "focal_description", *MARKET_KEYS).agg(
        F.max("week").alias("week"), F.min("competitor_brand").alias("_brand"),
        F.avg("price_gap_pct").alias("_gap"),
    ).where(F.col("_gap") >= 0.09)
    return price_event(
        g, week=F.col("week"), focal_upc=F.col("focal_upc"),
        focal_description=F.col("focal_description"), **_where(),
        event_type="COMPETITIVE_PRICE_GAP",
        event_label=F.concat(F.lit("Price gap: "), F.col("focal_description"), F.lit(" vs "),
                             F.col("_brand"), F.lit(" — gap "), _pct_text(F.col("_gap") * 100),
                             F.lit("%")),
        event_color="red", confidence="High", trigger_value=F.col("_gap"),
        trigger_column="price_gap_pct", source_table="competitive_price_weekly",
        scoring_window="13w",
    )


def ev_compression(ladder: DataFrame) -> DataFrame:
    """Trade-up offers that save less than ten percent per unit."""
    g = ladder.where(
        (F.col("ladder_compression_flag") == 1) & (F.col("pack_direction") == "TRADE_UP_AVAILABLE")
    ).groupBy("focal_upc", "focal_description", *MARKET_KEYS).agg(
        F.max("week").alias("week"), F.min("partner_description").alias("_partner"),
        F.avg("trade_up_savings_pct").alias("_save"),
    )
    return price_event(
        g, week=F.col("week"), focal_upc=F.col("focal_upc"),
        focal_description=F.col("focal_description"), **_where(),
        event_type="PACK_LADDER_COMPRESSION",
        event_label=F.concat(F.lit("Pack ladder compression: "), F.col("focal_description"),
                             F.lit(" → "), F.col("_partner"),
                             F.lit(" per-unit gap below 10%")),
        event_color="blue", confidence="Medium", trigger_value=F.col("_save"),
        trigger_column="trade_up_savings_pct", source_table="pack_ladder_weekly",
        scoring_window="13w",
    )


def ev_drastic(scored: DataFrame) -> DataFrame:
    """Price moves of at least two dollars per unit or 15 percent."""
    hit = (
        F.abs(F.col("post_13w_avg_price_per_unit") - F.col("pre_13w_avg_price_per_unit")) >= 2.0
    ) | (F.abs("log_price_change") >= DRASTIC_LOG_MOVE)
    pct = F.round(F.col("log_price_change") * 100, 1)
    return price_event(
        scored.where(hit), week=F.col("week"), focal_upc=F.col("upc"),
        focal_description=F.col("description"), **_where(), event_type="DRASTIC_PRICE_CHANGE",
        event_label=F.concat(
            F.lit("ARP "), _pct_text(F.abs(pct)), F.lit("% "),
            F.when(pct > 0, "increase").otherwise("decrease"), F.lit(" detected (13w window)")),
        event_color="amber", confidence=F.col("elasticity_band"), trigger_value=pct,
        trigger_column="log_price_change", source_table="scored_price_elasticity",
        scoring_window="13w", focal_pack_count=F.col("pack_count"),
    )


def ev_breakpoint(scored: DataFrame) -> DataFrame:
    """Drastic moves inside promoted windows with a plausible response."""
    hit = (
        (F.col("promo_confounded") == 1) & (F.abs("log_price_change") >= DRASTIC_LOG_MOVE)
        & (F.col("elasticity_band") != "Positive")
    )
    return price_event(
        scored.where(hit), week=F.col("week"), focal_upc=F.col("upc"),
        focal_description=F.col("description"), **_where(), event_type="PROMO_RESPONSE_BREAKPOINT",
        event_label="Significant price shift during promo-confounded window",
        event_color="amber", confidence=F.col("elasticity_band"),
        trigger_value=F.round(F.col("log_price_change") * 100, 1),
        trigger_column="promo_confounded+log_price_change",
        source_table="scored_price_elasticity", scoring_window="13w",
        focal_pack_count=F.col("pack_count"),
    )


def ev_new_item(ramp: DataFrame) -> DataFrame:
    """Newest row of each launch inside weeks 8 to 12."""
    latest = w.tail_n(ramp.where(F.col("weeks_since_launch").between(8, 12)), 1)
    return price_event(
        latest, week=F.col("week"), focal_upc=F.col("upc"), focal_description=F.col("description"),
        **_where(), event_type="NEW_ITEM_PRICE_BASELINE",
        event_label=F.concat(F.lit("Week "), F.col("weeks_since_launch").cast("string"),
                             F.lit(" — price baseline window open")),
        event_color="amber", confidence=F.coalesce("ramp_confidence", F.lit("Medium")),
        trigger_value=F.coalesce("arp", F.lit(0.0)), trigger_column="weeks_since_launch",
        source_table="ramp_monitor", scoring_window="launch", focal_pack_count=F.col("pack_count"),
    )


def ev_norm_gap(prices: DataFrame, norms: DataFrame) -> DataFrame:
    """I16, C14: newest own price against the newest norm of the market and pack."""
    norm_key = [*MARKET_KEYS, "pack_count"]
    newest = norms.groupBy(*norm_key).agg(
        F.max_by("norm_avg_price_per_unit", "week").alias("_norm"))
    hit = w.tail_n(prices, 1).join(newest, norm_key).withColumn(
        "_index", safe_div("price_per_unit", "_norm")).where(F.col("_index") >= 1.07)
    return price_event(
        hit, week=F.col("week"), focal_upc=F.col("upc"), focal_description=F.col("description"),
        **_where(), event_type="PACK_NORM_GAP",
        event_label=F.concat(F.lit("Own price "), _pct_text((F.col("_index") - 1) * 100),
                             F.lit("% above "), F.col("pack_count").cast("string"),
                             F.lit("-pack norm")),
        event_color="amber", confidence="Medium", trigger_value=F.round("_index", 3),
        trigger_column="price_index_vs_pack_norm", source_table="price_weekly+category_norms",
        scoring_window="13w", focal_pack_count=F.col("pack_count"),
    )


def _pack_label(c: str) -> Column:
    return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("-ct"))).otherwise("pack")


def ev_defense(gaps: DataFrame) -> DataFrame:
    """Gaps of nine percent or more to another brand's product of the same pack.

    `gaps`: week, focal and partner upc, description, pack_count, price_per_unit_gap_pct.
    """
    gap = F.round(F.col("price_per_unit_gap_pct") * 100, 1)
    rows = gaps.where(
        (F.abs("price_per_unit_gap_pct") >= 0.09)
        & (F.coalesce("focal_pack_count", F.lit(0)) == F.coalesce("partner_pack_count", F.lit(0)))
    )
    return price_event(
        rows, week=F.col("week"), focal_upc=F.col("focal_upc"),
        focal_description=F.col("focal_description"), **_where(),
        event_type="PRICE_DEFENSE_OPPORTUNITY",
        event_label=F.concat(
            F.lit("Own "), _pack_label("focal_pack_count"), F.lit(" priced "),
            _pct_text(F.abs(gap)), F.lit("% "), F.when(gap < 0, "below").otherwise("above"),
            F.lit(" "), F.col("partner_description"), F.lit(" "), _pack_label("partner_pack_count"),
            F.lit(" per unit")),
        event_color="amber", confidence="Medium", trigger_value=gap,
        trigger_column="price_per_unit_gap_pct", source_table="competitive_price_weekly",
        scoring_window="13w", focal_pack_count=F.col("focal_pack_count"),
        partner_pack_count=F.col("partner_pack_count"),
        partner_description=F.col("partner_description"),
    )


def ev_overlap(gaps: DataFrame) -> DataFrame:
    """Compressed ladders against a product of another brand.

    `gaps` additionally carries ladder_compression_flag.
    """
    rows = gaps.where(F.col("ladder_compression_flag") == 1)
    return price_event(
        rows, week=F.col("week"), focal_upc=F.col("focal_upc"),
        focal_description=F.col("focal_description"), **_where(), event_type="PRICE_DONOR_OVERLAP",
        event_label=F.concat(
            F.lit("Per-unit price gap with "), F.col("partner_description"), F.lit(" "),
            _pack_label("partner_pack_count"), F.lit(" compressed to "),
            _pct_text(F.abs("price_per_unit_gap_pct") * 100), F.lit("%")),
        event_color="amber", confidence="Medium", trigger_value=F.col("price_per_unit_gap_pct"),
        trigger_column="ladder_compression_flag", source_table="competitive_price_weekly",
        scoring_window="13w", focal_pack_count=F.col("focal_pack_count"),
        partner_pack_count=F.col("partner_pack_count"),
        partner_description=F.col("partner_description"),
    )


def brand_gaps(competitive: DataFrame) -> DataFrame:
    """Newest week of own-against-rival gaps in the shape of I17 and I18."""
    newest = competitive.agg(F.max("week").alias("week"))
    cheaper_big = (F.col("competitor_pack_count") > F.col("focal_pack_count")) & (
        safe_div(F.col("focal_price_per_unit") - F.col("competitor_price_per_unit"),
                 "focal_price_per_unit") < 0.10)
    return competitive.join(newest, "week", "left_semi").select(
        "week", *MARKET_KEYS, "focal_upc", "focal_description", "focal_pack_count",
        F.col("competitor_upc").alias("partner_upc"),
        F.col("competitor_description").alias("partner_description"),
        F.col("competitor_pack_count").alias("partner_pack_count"),
        F.col("price_gap_pct").alias("price_per_unit_gap_pct"),
        flag(cheaper_big & (F.col("flavor_relationship") == "SAME_FLAVOR")).alias(
            "ladder_compression_flag"),
    )


def union_events(*events: DataFrame) -> DataFrame:
    """one queue out of all detectors; they share PRICE_EVENT_SCHEMA."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out


# ---------------------------------------------------------------- promotion lift

#: Discount depth -> bucket code and label, deepest first.
DEPTH_BUCKETS = [(0.30, "30pct_plus", "30%+ off"), (0.20, "20_30pct", "20–30% off"),
                 (0.10, "10_20pct", "10–20% off"), (0.0, "0_10pct", "<10% off")]


def promo_events(filtered: DataFrame, cfg: RetailConfig, discount_scale: float = 1.0,
                 min_base_units: float = 5.0, max_lift: float = 5.0) -> DataFrame:
    """Promoted weeks of own products per account, with observed lift.

    `discount_scale` is what the discount column must be divided by to become a share.
    """
    rows = filtered.where(
        is_own(cfg) & ~F.upper("geography_raw").rlike(cfg.rollup_pattern)
        & ((F.col("incr_units") > 0) | (F.col("arp_pct_discount_any_promo") > 0.05))
    )
    keys = ["week", "upc", "channel_outlet", "retail_account"]
    g = rows.groupBy(*keys).agg(
        F.max_by("description", "geography_raw").alias("description"),
        F.sum("base_units").alias("base_units"), F.sum("incr_units").alias("incr_units"),
        F.sum("units").alias("total_units"),
        (safe_div(F.sum(F.col("arp_pct_discount_any_promo") * F.col("units")), F.sum("units"))
         / discount_scale).alias("discount_depth"),
        F.avg("units_lift_tpr").alias("lift_tpr"),
        F.avg("units_lift_any_display").alias("lift_display"),
        F.avg("units_lift_any_feature").alias("lift_feature"),
        F.avg("arp").alias("arp"), F.avg("base_arp").alias("base_arp"), F.avg("tdp").alias("tdp"),
    )
    lift = F.when(
        (F.col("base_units") > min_base_units) & (F.col("incr_units") > 0),
        F.least(safe_div("incr_units", "base_units"), F.lit(max_lift)),
    )
    d = F.col("discount_depth")
    none = d.isNull() | (d <= 0)
    tpr, dis, fea = (F.coalesce(c, F.lit(0.0)) for c in ("lift_tpr", "lift_display", "lift_feature"))
    best = F.greatest(tpr, dis, fea)
    return g.select(
        "*",
        lift.alias("lift_rate_obs"),
        case([(none, "no_promo")] + [(d >= t, c) for t, c, _ in DEPTH_BUCKETS], "0_10pct").alias(
            "discount_bucket"),
        case([(none, "No price reduction")] + [(d >= t, lab) for t, _, lab in DEPTH_BUCKETS],
             "<10% off").alias("discount_label"),
        case([(best <= 0, "Unknown"), (tpr == best, "TPR"), (dis == best, "Display")],
             "Feature").alias("dominant_mechanic"),
    )


def promo_lift_summary(events: DataFrame, causal: DataFrame | None = None) -> DataFrame:
    """Lift statistics per product, account and discount bucket; causal estimate first.

    Groups hold one row per week, so percentiles are over a bounded buffer. `causal`: upc,
    channel_outlet, retail_account, causal_impact_pct, robust_verdict.
    """
    keys = ["retail_account", "channel_outlet", "upc", "discount_bucket", "discount_label"]
    # most frequent mechanic; ties by name
    mech = events.groupBy(*keys, "dominant_mechanic").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        *keys).agg(F.min_by("dominant_mechanic", F.struct(-F.col("_n"), "dominant_mechanic")).alias(
            "dominant_mechanic"))
    s = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_promo_weeks"),
        F.avg("lift_rate_obs").alias("lift_rate_mean"),
        F.percentile("lift_rate_obs", 0.5).alias("lift_rate_median"),
        F.percentile("lift_rate_obs", 0.25).alias("lift_rate_p25"),
        F.percentile("lift_rate_obs", 0.75).alias("lift_rate_p75"),
        F.avg("discount_depth").alias("discount_avg"), F.avg("arp").alias("arp_avg"),
        F.max("week").alias("most_recent_promo"),
    ).join(mech, keys)
    if causal is None:
        return s.select("*", F.col("lift_rate_mean").alias("best_lift_estimate"),
                        F.lit("observational").alias("estimate_source"))
    joined = s.join(causal, ["upc", "channel_outlet", "retail_account"], "left")
    known = F.col("causal_impact_pct").isNotNull()
    return joined.select(
        "*",
        F.when(known, F.col("causal_impact_pct")).otherwise(F.col("lift_rate_mean")).alias(
            "best_lift_estimate"),
        F.when(known, F.concat(F.lit("causal_"), F.lower("robust_verdict"))).otherwise(
            "observational").alias("estimate_source"),
    )


def bucket_lists(summary: DataFrame) -> DataFrame:
    """The (at most five) discount buckets of a product and account as one sorted list."""
    entry = F.struct(
        F.col("discount_bucket").alias("bucket"), F.col("n_promo_weeks").alias("n"),
        F.round("lift_rate_mean", 4).alias("lift_mean"),
        F.col("dominant_mechanic").alias("mechanic"),
    )
    return summary.groupBy("retail_account", "channel_outlet", "upc").agg(
        F.sort_array(F.collect_list(entry)).alias("buckets"))


def promo_gap(panel: DataFrame) -> DataFrame:
    """Promoted part of demand: total minus base, and its share."""
    gap = F.col("total_units") - F.col("base_units")
    return panel.select(
        "week", *SERIES_KEYS, gap.alias("promo_gap_units"),
        safe_div(gap, "total_units").alias("promo_gap_share"),
    )


# ---------------------------------------------------------------- account price response


def ols_slope2(df: DataFrame, keys: Sequence[str], y: str, x: str, z: Sequence[str], min_rows: int) -> DataFrame:
    """Coefficient of x in y ~ 1 + x + z.., per key, with its standard error.

    One aggregation of co-moments (map-side combined), then symmetric sweeps on the small matrix
    as column arithmetic.
    """
    names = [x, *z]
    p = len(names)
    rows = df.select(*keys, y, *names).na.drop()
    cols = [*names, y]
    n = F.count(F.lit(1))
    # covar_samp merges partial moments, so nothing is centred by a second pass over the rows
    prods = [(F.covar_samp(cols[i], cols[j]) * (n - 1)).alias(f"s{i}_{j}")
             for i in range(p + 1) for j in range(i, p + 1)]
    return slope_of_moments(rows.groupBy(*keys).agg(n.alias("n"), *prods).where(F.col("n") >= min_rows), keys, p)


def slope_of_moments(s: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Coefficient and standard error of the first of `p` regressors, from centred sums.

    `s`: keys, n and the sums of products s{i}_{j}, i <= j, of the regressors and y (index p).
    """
    # eliminate the confounders, the last name first, leaving the system of x alone
    for k in range(p - 1, 0, -1):
        pivot = F.col(f"s{k}_{k}")
        ok = pivot > 1e-9

        def entry(i: int, j: int) -> Column:
            return F.col(f"s{min(i, j)}_{max(i, j)}")

        s = s.select(
            *keys, "n",
            *[
                F.when(ok, entry(i, j) - entry(i, k) * entry(k, j) / F.when(ok, pivot))
                .otherwise(entry(i, j)).alias(f"s{i}_{j}")
                for i in [*range(k), p] for j in [*range(k), p] if i <= j
            ],
        )
    sxx, sxy, syy = F.col("s0_0"), F.col(f"s0_{p}"), F.col(f"s{p}_{p}")
    slope = F.when(sxx > 1e-9, F.try_divide(sxy, sxx))
    rss = F.greatest(syy - slope * sxy, F.lit(0.0))
    return s.select(
        *keys, "n", slope.alias("coef"),
        F.when(F.col("n") > p + 1, F.sqrt(F.try_divide(rss / (F.col("n") - p - 1), sxx))).alias("se"),
    )


#: Confounders of the price response that every panel row carries.
CONFOUNDERS = ("tdp", "weeks_since_launch", "pack_count", "week_of_year")


def response_rows(prices: DataFrame, moved_only: bool = True) -> DataFrame:
    """Log units, log price and confounders of weeks with a genuine price move (or of all weeks).

    Genuine means five cents or 2.5 percent against the previous row of the series.
    """
    before = F.lag("arp").over(w.series())
    rows = prices.select("*", F.abs(F.col("arp") - before).alias("_move"), before.alias("_before"))
    genuine = (F.col("_move") >= MIN_PRICE_MOVE) | (safe_div("_move", "_before") >= 0.025)
    return rows.where(
        (genuine if moved_only else F.lit(True)) & (F.col("base_units") > 0) & (F.col("arp") > 0)
    ).select(
        "week", *SERIES_KEYS, "promo_confounded",
        F.ln("base_units").alias("y"), F.ln("arp").alias("x"),
        F.col("tdp").cast("double").alias("tdp"),
        weeks_between("week", "first_week_selling").cast("double").alias("weeks_since_launch"),
        F.col("pack_count").cast("double").alias("pack_count"),
        F.col("week_of_year").cast("double").alias("week_of_year"),
    )


def account_elasticity(
    prices: DataFrame, keys: Sequence[str] = ("retail_account",), min_rows: int = 20, min_history: int = 30
) -> DataFrame:
    """Log-log price response per account given the confounders, on genuine price moves.

    An account needs `min_history` complete rows before, and `min_rows` after, only genuine moves
    are kept.
    """
    whole = response_rows(prices, moved_only=False).dropna(subset=["y", "x", *CONFOUNDERS])
    enough = whole.groupBy(*keys).count().where(F.col("count") >= min_history).select(*keys)
    moved = join_null_safe(response_rows(prices), enough, keys, "left_semi")
    out = ols_slope2(moved, list(keys), "y", "x", CONFOUNDERS, min_rows)
    return out.select(*keys, F.col("n").alias("n_rows"), F.col("coef").alias("elasticity"),
                      F.col("se").alias("std_error"),
                      (F.col("coef") - 1.96 * F.col("se")).alias("ci_low"),
                      (F.col("coef") + 1.96 * F.col("se")).alias("ci_high"))


#: Poisson(1) draws above this have odds below 1e-12.
MOST_DRAWS = 15


def refute(prices: DataFrame, seed: int = 42, min_rows: int = 20) -> DataFrame:
    """The portfolio effect against placebo, random-cause, subset and bootstrap refits.

    Every variant is a hash of the row key, so the refits are repeatable and need no driver data.
    The placebo gives each row the price of another row of its series.
    """
    key = F.concat_ws("|", *SERIES_KEYS, F.col("week").cast("string"))

    def u(tag: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(f"{tag}{seed}")), F.lit(1_000_003)) / 1_000_003

    shuffled = Window.partitionBy(*SERIES_KEYS).orderBy(F.xxhash64(key, F.lit(f"order{seed}")), "week")
    base = response_rows(prices).select(
        "y", "x", *CONFOUNDERS, F.lead("x").over(shuffled).alias("_placebo"),
        u("cause").alias("z_random"), u("subset").alias("_subset"), u("boot").alias("_boot"),
    )
    # Poisson(1) weights by inversion stand in for resampling with replacement; the hash has six
    # digits, so no draw reaches MOST_DRAWS
    steps, total = [], 0.0
    for n in range(MOST_DRAWS):
        total += math.exp(-1) / math.factorial(n)
        steps.append((F.col("_boot") <= total, n))
    weight = case(steps, MOST_DRAWS)
    variants = {
        "estimate": base.withColumn("z_random", F.lit(0.0)),
        "placebo": base.withColumn("x", F.col("_placebo")).withColumn("z_random", F.lit(0.0)),
        "random_cause": base,
        "subset_80": base.where(F.col("_subset") < 0.8).withColumn("z_random", F.lit(0.0)),
        "bootstrap": base.withColumn("z_random", F.lit(0.0)).withColumn(
            "_rep", F.explode(F.array_repeat(F.lit(1), weight))),
    }
    tagged = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("variant"), "y", "x", *CONFOUNDERS, "z_random")
        tagged = part if tagged is None else tagged.unionByName(part)
    return ols_slope2(tagged, ["variant"], "y", "x", [*CONFOUNDERS, "z_random"], min_rows)


def validate_price_events(scored: DataFrame) -> DataFrame:
    """Predicted against observed log unit change, all rows and promotion-free rows."""
    rows = scored.where(F.col("real_price_move")).select(
        F.explode(F.when(F.col("promo_confounded") == 0, F.array(F.lit("all"), F.lit("clean")))
                  .otherwise(F.array(F.lit("all")))).alias("subset"),
        F.col("predicted_log_unit_change").alias("p"), F.col("log_unit_change").alias("o"),
    )
    err, naive = F.abs(F.expm1("p") - F.expm1("o")), F.abs(F.expm1("o"))
    return rows.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(flag(F.signum("p") == F.signum("o")).cast("double")).alias("direction_accuracy"),
        F.avg(err).alias("mae_pct"), F.avg(naive).alias("naive_mae_pct"),
        F.try_divide(F.covar_samp("p", "o"), F.stddev_samp("p") * F.stddev_samp("o")).alias("r"),
        F.avg(F.col("o") - F.col("p")).alias("mean_signed_error"),
    )


def magnitude_audit(df: DataFrame, predicted: str, observed: str, cut: str) -> DataFrame:
    """Signed error of predicted lifts inside its 1st-99th percentile, with a t statistic."""
    e = df.withColumn("_e", F.col(predicted) - F.col(observed)).where("_e is not null")
    trim = exact_quantiles(e, [], "_e", {"lo": 0.01, "hi": 0.99})
    kept = e.where(
        F.col("_e").between(trim.select("lo").scalar(), trim.select("hi").scalar()))
    s = kept.groupBy(cut).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mean_error"),
        F.stddev_samp("_e").alias("_sd"),
        F.avg(flag(F.col("_e") > 0).cast("double")).alias("share_over"),
    )
    return s.select(cut, "n", "mean_error", "share_over",
                    F.try_divide("mean_error", F.col("_sd") / F.sqrt("n")).alias("t_stat"))


def benchmark_delta(scored: DataFrame, value: str = "implied_elasticity") -> DataFrame:
    """Account benchmark range over plausible elasticities, and each row's distance to it."""
    ok = (F.col(value) < 0) & (F.abs(value) <= 50)
    bench = scored.where(ok).groupBy("retail_account").agg(
        F.min(value).alias("bench_min"), F.max(value).alias("bench_max"),
        F.avg(value).alias("bench_avg"))
    return scored.join(bench, "retail_account", "left").select(
        "week", *SERIES_KEYS, F.col(value).alias("value"), "bench_min", "bench_max", "bench_avg",
        (F.col(value) - F.col("bench_avg")).alias("delta_vs_account"))
