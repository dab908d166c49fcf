"""Launch windows, pair features, labels and scores of demand transfer (D1, D2, group H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import config as k
from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import case, clamp, flag, pct_change, safe_div, weeks_between
from shelfwise.functions.stats import student_sf2
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored, parent_brand
from shelfwise.operators.pool import LAUNCH_PAIR, launch_pairs
from shelfwise.scale import growing, join_null_safe, keys_in_part, written
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

_AVG4 = ("velocity_spm", "velocity_store_selling", "pct_stores_selling", "arp", "units_pct_promo")
_AVG13 = (*_AVG4, "arp_discount")

FOCAL_SPEC = [
    (w.PRE4, ("base_units", "tdp", "promo_weeks"), _AVG4),
    (w.POST4, ("base_units", "tdp", "promo_weeks"), _AVG4),
    (w.PRE13, ("base_units", "tdp", "promo_weeks"), _AVG13),
    (w.POST13, ("base_units", "tdp", "promo_weeks"), _AVG13),
    (w.PRE26, ("base_units", "tdp"), ("velocity_spm",)),
    (w.POST26, ("base_units", "tdp"), ("velocity_spm",)),
]
DONOR_SPEC = [
    (w.PRE4, ("base_units", "promo_weeks"), ("velocity_spm",)),
    (w.POST4, ("base_units", "promo_weeks"), ("velocity_spm",)),
    (w.PRE13, ("base_units", "promo_weeks"), _AVG13),
    (w.POST13, ("base_units", "promo_weeks"), _AVG13),
    (w.PRE26, ("base_units",), ("velocity_spm",)),
    (w.POST26, ("base_units",), ("velocity_spm",)),
]

_FOCAL_IDENTITY = ["description", "geography_level", "parent_brand", "brand_line",
                   "specific_flavor_normalized", "flavor", "pack_count", "first_week_selling"]


def focal_prepost(enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Own products before and after their launch, one row per series.

    One aggregation pass over the panel; every window is a conditional aggregate, so partial
    aggregation leaves one row per series and task for the shuffle.
    """
    tagged = own_scored(enriched, cfg).where(F.col("first_week_selling").isNotNull()).withColumn(
        "_offset", weeks_between("week", "first_week_selling")
    )
    same_year = F.year("week") == F.year("first_week_selling")
    return tagged.groupBy(*SERIES_KEYS, *_FOCAL_IDENTITY).agg(
        *w.span_measures("_offset", FOCAL_SPEC),
        w.sum_in(w.PRIOR13, "base_units", "_offset").alias("prior_13w_base_units"),
        w.avg_in(w.PRIOR13, "avg_weekly_units_spm", "_offset").alias("prior_13w_velocity_spm"),
        w.sum_in(w.POST13, "base_units_yago", "_offset").alias("yago_13w_base_units"),
        *w.calendar_measures("_offset", same_year),
    )


def donor_prepost(pool: DataFrame, filtered: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Candidates before and after the focal's launch.

    The windows depend on (candidate series, launch date) only, so history is joined and
    aggregated once per such pair, not once per focal product, and then attached to the pairs.

    A pair recurs every week. Of a pool dealt by market, the pairs are folded where they lie.
    """
    # the distinct pairs are small next to the weekly pool and used twice: join the pool only once
    with keys_in_part(pool.sparkSession):
        pairs = written(launch_pairs(pool))
    anchors = pairs.select(
        F.col("candidate_upc").alias("upc"), *MARKET_KEYS,
        F.col("focal_first_week_selling").alias("_launch"),
    ).distinct()
    history = filtered.where(
        ~F.col("channel_outlet").isin(*cfg.excluded_channels)
        & ~F.col("retail_account").isin(*cfg.excluded_accounts)
    ).select(
        "*", F.col("description").alias("candidate_description"),
        F.col("flavor_raw").alias("candidate_flavor"),
        F.col("source_pack_count").alias("candidate_pack_count"),
        parent_brand(cfg).alias("candidate_brand"),
        F.col("source_brand").alias("candidate_brand_line"),
    )
    ids = ["candidate_description", "candidate_flavor", "candidate_pack_count", "candidate_brand",
           "candidate_brand_line"]
    # only weeks that some window can hold are joined; pairs without any keep zero sums
    first, last = min(s.first for s, *_ in DONOR_SPEC), max(s.last for s, *_ in DONOR_SPEC)
    tagged = anchors.join(growing(history), SERIES_KEYS).withColumn(
        "_offset", weeks_between("week", "_launch")
    ).where(F.col("_offset").between(first, last))
    stats = tagged.groupBy(*SERIES_KEYS, "_launch", *ids).agg(
        *w.span_measures("_offset", DONOR_SPEC, "donor_"),
        w.sum_in(w.POST13, "base_units_yago", "_offset").alias("donor_yago_13w_base_units"),
    ).withColumnsRenamed({"upc": "candidate_upc", "_launch": "focal_first_week_selling"})
    series = ["candidate_upc", *MARKET_KEYS]
    products = history.withColumnRenamed("upc", "candidate_upc").select(*series, *ids).distinct()
    measures = [c for c in stats.columns if c.startswith("donor_")]
    averaged = tuple(f"_{m}" for m in w.AVERAGED)
    return (
        # a candidate may lack its description, flavor or pack count
        join_null_safe(
            pairs.join(growing(products), series), growing(stats),
            [*series, "focal_first_week_selling", *ids], "left",
        )
        .select(
            *LAUNCH_PAIR, *ids,
            *[F.col(c) if c.endswith(averaged) else F.coalesce(c, F.lit(0)).alias(c) for c in measures],
        )
    )


#: Pair measures handed through to scoring under these names.
_RAW_FOCAL = {
    "base_units": "base_units", "tdp": "tdp", "velocity_spm": "velocity_spm",
    "promo_weeks": "promo_weeks", "units_pct_promo": "units_pct_promo",
    "arp_discount": "arp_discount",
}


def label_deterministic(donor: Column, focal: Column) -> Column:
    """H2: unknown changes fall through exactly as in SQL."""
    return case(
        [
            ((donor < k.DONOR_LOSS_STRONG) & (focal > k.FOCAL_GAIN), "CANNIBALIZING"),
            ((donor < k.DONOR_LOSS_MILD) & (focal > 0), "WATCH"),
            (donor >= k.DONOR_LOSS_MILD, "INCREMENTAL"),
        ],
        "NEUTRAL",
    )


def demand_vs_distribution(velocity: Column, units: Column, tdp: Column) -> Column:
    """H3."""
    return case(
        [
            ((velocity > 0) & (units > 0), "DEMAND_LED"),
            ((tdp > k.TDP_JUMP) & (velocity <= 0), "DISTRIBUTION_LED"),
        ],
        "MIXED",
    )


def pair_features(
    focal: DataFrame, donor: DataFrame, min_weeks: int = 8, focal_pre_missing: str = "null"
) -> DataFrame:
    """H1-H4: one row per focal launch, donor and market over 13 weeks before and after.

    `focal_pre_missing="treat_as_gain"` counts a focal product without a pre-window as growing;
    the default keeps its relative change unknown, which is what the label rules were written for.
    """
    f = focal.select(
        F.col("upc").alias("focal_upc"), *MARKET_KEYS, "geography_level",
        F.col("description").alias("focal_description"),
        F.col("parent_brand").alias("focal_brand"),
        F.col("specific_flavor_normalized").alias("focal_flavor"),
        F.col("flavor").alias("focal_flavor_family"),
        F.col("pack_count").alias("focal_pack_count"),
        F.col("first_week_selling").alias("focal_first_week_selling"),
        *[c for c in focal.columns if "_13w_" in c],
    )
    d = donor.withColumnRenamed("candidate_upc", "donor_upc").withColumnsRenamed(
        {c: "donor_" + c[len("candidate_"):] for c in donor.columns if c.startswith("candidate_")
         and c != "candidate_upc"}
    )
    keys = ["focal_upc", *MARKET_KEYS, "focal_first_week_selling"]
    j = f.join(growing(d), keys).where(
        (F.col("post_13w_weeks_count") >= min_weeks)
        & (F.col("donor_pre_13w_weeks_count") >= min_weeks)
        & (F.col("donor_post_13w_weeks_count") >= min_weeks)
        & (F.col("post_13w_base_units") > 0)
        & (F.col("post_13w_tdp") > 0)
        & (F.col("donor_pre_13w_base_units") > 0)
    )

    def chg(m: str, prefix: str = "") -> Column:
        return pct_change(f"{prefix}post_13w_{m}", f"{prefix}pre_13w_{m}")

    def delta(m: str, prefix: str = "") -> Column:
        return F.col(f"{prefix}post_13w_{m}") - F.col(f"{prefix}pre_13w_{m}")

    focal_chg, donor_chg = chg("base_units"), chg("base_units", "donor_")
    if focal_pre_missing == "treat_as_gain":
        focal_chg = F.when(
            (F.col("pre_13w_base_units") == 0) & (F.col("post_13w_base_units") > 0), F.lit(1.0)
        ).otherwise(focal_chg)
    gain, loss = delta("base_units"), F.abs(F.least(F.lit(0.0), delta("base_units", "donor_")))
    confounded = (
        (F.abs(delta("promo_weeks")) > k.PROMO_WEEK_SHIFT)
        | (F.abs(delta("arp_discount")) > k.DISCOUNT_SHIFT)
        | (F.abs(delta("promo_weeks", "donor_")) > k.PROMO_WEEK_SHIFT)
    )
    out = j.select(
        *keys, "donor_upc", "geography_level",
        "focal_description", "focal_brand", "focal_flavor", "focal_flavor_family",
        "focal_pack_count", "donor_description", "donor_flavor", "donor_pack_count",
        "donor_brand", "donor_brand_line",
        "relationship_distance", "comparison_type", "pack_distance",
        F.lit("13w").alias("window_type"),
        F.col("pre_13w_weeks_count").alias("focal_pre_weeks_count"),
        F.col("post_13w_weeks_count").alias("focal_post_weeks_count"),
        "donor_pre_13w_weeks_count", "donor_post_13w_weeks_count",
        focal_chg.alias("focal_base_units_pct_chg"),
        donor_chg.alias("donor_base_units_pct_chg"),
        (gain + delta("base_units", "donor_")).alias("base_units_delta_diff"),
        chg("tdp").alias("focal_tdp_pct_chg"),
        chg("velocity_spm").alias("focal_velocity_spm_pct_chg"),
        chg("velocity_spm", "donor_").alias("donor_velocity_spm_pct_chg"),
        (delta("velocity_spm") + delta("velocity_spm", "donor_")).alias("velocity_spm_delta_diff"),
        chg("velocity_store_selling").alias("focal_velocity_store_selling_pct_chg"),
        chg("velocity_store_selling", "donor_").alias("donor_velocity_store_selling_pct_chg"),
        chg("pct_stores_selling").alias("focal_pct_stores_selling_pct_chg"),
        chg("pct_stores_selling", "donor_").alias("donor_pct_stores_selling_pct_chg"),
        chg("arp").alias("focal_arp_pct_chg"),
        delta("promo_weeks").alias("focal_promo_week_delta"),
        delta("promo_weeks", "donor_").alias("donor_promo_week_delta"),
        flag(confounded).alias("promo_confounded"),
        safe_div("post_13w_arp", "focal_pack_count").alias("focal_price_per_unit"),
        safe_div("donor_post_13w_arp", "donor_pack_count").alias("donor_price_per_unit"),
        pct_change("post_13w_base_units", "yago_13w_base_units").alias(
            "focal_base_units_yago_pct_chg"),
        pct_change("donor_post_13w_base_units", "donor_yago_13w_base_units").alias(
            "donor_base_units_yago_pct_chg"),
        *[F.col(f"{s}_13w_{m}").alias(f"focal_{s}_{n}")
          for m, n in _RAW_FOCAL.items() for s in ("post", "pre")],
        *[f"donor_{s}_13w_{m}" for m in _RAW_FOCAL if m != "tdp" for s in ("post", "pre")],
        label_deterministic(donor_chg, focal_chg).alias("label_deterministic"),
        demand_vs_distribution(chg("velocity_spm"), chg("base_units"), chg("tdp")).alias(
            "demand_vs_dist"),
        F.when(gain > 0, clamp(safe_div(gain, gain + loss), 0.0, 1.0)).alias("incremental_share"),
        F.when(gain > 0, clamp(safe_div(loss, gain), 0.0, 1.0)).alias("cannibalization_rate"),
    )
    return out


#: Model inputs of the transfer classifier.
TRANSFER_FEATURES = [
    "donor_base_units_pct_chg", "focal_base_units_pct_chg", "base_units_delta_diff",
    "focal_tdp_pct_chg", "focal_velocity_spm_pct_chg", "donor_velocity_spm_pct_chg",
    "velocity_spm_delta_diff", "pack_distance", "relationship_distance", "focal_price_per_unit",
    "focal_post_promo_weeks", "donor_post_13w_promo_weeks", "focal_post_units_pct_promo",
    "donor_post_13w_units_pct_promo", "focal_post_arp_discount", "donor_post_13w_arp_discount",
    "focal_arp_pct_chg", "focal_promo_week_delta", "donor_promo_week_delta",
]


# ---------------------------------------------------------------- H5


def heatmap(prepost: DataFrame, enriched: DataFrame, cfg: RetailConfig, flavor: str | None = None,
            channel: str | None = None, account: str | None = None) -> DataFrame:
    """Launch change per market for the products of one flavor, in six buckets."""
    wanted = own_scored(enriched, cfg)
    for c, v in (("flavor", flavor), ("channel_outlet", channel), ("retail_account", account)):
        if v is not None:
            wanted = wanted.where(F.col(c) == v)
    rows = prepost
    for c, v in (("channel_outlet", channel), ("retail_account", account)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    chg = pct_change("post_13w_base_units", "pre_13w_base_units")
    return rows.join(wanted.select(*SERIES_KEYS), SERIES_KEYS, "left_semi").select(
        *SERIES_KEYS, "description", "pack_count", "pre_13w_base_units", "post_13w_base_units",
        chg.alias("base_units_pct_chg"),
        case(
            [
                (F.col("pre_13w_base_units") == 0, "hm-no-data"), (chg < -0.10, "hm-strong-neg"),
                (chg < -0.03, "hm-mild-neg"), (chg <= 0.03, "hm-neutral"),
                (chg <= 0.10, "hm-mild-pos"),
            ],
            "hm-strong-pos",
        ).alias("heatmap_bucket"),
    )


# ---------------------------------------------------------------- H7, H8


def donor_losses(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Probability-weighted donor losses per focal product and week.

    Pairs meet donor weeks on the donor series, without a time key, and fold at once to one row
    per focal week.
    """
    donor_weeks = events.select(
        "week", F.col("upc").alias("donor_upc"), *MARKET_KEYS,
        F.greatest(F.lit(0.0), -F.coalesce("base_units_wow_delta", F.lit(0.0))).alias("_loss"),
    )
    return (
        scored.select("focal_upc", "donor_upc", *MARKET_KEYS, "transfer_prob")
        .join(donor_weeks, ["donor_upc", *MARKET_KEYS])
        .groupBy("week", "focal_upc", *MARKET_KEYS)
        .agg(
            F.sum(F.col("transfer_prob") * F.col("_loss")).alias("weighted_donor_loss"),
            F.count_distinct("donor_upc").alias("donor_count"),
            F.max("transfer_prob").alias("max_donor_prob"),
        )
    )


def rate_weekly(scored: DataFrame, events: DataFrame) -> DataFrame:
    """H7: share of the focal's base units explained by weighted donor losses, per week.

    `scored`: focal_upc, donor_upc, market keys, transfer_prob. `events`: own and donor series
    with base_units and base_units_wow_delta.
    """
    focal_key = ["week", "focal_upc", *MARKET_KEYS]
    losses = donor_losses(scored, events)
    focal_list = scored.select("focal_upc").distinct()
    focal = events.withColumnRenamed("upc", "focal_upc").join(focal_list, "focal_upc", "left_semi")
    loss = F.coalesce("weighted_donor_loss", F.lit(0.0))
    return focal.join(losses, focal_key, "left").select(
        *focal_key, "base_units", "base_units_wow_delta",
        loss.alias("weighted_donor_loss"),
        clamp(F.coalesce(safe_div(loss, "base_units"), F.lit(0.0)), 0.0, 1.0).alias(
            "cannibalization_rate"),
        F.coalesce("donor_count", F.lit(0)).alias("donor_count"),
        F.coalesce("max_donor_prob", F.lit(0.0)).alias("max_donor_prob"),
    )


def rate_trend(actuals: DataFrame, forecast: DataFrame, as_of, weeks_back: int = 8) -> DataFrame:
    """Trailing actual weeks followed by forecast weeks in one shape."""
    keys = ["week", "focal_upc", *MARKET_KEYS]
    recent = actuals.where(
        (F.col("week") >= F.date_sub(F.lit(as_of), 7 * weeks_back)) & (F.col("week") <= F.lit(as_of))
    )
    # the average guards against a week that was appended twice
    a = recent.groupBy(*keys).agg(
        F.avg("cannibalization_rate").alias("cannibalization_rate"),
        F.avg("weighted_donor_loss").alias("estimated_donor_units_lost"),
        F.max("donor_count").alias("donor_count"),
    ).withColumn("series_type", F.lit("ACTUAL"))
    f = forecast.select(
        *keys, F.col("forecast_rate_base").alias("cannibalization_rate"),
        "forecast_rate_low", "forecast_rate_high", F.lit("FORECAST").alias("series_type"),
    )
    return a.unionByName(f, allowMissingColumns=True)


# ---------------------------------------------------------------- H17-H21


def window_significance(
    history: DataFrame, keys: list[str], c: str = "base_units", offset: str = "offset",
    pre: w.Span = w.PRE13, post: w.Span = w.POST13, practical: float = 0.05, alpha: float = 0.10,
) -> DataFrame:
    """Welch test of a pre and a post window, gated by practical size."""
    aggs = []
    for s in (pre, post):
        v = F.when(s.of(offset), F.col(c))
        side = "pre" if s is pre else "post"
        aggs += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"),
                 F.var_samp(v).alias(f"var_{side}")]
    s = history.groupBy(*keys).agg(*aggs)
    a, b = F.col("var_pre") / F.col("n_pre"), F.col("var_post") / F.col("n_post")
    t = F.try_divide(F.col("mean_pre") - F.col("mean_post"), F.sqrt(a + b))
    dof = F.try_divide(
        (a + b) * (a + b),
        F.try_divide(a * a, F.col("n_pre") - 1) + F.try_divide(b * b, F.col("n_post") - 1),
    )
    s = s.select(
        "*", t.alias("t_stat"), dof.alias("dof"),
        ((F.col("mean_post") - F.col("mean_pre")) / (F.abs("mean_pre") + 1e-9)).alias("pct_change"),
    ).withColumn("p_value", student_sf2("t_stat", "dof"))
    enough = (F.col("n_pre") >= 4) & (F.col("n_post") >= 4)
    stat = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    pract = F.coalesce(F.abs("pct_change") > practical, F.lit(False))
    return s.select(
        *keys, "n_pre", "n_post", "mean_pre", "mean_post", "t_stat", "dof",
        F.when(enough, F.col("p_value")).alias("p_value"),
        F.when(enough, F.col("pct_change")).alias("pct_change"),
        (enough & stat & pract).alias("significant"),
        case(
            [(~enough, "INSUFFICIENT_WEEKS"), (stat & pract, "BOTH"), (stat, "STAT_ONLY"),
             (pract, "PRACT_ONLY")],
            "NEITHER",
        ).alias("reason"),
    )


def assemble_events(scored: DataFrame) -> DataFrame:
    """Combine score, significance and outlier evidence; rows without evidence are suppressed.

    Needs transfer_prob, transfer_status, significant, pct_change, z_score, promo_confounded,
    donor_base_units_pct_chg, focal_tdp_pct_chg and focal_velocity_spm_pct_chg.
    """
    z, sig = F.abs(F.coalesce("z_score", F.lit(0.0))), F.coalesce("significant", F.lit(False))
    prob = F.col("transfer_prob")
    suppressed = (
        (~sig & (z < 1.5))
        | ((prob < 0.25) & (F.col("transfer_status") == "Incremental"))
        | ((F.col("promo_confounded") == 1) & (z < 2.5))
    )

    def known(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    donor, tdp, vel, pct = (
        known("donor_base_units_pct_chg"), known("focal_tdp_pct_chg"),
        known("focal_velocity_spm_pct_chg"), known("pct_change"),
    )
    return scored.where(~suppressed).select(
        "*",
        case(
            [(sig & (z >= 2.0) & (prob >= 0.60), "High"), (sig | (z >= 2.0), "Medium")], "Low"
        ).alias("confidence"),
        case(
            [
                ((donor < -0.10) & (pct > 0.03), "Significant Demand Transfer Detected"),
                ((tdp > 0.15) & (vel < -0.03), "Distribution-Led Gain Detected"),
                (donor < -0.05, "Pack Overlap Risk Elevated"),
                ((pct < -0.10) & (tdp >= 0), "Launch Underperforming in Geography"),
                (z >= 2.0, "Velocity Outlier Detected"),
            ],
            "Watch — Monitor Before Expanding",
        ).alias("event_label"),
    )


def score_bands(df: DataFrame, prob: str = "transfer_prob") -> DataFrame:
    """Status by probability, confidence by weeks of evidence."""
    p = F.col(prob)
    pre, post = (F.coalesce(c, F.lit(0)) for c in ("focal_pre_weeks_count", "focal_post_weeks_count"))
    return df.select(
        "*",
        case([(p <= 0.35, "Incremental"), (p <= 0.65, "Watch")], "Cannibalizing").alias(
            "transfer_status"),
        case(
            [((pre >= 12) & (post >= 10), "High"), ((pre >= 8) & (post >= 8), "Medium")], "Low"
        ).alias("transfer_confidence"),
    )


def assign_event(scored: DataFrame) -> DataFrame:
    """Surfaceable scores with event type, label and colour."""
    donor = F.coalesce("donor_base_units_pct_chg", F.lit(0.0))
    tdp = F.coalesce("focal_tdp_pct_chg", F.lit(0.0))
    vel = F.coalesce("focal_velocity_spm_pct_chg", F.lit(0.0))
    cross = F.col("relationship_distance").isin(3, 4)
    surfaced = (F.col("transfer_status") == "Cannibalizing") | (
        (F.col("transfer_status") == "Watch") & F.col("transfer_confidence").isin("High", "Medium")
    )
    moved, spread, leaning = donor < -0.10, (tdp > 0.15) & (vel < -0.03), donor < -0.05
    cross_label = F.concat(
        F.lit("Cross-Flavor Signal: "), F.coalesce("donor_description", F.lit("?")),
        F.lit(" Declining"),
    )
    return scored.where(surfaced).select(
        "*",
        case(
            [(moved | spread, "DEMAND_TRANSFER"), (leaning & cross, "CROSS_FLAVOR_SIGNAL")],
            "PACK_OVERLAP_RISK",
        ).alias("event_type"),
        case(
            [
                (moved, "Significant Demand Transfer Detected"),
                (spread, "Distribution-Led Gain Detected"),
                (leaning & cross, cross_label),
                (leaning, "Pack Overlap Risk Elevated"),
            ],
            "Watch — Monitor Before Expanding",
        ).alias("event_label"),
        case([(moved, "red"), (spread | leaning, "amber")], "green").alias("event_color"),
    )


def event_label(df: DataFrame) -> DataFrame:
    """Target of the event classifier."""
    hit = (F.col("label_deterministic") == "CANNIBALIZING") & (
        F.col("donor_base_units_pct_chg") < -0.05)
    return df.withColumn("event_significant", flag(hit))


def ranking_frame(pairs: DataFrame) -> DataFrame:
    """Labelled pairs with enough evidence and a graded relevance."""
    label = F.col("label_deterministic")
    return pairs.where(
        (label != "NEUTRAL") & (F.col("focal_post_weeks_count") >= 8)
        & (F.col("donor_pre_13w_weeks_count") >= 8)
    ).withColumn("relevance", case([(label == "CANNIBALIZING", 2), (label == "WATCH", 1)], 0))


def rank_donors(scored: DataFrame, score: str = "transfer_prob", top: int | None = None) -> DataFrame:
    """Donors of a focal product in a market by score; ties by the smaller UPC."""
    from pyspark.sql import Window

    order = Window.partitionBy("focal_upc", *MARKET_KEYS).orderBy(F.desc(score), "donor_upc")
    ranked = scored.withColumn("donor_rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("donor_rank") <= top)
