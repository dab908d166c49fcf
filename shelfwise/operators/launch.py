"""New-product detection, classification, ramp and analog operators (group G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import case, flag, maturity_tier, pack_band, safe_div, weeks_between
from shelfwise.operators import windows as w
from shelfwise.operators.enrich import own_scored
from shelfwise.schema import MARKET_KEYS, SERIES_KEYS

#: Pack counts sold as a product line.
STANDARD_PACKS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 18, 20, 24)


def _year_before(cfg: RetailConfig) -> Column:
    return F.add_months(F.lit(cfg.as_of), -12)


def new_upcs(enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """G1, E5: own products first sold within twelve months of `as_of`; first row per series."""
    recent = own_scored(enriched, cfg).where(F.col("first_week_selling") >= _year_before(cfg))
    first = recent.withColumn("_r", F.row_number().over(w.series())).where("_r = 1")
    return first.select(
        "week", *SERIES_KEYS, "description", "source_brand", "flavor_raw", "flavor_mapped",
        "flavor", "specific_flavor_normalized", "pack_count", "size_oz", "first_week_selling",
        F.col("units").alias("units_first_week"),
        F.col("base_units").alias("base_units_first_week"),
        F.col("tdp").alias("tdp_first_week"),
        F.lit("Y").alias("manual_review_needed"),
    )


def classify_new(candidates: DataFrame, enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """New pack of a known flavor, duplicate, or new flavor; closest pack partner.

    The existence tests are conditional counts over one left join of product lists.
    """
    catalog = own_scored(enriched, cfg).where(F.col("first_week_selling") < _year_before(cfg)).select(
        F.col("upc").alias("_upc"), "specific_flavor_normalized", "flavor",
        F.col("pack_count").alias("_pack"), F.col("description").alias("_desc"),
    ).distinct()
    products = candidates.select(
        "upc", "specific_flavor_normalized", "flavor", "flavor_mapped", "pack_count"
    ).distinct()
    other = F.col("_pack") != F.col("pack_count")
    facts = products.join(catalog, ["specific_flavor_normalized", "flavor"], "left").groupBy("upc").agg(
        F.count_if(other & (F.col("flavor_mapped") == F.col("flavor"))).alias("_diff_pack"),
        F.count_if(F.col("_pack") == F.col("pack_count")).alias("_same_pack"),
        F.min(F.when(other, F.col("_upc"))).alias("closest_pack_partner_upc"),
        F.min_by("_desc", F.when(other, F.col("_upc"))).alias("_partner_desc"),
    )
    return candidates.join(facts, "upc", "left").select(
        *candidates.columns,
        case(
            [
                ((F.col("_diff_pack") > 0) & F.col("pack_count").isin(*STANDARD_PACKS),
                 "NEW_PACK_SIZE"),
                (F.col("_same_pack") > 0, "DUPLICATE_OR_RELAUNCH"),
            ],
            "NEW_FLAVOR_CANDIDATE",
        ).alias("upc_classification"),
        "closest_pack_partner_upc",
        F.when(F.col("closest_pack_partner_upc").isNotNull(), F.col("_partner_desc")).alias(
            "closest_pack_partner_description"),
        F.when(F.col("flavor_mapped") != F.col("flavor"), "Y").otherwise("N").alias(
            "flavor_taxonomy_conflict"),
    )


def _ribbon(weeks: Column, total: int, branches: Sequence[tuple[Column, str]], default: str) -> Column:
    return F.concat(
        F.lit("RAMP WEEK "), (weeks + 1).cast("string"), F.lit(f" of {total} · "),
        case(branches, default),
    )


def ramp_monitor(enriched: DataFrame, cfg: RetailConfig, style: str = "16w") -> DataFrame:
    """G3 (`16w`) and G4 (`12w`): launch weeks with reach trend, status and weak-launch flag.

    The two styles are separate published rule sets: 16 weeks with a three-state trend, or 12
    weeks with a four-state trend, launches of the last six months only, age counted from the
    first row of the series.
    """
    if style == "16w":
        rows = own_scored(enriched, cfg).where(F.col("first_week_selling").isNotNull()).withColumn(
            "weeks_since_launch", weeks_between("week", "first_week_selling")
        ).where(F.col("weeks_since_launch").between(0, 15))
    elif style == "12w":
        whole = Window.partitionBy(*SERIES_KEYS)
        rows = own_scored(enriched, cfg).withColumn(
            "first_week_selling", F.min("week").over(whole)
        ).where(F.col("first_week_selling") >= F.add_months(F.lit(cfg.as_of), -6)).withColumn(
            "weeks_since_launch", weeks_between("week", "first_week_selling")
        ).where(F.col("weeks_since_launch") < 12)
    else:
        raise ValueError(f"unknown ramp style {style!r}")
    so_far = w.series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vel = F.col("avg_weekly_units_spm")
    roll = F.avg("avg_weekly_units_spm").over(w.last_rows(4))
    base = rows.select(
        "week", *SERIES_KEYS, "description", "pack_count", "first_week_selling",
        "weeks_since_launch", "tdp", "avg_weekly_units_spm", "base_units", "arp",
        F.max("tdp").over(so_far).alias("peak_tdp"),
        roll.alias("rolling_4w_avg_velocity_spm"),
        (F.col("tdp") - F.lag("tdp", 4).over(w.series())).alias("tdp_4w_change"),
        safe_div(vel, roll).alias("velocity_vs_4w_avg_ratio"),
    )
    n, chg = F.col("weeks_since_launch"), F.col("tdp_4w_change")
    weak = F.col("velocity_vs_4w_avg_ratio")
    to_peak = safe_div("tdp", "peak_tdp")
    if style == "16w":
        trend = case([(chg.isNull() | (n < 4) | (chg > 0), "RAMPING"), (chg == 0, "STABLE")],
                     "DECLINING")
        confidence = case([(n <= 5, None), (n <= 7, "Low")], "Medium")
        maturing, total = n <= 11, 13
        under = ((n >= 6) & (weak < 0.85) & (chg <= 0)) | ((n >= 8) & (weak < 0.85))
        ratio, slash = to_peak, F.concat(
            F.floor("tdp").cast("string"), F.lit(" / "), F.floor("peak_tdp").cast("string"))
    else:
        before = F.coalesce(F.col("tdp") - chg, F.col("tdp"))
        peak_share = F.coalesce(to_peak, F.lit(1.0))
        trend = case(
            [
                ((before == 0) | (F.col("tdp") > before * 1.05), "RAMPING"),
                (peak_share < 0.90, "DECLINING"),
                (F.col("tdp") < before * 0.95, "PEAKED"),
            ],
            "STABLE",
        )
        confidence = case([(n <= 5, None), (n <= 7, "Low"), (n <= 10, "Medium")], "High")
        maturing, total = n <= 10, 12
        under = F.coalesce(weak, F.lit(1.0)) < 0.80
        ratio, slash = peak_share, F.concat(
            F.format_string("%.1f", "tdp"), F.lit(" / "), F.format_string("%.1f", "peak_tdp"))
    ribbon = _ribbon(
        n, total,
        [
            (n <= 5, "Cannibalization scoring suppressed"),
            (n <= 7, "Early signal · Low confidence"),
            (maturing, "Signal maturing"),
        ],
        "Scoring fully active",
    )
    return base.select(
        "*",
        trend.alias("distribution_trend"),
        case([(n <= 5, "SUPPRESSED"), (n <= 7, "LOW_CONFIDENCE")], "ACTIVE").alias("scoring_status"),
        confidence.cast("string").alias("ramp_confidence"),
        ribbon.alias("ui_ramp_ribbon"),
        flag(under).alias("underperforming_flag"),
        ratio.alias("tdp_ratio_to_peak"),
        slash.alias("tdp_now_slash_peak"),
    )


def prelaunch_baseline(
    pairs: DataFrame, panel: DataFrame, weeks: int = 13, min_weeks: int = 4
) -> DataFrame:
    """Candidate level in the last weeks before the focal's launch.

    `pairs` carries focal_first_week_selling. History is cut per (candidate series, launch date),
    which many focal products share, and only then attached to pairs.
    """
    anchors = pairs.select(
        F.col("candidate_upc").alias("upc"), *MARKET_KEYS, "focal_first_week_selling"
    ).distinct()
    keys = [*SERIES_KEYS, "focal_first_week_selling"]
    before = anchors.join(panel.select("week", *SERIES_KEYS, "base_units"), SERIES_KEYS).where(
        F.col("week") < F.col("focal_first_week_selling"))
    level = w.tail_n(before, weeks, keys).groupBy(*keys).agg(
        F.avg("base_units").alias("pre_launch_avg_base_units"),
        F.count("base_units").alias("pre_launch_week_count"),
    ).where(F.col("pre_launch_week_count") >= min_weeks)
    return pairs.select(
        "focal_upc", "candidate_upc", *MARKET_KEYS, "focal_first_week_selling"
    ).distinct().join(
        level.withColumnRenamed("upc", "candidate_upc"),
        ["candidate_upc", *MARKET_KEYS, "focal_first_week_selling"],
    )


def new_pack_events(classified: DataFrame) -> DataFrame:
    """One enrolment event per newly found pack size without a flavor conflict."""
    partner = F.col("closest_pack_partner_description")
    desc = F.coalesce("description", F.lit("?"))
    return classified.where(
        (F.col("upc_classification") == "NEW_PACK_SIZE")
        & (F.col("flavor_taxonomy_conflict") == "N")
    ).select(
        F.col("upc").alias("focal_upc"), desc.alias("focal_description"), "pack_count", "size_oz",
        "closest_pack_partner_upc", partner.alias("closest_pack_partner_description"),
        F.lit("NEW_PACK_SIZE").alias("event_type"),
        F.concat(
            F.lit("New pack size detected: "), desc,
            F.when(partner.isNotNull(), F.concat(F.lit(" (closest partner: "), partner, F.lit(")")))
            .otherwise(F.lit("")),
        ).alias("event_label"),
        F.lit("amber").alias("event_color"), F.lit("Watch").alias("transfer_status"),
        F.lit("Medium").alias("transfer_confidence"),
    ).distinct()


def launch_tiers(prepost: DataFrame) -> DataFrame:
    """Evidence tier of each launch by its weeks after launch (26-week window)."""
    return prepost.select(
        *SERIES_KEYS, F.col("post_26w_weeks_count").alias("post_weeks"),
        maturity_tier("post_26w_weeks_count").alias("confidence_tier"),
    )


def similar_skus(enriched: DataFrame, cfg: RetailConfig, n: int = 5) -> DataFrame:
    """Established products most like each new one, within channel and pack band.

    Blocked on (channel, pack band): only products of one band in one channel meet. Distance
    counts differing flavor terms and the log gap of first-week velocity; product lists are
    catalogue-sized, far smaller than the panel.
    """
    own = own_scored(enriched, cfg)
    first = own.groupBy("upc", "channel_outlet").agg(
        F.min_by("avg_weekly_units_spm", F.struct("week", *MARKET_KEYS)).alias("velocity"),
        F.min("first_week_selling").alias("first_week_selling"),
        F.min("flavor").alias("flavor"),
        F.min("specific_flavor_normalized").alias("specific"),
        F.min("pack_count").alias("pack_count"),
    ).withColumn("pack_band", pack_band("pack_count"))
    cut = _year_before(cfg)
    new = first.where(F.col("first_week_selling") >= cut)
    old = first.where(F.col("first_week_selling") < cut)
    n_ = new.select("channel_outlet", "pack_band", F.col("upc").alias("new_upc"),
                    *[F.col(c).alias(f"_n_{c}") for c in ("velocity", "flavor", "specific")])
    o_ = old.select("channel_outlet", "pack_band", F.col("upc").alias("similar_upc"),
                    *[F.col(c).alias(f"_o_{c}") for c in ("velocity", "flavor", "specific")])
    gap = F.abs(F.ln(F.greatest("_n_velocity", F.lit(0.01))) - F.ln(F.greatest("_o_velocity", F.lit(0.01))))
    dist = gap + flag(F.col("_n_flavor") != F.col("_o_flavor")) + 0.5 * flag(
        F.col("_n_specific") != F.col("_o_specific"))
    rank = Window.partitionBy("new_upc", "channel_outlet").orderBy("similarity_distance", "similar_upc")
    return n_.join(o_, ["channel_outlet", "pack_band"]).select(
        "new_upc", "similar_upc", "channel_outlet", "pack_band", dist.alias("similarity_distance")
    ).withColumn("similarity_rank", F.row_number().over(rank)).where(F.col("similarity_rank") <= n)


def launch_percentile(enriched: DataFrame, cfg: RetailConfig, max_week: int = 26) -> DataFrame:
    """Rank of each launch among all own launches at the same age.

    An age can hold any number of series, so ranks come from counts per distinct velocity and a
    two-level running sum instead of one sorted partition.
    """
    from shelfwise.scale import running_totals

    age = weeks_between("week", "first_week_selling")
    rows = own_scored(enriched, cfg).select(
        *SERIES_KEYS, age.alias("week_n"), F.col("avg_weekly_units_spm").alias("velocity")
    ).where(F.col("week_n").between(0, max_week) & F.col("velocity").isNotNull())
    counts = rows.groupBy("week_n", "velocity").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, ["week_n"], "velocity", {"_upto": "_n"})
    totals = counts.groupBy("week_n").agg(F.sum("_n").alias("_total"))
    ranks = cum.join(totals, "week_n").select(
        "week_n", "velocity",
        F.when(F.col("_total") == 1, F.lit(0.0)).otherwise(
            (F.col("_upto") - F.col("_n")) / (F.col("_total") - 1)).alias("launch_percentile"),
    )
    return rows.join(ranks, ["week_n", "velocity"])


def launch_projection(enriched: DataFrame, cfg: RetailConfig, fit_weeks: int = 12,
                      horizon: int = 13, min_rows: int = 4) -> DataFrame:
    """Linear trend of the first weeks, carried on for the horizon with a residual band."""
    age = weeks_between("week", "first_week_selling")
    rows = own_scored(enriched, cfg).withColumn("x", age.cast("double")).where(
        F.col("x").between(0, fit_weeks - 1))
    fit = rows.groupBy(*SERIES_KEYS).agg(
        F.regr_slope("base_units", "x").alias("slope"),
        F.regr_intercept("base_units", "x").alias("intercept"),
        F.sqrt(F.regr_syy("base_units", "x") * (1 - F.regr_r2("base_units", "x"))
               / (F.count(F.lit(1)) - 2)).alias("resid_std"),
        F.max("x").alias("last_x"),
        F.count(F.lit(1)).alias("n"),
    ).where((F.col("n") >= min_rows) & F.col("slope").isNotNull())
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    mid = F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("step"))
    band = 1.28 * F.coalesce("resid_std", F.lit(0.0))
    return steps.select(
        *SERIES_KEYS, "step", "slope",
        F.greatest(mid, F.lit(0.0)).alias("projected_units"),
        F.greatest(mid - band, F.lit(0.0)).alias("projected_low"),
        F.greatest(mid + band, F.lit(0.0)).alias("projected_high"),
    )


def ramp_curves(enriched: DataFrame, cfg: RetailConfig, weeks: int = 13) -> DataFrame:
    """Velocity by age in the first weeks per own product and channel; weeks without sales are absent.

    Accounts are averaged first, so the number of curves is that of the own catalogue.
    """
    rows = own_scored(enriched, cfg).withColumn(
        "_a", weeks_between("week", "first_week_selling")).where(F.col("_a").between(0, weeks - 1))
    product = ["upc", "channel_outlet"]
    by_age = rows.groupBy(*product, "_a").agg(
        F.avg("avg_weekly_units_spm").alias("_v"), F.avg("arp").alias("_arp"),
        F.min("pack_count").alias("_pack"), F.min("flavor").alias("_flavor"),
        F.min("first_week_selling").alias("_first"),
    )
    # at most `weeks` entries per product and channel
    folded = by_age.groupBy(*product).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_a").alias("age"), F.col("_v").alias("velocity")))).alias("curve"),
        F.max("_v").alias("_peak"), F.avg("_arp").alias("_arp"), F.max("_a").alias("last_age"),
        F.min("_pack").alias("pack_count"), F.min("_flavor").alias("flavor"),
        F.count(F.lit(1)).alias("n_weeks"), F.min("_first").alias("first_week"),
    ).where(F.col("_peak") > 0)
    return folded.select(*product, "pack_count", "flavor", "n_weeks", "first_week", "last_age",
                         safe_div("_arp", "pack_count").alias("unit_price"), "curve")


def ramp_shape(curve: str, last_age: str) -> Column:
    """Velocities of a curve up to an age, as shares of their peak."""
    v = F.transform(
        F.filter(curve, lambda p: (p["age"] <= F.col(last_age)) & p["velocity"].isNotNull()),
        lambda p: p["velocity"])
    return F.transform(v, lambda x: F.try_divide(x, F.array_max(v)))


def dtw_distance(a: Column, b: Column) -> Column:
    """Dynamic-time-warping distance of two arrays as nested array folds.

    Each outer step turns the previous cost row into the next: cell j costs |a_i - b_j| plus the
    cheapest of left, above and diagonal.
    """
    inf = F.lit(float("inf"))
    width = F.size(b)
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, width))

    def next_row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.least(F.element_at(acc, -1), F.element_at(prev, j), F.element_at(prev, j + 1))
            return F.concat(acc, F.array(F.abs(x - F.element_at(b, j)) + best))

        return F.aggregate(F.sequence(F.lit(1), width), F.array(inf), cell)

    return F.element_at(F.aggregate(a, start, next_row), -1)


def ramp_match(enriched: DataFrame, cfg: RetailConfig, n: int = 3) -> DataFrame:
    """For each launch of the last year, the established own products with the most similar ramp.

    Both are compared over the weeks that the launch has had so far (13 at most), each as a share of
    its peak in these weeks. Ties go to the closer unit price, then the same flavor. Curves meet
    inside (channel, pack count) only.
    """
    curves = ramp_curves(enriched, cfg)
    block = ["channel_outlet", "pack_count"]
    cut = _year_before(cfg)
    a = curves.where(F.col("first_week") >= cut).select(
        *block, "upc", "last_age", F.col("curve").alias("_ca"), F.col("unit_price").alias("_pa"),
        F.col("flavor").alias("_fa"))
    b = curves.where(F.col("first_week") < cut).select(*block, F.col("upc").alias("analog_upc"), F.col("curve").alias("_cb"),
                      F.col("unit_price").alias("_pb"), F.col("flavor").alias("_fb"))
    met = a.join(b, block).where(F.col("upc") != F.col("analog_upc")).select(
        "*", ramp_shape("_ca", "last_age").alias("_sa"), ramp_shape("_cb", "last_age").alias("_sb"))
    scored = met.where((F.size("_sa") > 0) & (F.array_max("_sb") > 0)).select(
        "upc", *block, "analog_upc",
        dtw_distance(F.col("_sa"), F.col("_sb")).alias("dtw"),
        F.abs(F.col("_pa") - F.col("_pb")).alias("_dp"),
        flag(F.col("_fa") != F.col("_fb")).alias("_df"),
    )
    order = Window.partitionBy("upc", "channel_outlet").orderBy(
        F.round("dtw", 9), "_dp", "_df", "analog_upc")
    return scored.withColumn("match_rank", F.row_number().over(order)).where(
        F.col("match_rank") <= n).drop("_dp", "_df")


def analog_overlay(matches: DataFrame, enriched: DataFrame, month_index: DataFrame) -> DataFrame:
    """Velocity of the best analog by weeks since launch, moved to the focal's season.

    `month_index`: month, demand_index.
    """
    product = ["upc", "channel_outlet", "week_n"]
    rows = enriched.select(
        "upc", "channel_outlet", weeks_between("week", "first_week_selling").alias("week_n"),
        F.col("avg_weekly_units_spm").alias("velocity"), F.month("week").alias("month"),
    ).join(month_index, "month").groupBy(*product).agg(
        F.avg("velocity").alias("velocity"), F.avg("demand_index").alias("demand_index"))
    focal = rows.withColumnsRenamed({"velocity": "focal_velocity", "demand_index": "_fi"})
    analog = rows.withColumnsRenamed(
        {"upc": "analog_upc", "velocity": "analog_velocity", "demand_index": "_ai"})
    best = matches.where("match_rank = 1").select("upc", "channel_outlet", "analog_upc")
    return best.join(focal, ["upc", "channel_outlet"]).join(
        analog, ["analog_upc", "channel_outlet", "week_n"]
    ).select(
        *product, "analog_upc", "focal_velocity", "analog_velocity",
        (F.col("analog_velocity") * safe_div("_fi", "_ai")).alias("analog_velocity_in_season"),
    )


def tdp_milestones(enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Reach at launch, in week 7, at its peak and in the newest week."""
    age = weeks_between("week", "first_week_selling")
    rows = own_scored(enriched, cfg).withColumn("_a", age)
    return rows.groupBy(*SERIES_KEYS).agg(
        F.min_by("tdp", "week").alias("launch_tdp"),
        F.max(F.when(F.col("_a") == 7, F.col("tdp"))).alias("week7_tdp"),
        F.max_by("tdp", "week").alias("last_tdp"),
        F.max("tdp").alias("peak_tdp"),
    )


def early_flags(candidates: DataFrame, norms: DataFrame, siblings: DataFrame) -> DataFrame:
    """Benchmark position and a first assortment guess of products without history.

    `norms`: week, market keys, pack_count, norm_avg_velocity_spm, norm_avg_tdp.
    `siblings`: upc list of products that already have a pack variant of the same flavor.
    """
    known = siblings.select("upc").distinct().withColumn("_sib", F.lit(True))
    vel = safe_div("units_first_week", "tdp_first_week")
    return candidates.join(norms, ["week", *MARKET_KEYS, "pack_count"], "left").join(
        known, "upc", "left"
    ).select(
        *SERIES_KEYS, "pack_count",
        safe_div(vel, "norm_avg_velocity_spm").alias("velocity_vs_norm"),
        safe_div("tdp_first_week", "norm_avg_tdp").alias("tdp_vs_norm"),
        F.when(F.col("_sib"), "LIKELY_CANNIBALISTIC").otherwise("LIKELY_INCREMENTAL").alias(
            "assortment_flag"),
    )
