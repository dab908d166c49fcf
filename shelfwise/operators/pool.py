"""Comparison pool, donor history and on-demand pools (group C)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import case, safe_div
from shelfwise.operators.enrich import at_market, attach_tier
from shelfwise.schema import MARKET_KEYS, MARKET_WEEK_KEYS

#: Comparison types by distance.
COMPARISON_TYPES = {
    1: "SAME_SPECIFIC_FLAVOR_SAME_BRAND_PACK_LADDER",
    2: "SAME_SPECIFIC_FLAVOR_CROSS_BRAND",
    3: "SAME_FLAVOR_SAME_BRAND",
    4: "SAME_FLAVOR_CROSS_BRAND",
    5: "CROSS_FLAVOR_SAME_BRAND",
    6: "CROSS_FLAVOR_CROSS_BRAND",
}

_IDENTITY = {
    "upc": "upc",
    "parent_brand": "brand",
    "brand_line": "brand_line",
    "description": "description",
    "specific_flavor_normalized": "flavor",
    "flavor": "flavor_family",
    "pack_count": "pack_count",
    "size_oz": "size_oz",
    "first_week_selling": "first_week_selling",
    "arp": "arp",
    "promo_weeks": "promo_weeks",
    "units_pct_promo": "units_pct_promo",
}
_FOCAL_ONLY = {"base_arp": "base_arp"}
_CANDIDATE_ONLY = {
    "source_brand": "source_brand",
    "base_units": "base_units",
    "base_units_yago": "base_units_yago",
    "units": "units",
    "incr_units": "incr_units",
    "tdp": "tdp",
    "avg_weekly_units_spm": "velocity_spm",
    "avg_weekly_units_per_store_selling_per_item": "velocity_store_selling",
    "store_count": "store_count",
    "stores_selling": "stores_selling",
    "pct_stores_selling": "pct_stores_selling",
    "arp_pct_discount_any_promo": "arp_discount_any_promo",
    "units_lift_tpr": "units_lift_tpr",
    "units_lift_any_display": "units_lift_any_display",
    "units_lift_any_feature": "units_lift_any_feature",
}


def relationship_distance(f: str = "focal", c: str = "candidate") -> Column:
    """1 closest .. 6 unrelated; the first true branch wins, unknown comparisons fall through."""
    same_specific = F.col(f"{f}_flavor") == F.col(f"{c}_flavor")
    same_family = F.col(f"{f}_flavor_family") == F.col(f"{c}_flavor_family")
    same_brand = F.col(f"{f}_brand") == F.col(f"{c}_brand")
    other_pack = F.col(f"{f}_pack_count") != F.col(f"{c}_pack_count")
    return case(
        [
            (same_specific & same_brand & other_pack, 1),
            (same_specific & ~same_brand, 2),
            (same_family & same_brand & ~same_specific, 3),
            (same_family & ~same_brand, 4),
            (~same_family & same_brand, 5),
        ],
        6,
    )


def comparison_type(distance: str | Column = "relationship_distance") -> Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    return case([(d == k, v) for k, v in COMPARISON_TYPES.items() if k < 6], COMPARISON_TYPES[6])


def comparison_pool(
    enriched: DataFrame, cfg: RetailConfig, start=None, end=None, by_market: bool = False
) -> DataFrame:
    """Directed pairs of related products selling in the same market-week.

    A pair qualifies when both share the specific flavor, or the flavor, or are both own products;
    at least one side is own. Written as one equi join on (market-week, match token): every row
    carries up to three tokens and a pair is kept only at its strongest common token. This keeps
    the join free of a quadratic residual, splits large market-weeks by token, and needs no
    de-duplication. Pairs of an own and a foreign product are emitted in both directions from the
    same match.

    `by_market` deals rows by market, once and before they get their tokens. Executed under
    `scale.keys_in_part`, the join by week and token runs on that, and so does whatever folds the
    pairs of a market over its weeks: a pair lies in one task.
    """
    rows = enriched.where(F.col("market_excluded_flag") == 0)
    if start is not None:
        rows = rows.where(F.col("week") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("week") < F.lit(end))
    own = F.col("parent_brand") == cfg.own_parent
    names = {**_IDENTITY, **_FOCAL_ONLY, **_CANDIDATE_ONLY}
    tokens = F.explode(
        F.array_compact(
            F.array(
                F.concat(F.lit("1"), F.col("specific_flavor_normalized")),
                F.concat(F.lit("2"), F.col("flavor")),
                F.when(own, F.lit("3")),
            )
        )
    )

    def side(prefix: str, df: DataFrame) -> DataFrame:
        if by_market:
            # a stated number is never merged into fewer: pairs are many more than rows
            n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            df = df.repartition(n_tasks, *MARKET_KEYS)
        return df.select(
            *MARKET_WEEK_KEYS, "geography_level", tokens.alias("_token"),
            *[F.col(c).alias(f"{prefix}{n}") for c, n in names.items()],
        )

    left = side("_a_", rows.where(own))
    right = side("_b_", rows).drop("geography_level")
    kind = F.substring("_token", 1, 1)
    by_specific = F.coalesce(F.col("_a_flavor") == F.col("_b_flavor"), F.lit(False))
    by_family = F.coalesce(F.col("_a_flavor_family") == F.col("_b_flavor_family"), F.lit(False))
    matched = left.join(right, [*MARKET_WEEK_KEYS, "_token"]).where(
        (F.col("_a_upc") != F.col("_b_upc"))
        & (
            (kind == "1")
            | ((kind == "2") & ~by_specific)
            | ((kind == "3") & ~by_specific & ~by_family)
        )
    )
    # own x own already appears in both directions; own x foreign is mirrored here
    foreign = F.col("_b_brand") != cfg.own_parent
    directed = matched.withColumn(
        "_mirror",
        F.explode(F.when(foreign, F.array(F.lit(False), F.lit(True))).otherwise(
            F.array(F.lit(False)))),
    )

    def pick(n: str, focal: bool) -> Column:
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        return F.when(F.col("_mirror"), b if focal else a).otherwise(a if focal else b)

    pairs = directed.select(
        *MARKET_WEEK_KEYS,
        "geography_level",
        *[pick(n, True).alias(f"focal_{n}") for n in {**_IDENTITY, **_FOCAL_ONLY}.values()],
        *[pick(n, False).alias(f"candidate_{n}") for n in {**_IDENTITY, **_CANDIDATE_ONLY}.values()],
    )
    same_line = (F.col("focal_brand") == F.col("candidate_brand")) & (
        F.col("focal_flavor") == F.col("candidate_flavor")
    )
    typed = pairs.withColumn("relationship_distance", relationship_distance()).select(
        "*",
        comparison_type().alias("comparison_type"),
        F.when(same_line, F.abs(F.col("focal_pack_count") - F.col("candidate_pack_count"))).alias(
            "pack_distance"),
        F.when(
            (F.col("candidate_pack_count") > 0) & (F.col("focal_pack_count") > 0),
            safe_div(
                safe_div("focal_arp", "focal_pack_count"),
                safe_div("candidate_arp", "candidate_pack_count"),
            ),
        ).alias("price_per_unit_ratio"),
    )
    tiered = attach_tier(typed, cfg, "candidate_source_brand", "candidate_competitor_tier")
    return tiered.drop("candidate_source_brand")


def competitive_pool(
    enriched: DataFrame, filtered: DataFrame, cfg: RetailConfig, focal_upc: str,
    competitor_brand: str, channel: str, account: str, geography: str, since=None,
) -> DataFrame:
    """On-demand distance-6 pairs of one focal product and one brand in one market."""
    f = at_market(enriched, channel, account, geography, since, focal_upc).where(
        F.col("market_excluded_flag") == 0
    ).select(
        *MARKET_WEEK_KEYS,
        F.col("upc").alias("focal_upc"), F.col("pack_count").alias("focal_pack_count"),
        F.col("arp").alias("focal_arp"), F.col("base_units").alias("focal_base_units"),
        F.col("avg_weekly_units_spm").alias("focal_velocity_spm"),
    )
    c = at_market(filtered, channel, account, geography, since).where(
        F.col("source_brand") == competitor_brand
    ).select(
        *MARKET_WEEK_KEYS,
        F.col("upc").alias("competitor_upc"), F.col("source_brand").alias("competitor_brand"),
        F.col("flavor_raw").alias("competitor_flavor_raw"),
        F.col("source_pack_count").alias("competitor_pack_count"),
        F.col("arp").alias("competitor_arp"),
        safe_div("arp", "source_pack_count").alias("competitor_price_per_unit"),
        F.col("base_units").alias("competitor_base_units"),
        F.col("avg_weekly_units_spm").alias("competitor_velocity_spm"),
    )
    out = f.join(c, MARKET_WEEK_KEYS).select(
        "*",
        F.lit(COMPARISON_TYPES[6]).alias("comparison_type"),
        F.lit(6).alias("relationship_distance"),
        F.lit(None).cast("bigint").alias("pack_distance"),
    )
    return attach_tier(out, cfg, "competitor_brand", "competitor_tier")


#: Columns that identify one focal launch against one candidate.
LAUNCH_PAIR = [
    "focal_upc", "candidate_upc", *MARKET_KEYS, "focal_first_week_selling",
    "relationship_distance", "comparison_type", "pack_distance",
]


def launch_pairs(pool: DataFrame, max_distance: int = 5) -> DataFrame:
    """C4: distinct pairs per market with the focal's launch date."""
    return (
        pool.where(F.col("relationship_distance") <= max_distance)
        .select(*LAUNCH_PAIR)
        .distinct()
    )


def pool_scope(
    pool: DataFrame, by: Iterable[str] = ("comparison_type", "relationship_distance"),
    exact: bool = True,
) -> DataFrame:
    """Pool size per comparison type with its display label."""
    count = F.count_distinct if exact else F.approx_count_distinct
    label = case(
        [
            (F.col("relationship_distance") == 1, "Pack size comparison"),
            (F.col("relationship_distance") == 2, "Same flavor · any brand"),
            (F.col("relationship_distance") == 3, "Cross-flavor · own brand only"),
            (F.col("relationship_distance") == 4, "Cross-flavor · all brands"),
            (F.col("relationship_distance") == 5, "Other own flavor groups"),
        ],
        "Full competitive · on-demand",
    )
    by = list(by)
    return pool.groupBy(*by).agg(count("candidate_upc").alias("pool_sku_count")).select(
        "*", label.alias("comparison_scope_label")
    )


def pool_names(pool: DataFrame) -> DataFrame:
    """distinct candidates with their descriptions."""
    return pool.select("candidate_upc", "candidate_description").distinct()


def pool_name_list(pool: DataFrame, by: Iterable[str]) -> DataFrame:
    """ordered, de-duplicated name list; one entry per product, so bounded by the catalogue."""
    names = pool.select(*by, "candidate_description").distinct()
    return names.groupBy(*by).agg(
        F.array_join(F.sort_array(F.collect_list("candidate_description")), ", ").alias("names")
    )


def pool_census(pool: DataFrame) -> DataFrame:
    """Pairs per year and type."""
    return pool.groupBy(F.year("week").alias("yr"), "comparison_type").agg(
        F.count(F.lit(1)).alias("pairs"))


def co_present_weeks(pool: DataFrame) -> DataFrame:
    return pool.groupBy("focal_upc", "candidate_upc", *MARKET_KEYS).agg(
        F.count(F.lit(1)).alias("co_presence_weeks"))
