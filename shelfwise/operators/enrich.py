"""Category filter, enrichment and row-level quality filters (group B)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import flag, safe_div
from shelfwise.scale import config_lookup


def filter_category(panel: DataFrame, cfg: RetailConfig, start=None, end=None) -> DataFrame:
    """B1: own brands anywhere plus the whole subcategory, inside [start, end)."""
    keep = F.col("source_brand").isin(*cfg.own_brands) | (F.col("subcategory") == cfg.subcategory)
    if start is not None:
        keep = keep & (F.col("week") >= F.lit(start))
    if end is not None:
        keep = keep & (F.col("week") < F.lit(end))
    return panel.where(keep)


def is_own(cfg: RetailConfig, brand: str = "source_brand") -> Column:
    return F.col(brand).isin(*cfg.own_brands)


def excluded_market(cfg: RetailConfig) -> Column:
    """Markets that never enter scoring."""
    return F.col("channel_outlet").isin(*cfg.excluded_channels) | F.col("retail_account").isin(
        *cfg.excluded_accounts
    )


def parent_brand(cfg: RetailConfig, brand: str = "source_brand") -> Column:
    return F.when(is_own(cfg, brand), F.lit(cfg.own_parent)).otherwise(F.col(brand))


def enrich(
    filtered: DataFrame, flavor_map: DataFrame, overrides: DataFrame, cfg: RetailConfig
) -> DataFrame:
    """B2: attach parent brand, brand line, flavors, pack and the market-exclusion flag.

    Lookups join on UPC with left joins; Spark broadcasts them when they are under its size
    threshold. Canonical flavor = override, else mapped family, else the raw flavor.
    """
    m = flavor_map.select(
        "upc",
        F.col("brand").alias("_brand"),
        F.col("flavor_family").alias("flavor_mapped"),
        "specific_flavor_raw",
        "specific_flavor_normalized",
        F.col("pack_count").cast("bigint").alias("_pack"),
        F.col("size").cast("double").alias("size_oz"),
    )
    o = overrides.select("upc", F.col("flavor_canonical").alias("_override"))
    joined = filtered.join(m, "upc", "left").join(o, "upc", "left")
    return joined.select(
        *[F.col(c) for c in filtered.columns],
        parent_brand(cfg).alias("parent_brand"),
        F.coalesce("_brand", "source_brand").alias("brand_line"),
        "flavor_mapped",
        "specific_flavor_raw",
        "specific_flavor_normalized",
        F.coalesce("_override", "flavor_mapped", "flavor_raw").alias("flavor"),
        F.coalesce("_pack", "source_pack_count").alias("pack_count"),
        "size_oz",
        flag(excluded_market(cfg)).alias("market_excluded_flag"),
    )


def own_scored(enriched: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Own-brand rows of markets that are scored."""
    return enriched.where(
        (F.col("parent_brand") == cfg.own_parent) & (F.col("market_excluded_flag") == 0)
    )


def build_lookup(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A lookup table from curated rows; duplicate keys are a configuration error."""
    rows = list(rows)
    keys = [r[0] for r in rows]
    if len(set(keys)) != len(keys):
        raise ValueError("lookup keys must be unique")
    return config_lookup(spark, rows, schema)


def attach_tier(df: DataFrame, cfg: RetailConfig, brand: str, out: str) -> DataFrame:
    """Competitor tier of a brand column, NULL when the brand is not listed."""
    tiers = config_lookup(
        df.sparkSession, sorted(cfg.brand_tiers.items()), f"`{brand}` string, `{out}` int"
    )
    return df.join(tiers, brand, "left")


def exclude_rollups(df: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Drop aggregate markets, which would double count their members."""
    geo = F.coalesce("geography_raw", F.lit(""))
    level = F.upper(F.coalesce("geography_level", F.lit("")))
    return df.where(
        ~F.upper(geo).rlike(cfg.rollup_pattern.upper()) & ~level.isin(*cfg.rollup_levels)
    )


def price_quality(cfg: RetailConfig, price: str = "arp", pack: str = "pack_count") -> Column:
    """Rows whose shelf price is usable."""
    ok = (F.col(pack) > 0) & (F.col(price) > 0)
    for prefix in cfg.price.excluded_upc_prefixes:
        ok = ok & ~F.col("upc").startswith(prefix)
    if cfg.price.excluded_upcs:
        ok = ok & ~F.col("upc").isin(*cfg.price.excluded_upcs)
    return ok & (safe_div(price, pack) >= cfg.price.min_price_per_unit)


def price_quality_filter(df: DataFrame, cfg: RetailConfig) -> DataFrame:
    return df.where(price_quality(cfg))


def at_market(
    df: DataFrame, channel: str | None = None, account: str | None = None,
    geography: str | None = None, since=None, upc: str | None = None, upc_col: str = "upc",
) -> DataFrame:
    """On-demand selection; every given argument becomes a pushed-down equality."""
    for column, value in (
        ("channel_outlet", channel), ("retail_account", account), ("geography_raw", geography),
        (upc_col, upc),
    ):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if since is None else df.where(F.col("week") >= F.lit(since))


#: Relationship distances offered by each comparison mode.
POOL_MODES = {
    "pack_ladder": (1,),
    "same_flavor_all_brands": (1, 2),
    "same_family_own": (1, 3),
    "same_family_all_brands": (1, 2, 3, 4),
    "all_own": (1, 3, 5),
}


def select_pool(
    pool: DataFrame, mode: str, cfg: RetailConfig, focal: str | None = None,
    brands: Iterable[str] = (), basket: DataFrame | None = None,
) -> DataFrame:
    """Narrow the comparison pool to a requested mode.

    `selected_brands` keeps candidates of the listed brands, `custom_basket` those in `basket`
    (one `candidate_upc` column).
    """
    out = pool if focal is None else pool.where(F.col("focal_upc") == focal)
    if mode in POOL_MODES:
        out = out.where(F.col("relationship_distance").isin(*POOL_MODES[mode]))
        if mode in ("same_family_own", "all_own"):
            out = out.where(F.col("candidate_brand") == cfg.own_parent)
        return out
    if mode == "selected_brands":
        return out.where(F.col("candidate_brand").isin(*brands))
    if mode == "custom_basket":
        return out.join(basket.select("candidate_upc").distinct(), "candidate_upc", "left_semi")
    raise ValueError(f"unknown pool mode {mode!r}")
