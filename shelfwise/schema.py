"""Keys, column contracts and the raw-extract schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARKET_KEYS = ["channel_outlet", "retail_account", "geography_raw"]
SERIES_KEYS = ["upc", *MARKET_KEYS]
MARKET_WEEK_KEYS = ["week", *MARKET_KEYS]
PAIR_KEYS = ["focal_upc", "donor_upc", *MARKET_KEYS]

#: Extract header -> (panel column, type). Headers are compared after
#: normalize_header, so CSV and parquet exports share one mapping.
EXTRACT_COLUMNS: dict[str, tuple[str, str]] = {
    "Time": ("week", "timestamp"),
    "Channel/Outlet": ("channel_outlet", "string"),
    "Geography Level": ("geography_level", "string"),
    "Retail Account": ("retail_account", "string"),
    "Retail Account Level": ("retail_account_level", "string"),
    "Geography": ("geography_raw", "string"),
    "Department": ("department", "string"),
    "Category": ("category", "string"),
    "Subcategory": ("subcategory", "string"),
    "UPC": ("upc", "string"),
    "Description": ("description", "string"),
    "Brand": ("source_brand", "string"),
    "PACK COUNT": ("source_pack_count", "bigint"),
    "FLAVOR": ("flavor_raw", "string"),
    "NFP - PROTEIN": ("nfp_protein", "string"),
    "NFP RANGES - PROTEIN VALUE": ("nfp_protein_range", "string"),
    "NFP - SUGARS": ("nfp_sugars", "string"),
    "NFP - CALORIES": ("nfp_calories", "string"),
    "STORAGE": ("storage", "string"),
    "UNIT OF MEASURE": ("unit_of_measure", "string"),
    "Units": ("units", "double"),
    "Units Yago": ("units_yago", "double"),
    "Base Units": ("base_units", "double"),
    "Base Units Yago": ("base_units_yago", "double"),
    "Dollars": ("dollars", "double"),
    "Base Dollars": ("base_dollars", "double"),
    "TDP": ("tdp", "double"),
    "TDP Yago": ("tdp_yago", "double"),
    "Average Weekly TDP": ("avg_weekly_tdp", "double"),
    "Max % ACV": ("max_acv", "double"),
    "Avg % ACV": ("avg_acv", "double"),
    "# of Stores": ("store_count", "bigint"),
    "# of Stores Selling": ("stores_selling", "bigint"),
    "% of Stores Selling": ("pct_stores_selling", "double"),
    "Average Weekly Units SPM": ("avg_weekly_units_spm", "double"),
    "Average Weekly Units Per Store Selling Per Item": (
        "avg_weekly_units_per_store_selling_per_item",
        "double",
    ),
    "Units SPM Per Item": ("units_spm_per_item", "double"),
    "Average Weekly Units per Store Selling": ("avg_weekly_units_per_store_selling", "double"),
    "ARP": ("arp", "double"),
    "ARP Yago": ("arp_yago", "double"),
    "Base ARP": ("base_arp", "double"),
    "ARP % Discount Any Promo": ("arp_pct_discount_any_promo", "double"),
    "Units Promo": ("units_promo", "double"),
    "Units Non-Promo": ("units_non_promo", "double"),
    "Units % Promo": ("units_pct_promo", "double"),
    "TDP Any Promo": ("tdp_any_promo", "double"),
    "TDP Non-Promo": ("tdp_non_promo", "double"),
    "Promo Weeks": ("promo_weeks", "bigint"),
    "Incr Units": ("incr_units", "double"),
    "Incr Dollars": ("incr_dollars", "double"),
    "Units % Lift TPR": ("units_lift_tpr", "double"),
    "Units % Lift Any Display": ("units_lift_any_display", "double"),
    "Units % Lift Any Feature": ("units_lift_any_feature", "double"),
    "First Week Selling": ("first_week_selling", "date"),
    "Number of Weeks Selling": ("number_of_weeks_selling", "bigint"),
}

#: Columns every published table must carry; writing fails before any data is moved.
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "filtered_weekly": ("week", *SERIES_KEYS, "source_brand", "source_pack_count", "base_units"),
    "enriched_weekly": ("week", *SERIES_KEYS, "parent_brand", "flavor", "pack_count"),
    "comparison_pool_weekly": (
        "week", *MARKET_KEYS, "focal_upc", "candidate_upc", "comparison_type",
        "relationship_distance",
    ),
    "pair_features": (*PAIR_KEYS, "label_deterministic", "relationship_distance"),
    "scored_pairs": (*PAIR_KEYS, "transfer_prob", "transfer_status", "transfer_confidence"),
    "event_queue": (*PAIR_KEYS, "event_type", "event_label", "event_color"),
    "price_event_queue": (
        "week", "focal_upc", *MARKET_KEYS, "event_type", "event_label", "trigger_value",
    ),
    "rate_weekly": ("week", "focal_upc", *MARKET_KEYS, "cannibalization_rate"),
    "sales_forecast": ("week", *SERIES_KEYS, "forecast_week_number", "forecast_units_base"),
}

#: One shape for every price-event detector, so the queue is a plain union.
PRICE_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("week", T.DateType()),
        T.StructField("focal_upc", T.StringType()),
        T.StructField("focal_description", T.StringType()),
        T.StructField("channel_outlet", T.StringType()),
        T.StructField("retail_account", T.StringType()),
        T.StructField("geography_raw", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_label", T.StringType()),
        T.StructField("event_color", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("trigger_value", T.DoubleType()),
        T.StructField("trigger_column", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("scoring_window", T.StringType()),
        T.StructField("focal_pack_count", T.LongType()),
        T.StructField("partner_pack_count", T.LongType()),
        T.StructField("partner_description", T.StringType()),
    ]
)


def normalize_header(name: str) -> str:
    """Fold an export header to a comparison key: commas dropped, blanks squeezed, lower case."""
    return re.sub(r"\s+", " ", name.replace(",", "")).strip().lower()


def assert_columns(df: DataFrame, required: str | Iterable[str]) -> DataFrame:
    """Fail when `df` lacks a column of a registered table (or of an explicit list)."""
    wanted = REQUIRED_COLUMNS[required] if isinstance(required, str) else tuple(required)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
