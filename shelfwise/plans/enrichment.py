"""Queries of group B."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions import flavor as fl
from shelfwise.functions import scalar as sc
from shelfwise.operators import enrich as en
from shelfwise.plans.registry import query

_KEYS = "week, upc, channel_outlet, retail_account, geography_raw"
KEYS = ["week", "upc", "channel_outlet", "retail_account", "geography_raw"]


@query("B1_filter_category", f"""
SELECT {_KEYS}, source_brand, units, base_units, dollars, tdp, stores_selling, store_count, arp,
  base_units_yago, tdp_yago, avg_weekly_units_spm_yago
FROM c_filtered WHERE week >= DATE '1996-01-01' AND week < DATE '1999-01-01'
""")
def _(t):
    out = en.filter_category(t.build_filtered(), t.cfg, dt.date(1996, 1, 1), dt.date(1999, 1, 1))
    return out.select(*KEYS, "source_brand", "units", "base_units", "dollars", "tdp",
                      "stores_selling", "store_count", "arp", "base_units_yago", "tdp_yago",
                      "avg_weekly_units_spm_yago")


@query("B2_enrich", f"""
SELECT {_KEYS}, parent_brand, brand_line, flavor_mapped, specific_flavor_normalized, flavor,
  pack_count, size_oz FROM c_enriched
""")
def _(t):
    return t.enriched.select(*KEYS, "parent_brand", "brand_line", "flavor_mapped",
                             "specific_flavor_normalized", "flavor", "pack_count", "size_oz")


@query("B3_excluded_markets", """
SELECT CASE WHEN channel_outlet = 'HOUSEHOLD' OR retail_account = 'ACCT-1' THEN 1 ELSE 0 END
  AS market_excluded_flag, count(*) AS n, sum(units) AS units
FROM c_filtered GROUP BY 1
""")
def _(t):
    import dataclasses

    cfg = dataclasses.replace(t.cfg, excluded_channels=("HOUSEHOLD",), excluded_accounts=("ACCT-1",))
    flagged = en.enrich(t.filtered, t.flavor_map, t.overrides, cfg)
    return flagged.groupBy("market_excluded_flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("B4_flavor_lookup", """
SELECT upc, source_brand AS brand, flavor_raw AS flavor_family,
  specific_flavor AS specific_flavor_normalized, source_pack_count AS pack_count FROM c_skus
""")
def _(t):
    return t.flavor_map.select("upc", "brand", "flavor_family", "specific_flavor_normalized",
                               "pack_count")


@query("B5_competitor_tier", """
SELECT source_brand,
  CASE source_brand WHEN 'BRAND0' THEN 1 WHEN 'BRAND1' THEN 1 WHEN 'BRAND2' THEN 2
    WHEN 'BRAND3' THEN 3 END AS competitor_tier,
  count(*) AS n, sum(base_units) AS base_units
FROM c_filtered GROUP BY 1, 2
""")
def _(t):
    return en.attach_tier(t.filtered, t.cfg, "source_brand", "competitor_tier").groupBy(
        "source_brand", "competitor_tier"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("base_units").alias("base_units"))


# descriptions in the style of a scanner export, made from the part names
def _description():
    kind = F.col("p_size") % 3
    return F.concat(
        F.lit("Brand "), F.col("p_name"),
        F.when(kind == 0, " Choc Prtn Brs").when(kind == 1, " Pff/Br").otherwise(" Vrty Pck"),
        F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 oz (12 ct) case"),
    )


_DESC_SQL = """
WITH d AS (
  SELECT p_partkey, p_name, 'Brand ' || p_name
    || CASE p_size % 3 WHEN 0 THEN ' Choc Prtn Brs' WHEN 1 THEN ' Pff/Br' ELSE ' Vrty Pck' END
    || ' ' || CAST(p_size AS VARCHAR) || '.5 oz (12 ct) case' AS description, p_size % 3 AS kind
  FROM part
), raw AS (
  SELECT p_partkey, p_name, description,
    CASE kind WHEN 0 THEN p_name || ' Chocolate' WHEN 1 THEN p_name ELSE 'Variety Pack' END
      AS flavor_text
  FROM d
)
--
"""


@query("B6_extract_flavor", _DESC_SQL + "SELECT p_partkey, description, flavor_text FROM raw")
def _(t):
    parts = t.read("part").select("p_partkey", _description().alias("description"))
    return parts.withColumn("flavor_text", fl.extract_flavor("description", ("brand",)))


@query("B7_normalize_flavor", _DESC_SQL + """
SELECT flavor_text, CASE WHEN flavor_text = 'Variety Pack' THEN 'Variety Pack' ELSE
  array_to_string(list_transform(string_split(flavor_text, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS flavor_name, count(*) AS n
FROM raw GROUP BY ALL
""")
def _(t):
    parts = t.read("part").select(fl.extract_flavor(_description(), ("brand",)).alias("flavor_text"))
    return parts.groupBy("flavor_text", fl.normalize_flavor("flavor_text").alias("flavor_name")).agg(
        F.count(F.lit(1)).alias("n"))


@query("B8_needs_review", """
SELECT p_size % 3 AS kind, CASE WHEN p_size % 3 = 0 THEN TRUE ELSE FALSE END AS needs_review,
  count(*) AS n FROM part GROUP BY ALL
""")
def _(t):
    # unexpanded text keeps its abbreviations and must be flagged
    kind = (F.col("p_size") % 3)
    raw = (F.when(kind == 0, F.concat("p_name", F.lit(" Choc Prtn")))
           .when(kind == 1, F.col("p_name")).otherwise(F.lit("Variety Pack")))
    parts = t.read("part").select(kind.alias("kind"), raw.alias("raw"))
    return parts.groupBy(
        "kind", fl.needs_review("raw", fl.normalize_flavor("raw")).alias("needs_review")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B9_exclude_rollups", """
SELECT upc, sum(units) AS units, count(*) AS n FROM c_filtered GROUP BY upc
""")
def _(t):
    # add national roll-up rows, as the export does, then drop them again
    total = t.filtered.withColumn("geography_raw", F.lit("TOTAL US - MULO")).withColumn(
        "geography_level", F.lit("National"))
    return en.exclude_rollups(t.filtered.unionByName(total), t.cfg).groupBy("upc").agg(
        F.sum("units").alias("units"), F.count(F.lit(1)).alias("n"))


@query("B10_price_quality", f"""
SELECT {_KEYS}, arp / pack_count AS price_per_unit FROM c_enriched
WHERE pack_count > 0 AND arp > 0 AND upc <> 'SKU-25' AND arp / pack_count >= 0.5
""")
def _(t):
    return en.price_quality_filter(t.enriched, t.cfg).select(
        *KEYS, sc.safe_div("arp", "pack_count").alias("price_per_unit"))


@query("B11_pack_bucket", """
SELECT p_size AS pack_count,
  CASE WHEN p_size = 1 THEN '1ct' WHEN p_size IN (4, 8, 12, 16, 18, 24)
    THEN CAST(p_size AS VARCHAR) || 'pk' ELSE 'other' END AS exact_bucket,
  CASE WHEN p_size = 1 THEN '1ct' WHEN p_size < 4 THEN '2-3pk' WHEN p_size < 6 THEN '4pk'
    WHEN p_size < 10 THEN '8pk' WHEN p_size < 15 THEN '12pk' WHEN p_size < 18 THEN '16pk'
    WHEN p_size < 21 THEN '18pk' ELSE CAST(p_size AS VARCHAR) || 'pk' END AS range_bucket,
  count(*) AS n
FROM part GROUP BY ALL
""")
def _(t):
    return t.read("part").groupBy(
        F.col("p_size").alias("pack_count"),
        sc.pack_bucket("p_size", "exact").alias("exact_bucket"),
        sc.pack_bucket("p_size", "range").alias("range_bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B12_pack_bands", """
SELECT CASE WHEN p_size <= 1 THEN 'single' WHEN p_size <= 4 THEN '2 to 4'
    WHEN p_size <= 8 THEN '5 to 8' WHEN p_size <= 12 THEN '9 to 12' ELSE '13 plus' END AS pack_band,
  CAST(p_size >= 10 AS INTEGER) AS large_pack_flag, CAST(p_size <= 4 AS INTEGER) AS small_pack_flag,
  count(*) AS n
FROM part GROUP BY ALL
""")
def _(t):
    return t.read("part").groupBy(
        sc.pack_band("p_size").alias("pack_band"),
        sc.flag(F.col("p_size") >= 10).alias("large_pack_flag"),
        sc.flag(F.col("p_size") <= 4).alias("small_pack_flag"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B13_segment_labels", """
WITH w AS (
  SELECT datediff('day', first_week_selling, week) // 7 AS age, weekofyear(week) AS woy, pack_count
  FROM c_own
)
--
SELECT CASE WHEN age < 13 THEN 'new' WHEN age < 52 THEN 'growing' ELSE 'mature' END AS maturity,
  CASE WHEN age < 13 THEN 'new' WHEN age < 26 THEN 'ramping' WHEN age < 52 THEN 'growing'
    ELSE 'mature' END AS maturity_fine,
  CASE WHEN pack_count = 1 THEN 'single' WHEN pack_count <= 12 THEN 'multipack' ELSE 'bulk' END
    AS pack_format,
  CASE WHEN woy <= 13 THEN 'Q1' WHEN woy <= 26 THEN 'Q2' WHEN woy <= 39 THEN 'Q3' ELSE 'Q4' END
    AS quarter,
  CASE WHEN age <= 26 THEN 'New' WHEN age <= 52 THEN 'Expanding' ELSE 'Mature' END AS stage,
  count(*) AS n
FROM w GROUP BY ALL
""")
def _(t):
    own = en.own_scored(t.enriched, t.cfg).select(
        sc.weeks_between("week", "first_week_selling").alias("age"),
        sc.week_of_year().alias("woy"), "pack_count")
    schemes = {"maturity": "age", "maturity_fine": "age", "pack_format": "pack_count",
               "quarter": "woy", "stage": "age"}
    return own.groupBy(
        *[sc.segment_labels(s, c).alias(s) for s, c in schemes.items()]
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B14_market_request", f"""
SELECT {_KEYS}, units, arp FROM c_filtered
WHERE channel_outlet = 'BUILDING' AND retail_account = 'ACCT-0' AND geography_raw = 'GEO-0'
  AND week >= DATE '2000-01-03' AND upc = 'SKU-03'
""")
def _(t):
    return en.at_market(t.filtered, "BUILDING", "ACCT-0", "GEO-0", dt.date(2000, 1, 3),
                        "SKU-03").select(*KEYS, "units", "arp")


@query("B15_safe_ratios", f"""
SELECT {_KEYS}, base_units / nullif(units, 0) AS base_share,
  dollars / nullif(base_units, 0) AS dollars_per_base_unit,
  units_promo / nullif(incr_units, 0) AS promo_to_incr
FROM c_filtered
""")
def _(t):
    return t.filtered.select(
        *KEYS, sc.safe_div("base_units", "units").alias("base_share"),
        sc.safe_div("dollars", "base_units").alias("dollars_per_base_unit"),
        sc.safe_div("units_promo", "incr_units").alias("promo_to_incr"))
