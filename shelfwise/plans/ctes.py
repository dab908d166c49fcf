"""Reference SQL for the shared tables, written against the order tables.

Names are used with a variant prefix: `c_` panel by market segment, own history cut at launch;
`u_` the same without the cut; `s_` one channel for all segments. `@x` inside a body means "the
same variant's x".
"""

from __future__ import annotations

TABLE_DDL = """
CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR);
CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER);
CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE,
  c_mktsegment VARCHAR);
CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR,
  p_size INTEGER, p_retailprice DOUBLE);
CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR,
  o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR);
CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER,
  l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
  l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP);
"""

CTE: dict[str, str] = {}

CTE["skus"] = """
SELECT bn,
  'SKU-' || lpad(CAST(bn AS VARCHAR), 2, '0') AS upc,
  'Item ' || CAST(bn AS VARCHAR) AS description,
  CASE WHEN bn <= 4 THEN 'OWN CORE' WHEN bn <= 8 THEN 'OWN PLUS'
       ELSE 'BRAND' || CAST((bn - 9) // 4 AS VARCHAR) END AS source_brand,
  'FL' || CAST(bn % 2 AS VARCHAR) AS flavor_raw,
  'SF' || CAST(bn % 4 AS VARCHAR) AS specific_flavor,
  CAST(CASE (bn // 4) % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 12 END AS BIGINT)
    AS source_pack_count,
  CASE WHEN bn % 5 <> 0 THEN CAST(8 + bn AS VARCHAR) || ' G' END AS nfp_protein,
  CASE bn % 4 WHEN 0 THEN '20 - 24 G' WHEN 1 THEN '15 - 19 G' WHEN 2 THEN '10 - 14 G'
       ELSE 'NOT STATED' END AS nfp_protein_range,
  CASE WHEN bn <= 8 THEN DATE '1997-01-06' + 56 * bn ELSE DATE '1995-01-02' END
    AS first_week_selling
FROM (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS bn FROM part) b
"""

CTE["filtered"] = """
SELECT m.*,
  CASE WHEN arp_pct_discount_any_promo > 0.05 THEN 1 ELSE 0 END AS promo_weeks,
  arp_pct_discount_any_promo * 2 AS units_lift_tpr,
  units_pct_promo / 2 AS units_lift_any_display,
  incr_units / nullif(units, 0) AS units_lift_any_feature,
  max(units) OVER ya AS units_yago,
  max(base_units) OVER ya AS base_units_yago,
  max(tdp) OVER ya AS tdp_yago,
  max(arp) OVER ya AS arp_yago,
  max(dollars) OVER ya AS dollars_yago,
  max(avg_weekly_units_spm) OVER ya AS avg_weekly_units_spm_yago
FROM (
  SELECT week, upc, channel_outlet, 'ACCT-' || CAST(acct AS VARCHAR) AS retail_account,
    'GEO-' || CAST(acct % 4 AS VARCHAR) AS geography_raw, 'RMA' AS geography_level,
    'BARS' AS subcategory, description, source_brand, source_pack_count, flavor_raw,
    nfp_protein, nfp_protein_range, first_week_selling,
    units, base_units, units_promo, dollars, base_dollars, tdp, stores_selling, store_count,
    units - base_units AS incr_units,
    units - units_promo AS units_non_promo,
    units_promo / nullif(units, 0) AS units_pct_promo,
    dollars / nullif(units, 0) AS arp,
    base_dollars / nullif(units, 0) AS base_arp,
    1 - dollars / nullif(base_dollars, 0) AS arp_pct_discount_any_promo,
    units / nullif(tdp, 0) AS avg_weekly_units_spm,
    units / nullif(stores_selling, 0) AS avg_weekly_units_per_store_selling_per_item,
    stores_selling / nullif(store_count, 0) AS pct_stores_selling,
    100.0::DOUBLE * tdp / 25.0::DOUBLE AS max_acv,
    80.0::DOUBLE * tdp / 25.0::DOUBLE AS avg_acv
  FROM (
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
      CAST(split_part(p_brand, '#', 2) AS INTEGER) AS bn,
      {channel} AS channel_outlet, c_custkey // 1000 AS acct,
      sum(l_quantity) AS units,
      sum(CASE WHEN l_discount <= 0.05 THEN l_quantity ELSE 0 END) AS base_units,
      sum(CASE WHEN l_discount > 0.07 THEN l_quantity ELSE 0 END) AS units_promo,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))))
        AS DOUBLE) / 1000 AS dollars,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS base_dollars,
      CAST(count(DISTINCT c_nationkey) AS DOUBLE) AS tdp,
      count(DISTINCT c_custkey) AS stores_selling
    FROM lineitem
    JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    GROUP BY ALL
  ) x
  JOIN (
    SELECT {channel} AS channel_outlet, c_custkey // 1000 AS acct, count(*) AS store_count
    FROM customer GROUP BY ALL
  ) s USING (channel_outlet, acct)
  JOIN @skus k USING (bn)
  WHERE {trim}
) m
WINDOW ya AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw
  ORDER BY datediff('day', DATE '1995-01-02', week) RANGE BETWEEN 364 PRECEDING AND 364 PRECEDING)
"""

CTE["enriched"] = """
SELECT f.*,
  CASE WHEN f.source_brand IN ('OWN CORE', 'OWN PLUS') THEN 'OWN' ELSE f.source_brand END
    AS parent_brand,
  f.source_brand AS brand_line,
  f.flavor_raw AS flavor_mapped,
  lower(k.specific_flavor) AS specific_flavor_raw,
  k.specific_flavor AS specific_flavor_normalized,
  CASE WHEN f.upc = 'SKU-06' THEN 'FL1' ELSE f.flavor_raw END AS flavor,
  f.source_pack_count AS pack_count,
  CAST(f.source_pack_count * 1.5 AS DOUBLE) AS size_oz,
  0 AS market_excluded_flag
FROM @filtered f JOIN @skus k USING (upc)
"""

CTE["own"] = "SELECT * FROM @enriched WHERE parent_brand = 'OWN'"


def render(name: str, variant: str) -> str:
    body = CTE[name].replace("@", f"{variant}_")
    if name == "filtered":
        body = body.replace("{channel}", "'ALL'" if variant == "s" else "c_mktsegment").replace(
            "{trim}", "TRUE" if variant == "u" else "week >= first_week_selling"
        )
    return body


# ---------------------------------------------------------------- pool, windows, pairs

SERIES = "upc, channel_outlet, retail_account, geography_raw"
MARKET = "channel_outlet, retail_account, geography_raw"
MW = f"week, {MARKET}"

CTE["pool"] = """
SELECT f.week, f.channel_outlet, f.retail_account, f.geography_raw, f.geography_level,
  f.upc AS focal_upc, f.parent_brand AS focal_brand, f.specific_flavor_normalized AS focal_flavor,
  f.flavor AS focal_flavor_family, f.pack_count AS focal_pack_count, f.arp AS focal_arp,
  f.description AS focal_description,
  f.first_week_selling AS focal_first_week_selling,
  c.upc AS candidate_upc, c.parent_brand AS candidate_brand, c.description AS candidate_description,
  c.specific_flavor_normalized AS candidate_flavor, c.flavor AS candidate_flavor_family,
  c.pack_count AS candidate_pack_count, c.arp AS candidate_arp, c.tdp AS candidate_tdp,
  c.units_pct_promo AS candidate_units_pct_promo, c.promo_weeks AS candidate_promo_weeks,
  c.base_units AS candidate_base_units, c.avg_weekly_units_spm AS candidate_velocity_spm,
  c.first_week_selling AS candidate_first_week_selling,
  r.relationship_distance,
  CASE r.relationship_distance WHEN 1 THEN 'SAME_SPECIFIC_FLAVOR_SAME_BRAND_PACK_LADDER'
    WHEN 2 THEN 'SAME_SPECIFIC_FLAVOR_CROSS_BRAND' WHEN 3 THEN 'SAME_FLAVOR_SAME_BRAND'
    WHEN 4 THEN 'SAME_FLAVOR_CROSS_BRAND' WHEN 5 THEN 'CROSS_FLAVOR_SAME_BRAND'
    ELSE 'CROSS_FLAVOR_CROSS_BRAND' END AS comparison_type,
  CASE WHEN f.parent_brand = c.parent_brand
    AND f.specific_flavor_normalized = c.specific_flavor_normalized
    THEN abs(f.pack_count - c.pack_count) END AS pack_distance,
  (f.arp / f.pack_count) / nullif(c.arp / c.pack_count, 0) AS price_per_unit_ratio,
  CASE c.source_brand WHEN 'BRAND0' THEN 1 WHEN 'BRAND1' THEN 1 WHEN 'BRAND2' THEN 2
    WHEN 'BRAND3' THEN 3 END AS candidate_competitor_tier
FROM @enriched f
JOIN @enriched c ON f.week = c.week AND f.channel_outlet = c.channel_outlet
  AND f.retail_account = c.retail_account AND f.geography_raw = c.geography_raw
  AND f.upc <> c.upc
CROSS JOIN LATERAL (SELECT CASE
  WHEN f.specific_flavor_normalized = c.specific_flavor_normalized
    AND f.parent_brand = c.parent_brand AND f.pack_count <> c.pack_count THEN 1
  WHEN f.specific_flavor_normalized = c.specific_flavor_normalized
    AND f.parent_brand <> c.parent_brand THEN 2
  WHEN f.flavor = c.flavor AND f.parent_brand = c.parent_brand
    AND f.specific_flavor_normalized <> c.specific_flavor_normalized THEN 3
  WHEN f.flavor = c.flavor AND f.parent_brand <> c.parent_brand THEN 4
  WHEN f.flavor <> c.flavor AND f.parent_brand = c.parent_brand THEN 5
  ELSE 6 END AS relationship_distance) r
WHERE (f.parent_brand = 'OWN' OR c.parent_brand = 'OWN')
  AND (f.specific_flavor_normalized = c.specific_flavor_normalized OR f.flavor = c.flavor
    OR (f.parent_brand = 'OWN' AND c.parent_brand = 'OWN'))
"""

_AVG = {
    "velocity_spm": "avg_weekly_units_spm",
    "velocity_store_selling": "avg_weekly_units_per_store_selling_per_item",
    "pct_stores_selling": "pct_stores_selling",
    "arp": "arp",
    "units_pct_promo": "units_pct_promo",
    "arp_discount": "arp_pct_discount_any_promo",
}


def span_sql(names: str, prefix: str = "") -> str:
    """`pre_13w:-13:-1:base_units+tdp:arp` -> conditional aggregates on column `o`."""
    out = []
    for item in names.split():
        span, lo, hi, sums, avgs = item.split(":")
        cond = f"o BETWEEN {lo} AND {hi}"
        out += [f"sum(CASE WHEN {cond} THEN {c} ELSE 0 END) AS {prefix}{span}_{c}"
                for c in sums.split("+")]
        out += [f"avg({_AVG[a]}) FILTER (WHERE {cond}) AS {prefix}{span}_{a}"
                for a in avgs.split("+")]
        out.append(f"count(*) FILTER (WHERE {cond}) AS {prefix}{span}_weeks_count")
    return ",\n  ".join(out)


_A4 = "velocity_spm+velocity_store_selling+pct_stores_selling+arp+units_pct_promo"
_A13 = _A4 + "+arp_discount"

CTE["prepost"] = f"""
SELECT {SERIES}, description, geography_level, parent_brand, brand_line,
  specific_flavor_normalized, flavor, pack_count, first_week_selling,
  {span_sql(
    f"pre_4w:-4:-1:base_units+tdp+promo_weeks:{_A4} post_4w:0:3:base_units+tdp+promo_weeks:{_A4} "
    f"pre_13w:-13:-1:base_units+tdp+promo_weeks:{_A13} "
    f"post_13w:0:12:base_units+tdp+promo_weeks:{_A13} "
    "pre_26w:-26:-1:base_units+tdp:velocity_spm post_26w:0:25:base_units+tdp:velocity_spm")},
  sum(CASE WHEN o BETWEEN -26 AND -14 THEN base_units ELSE 0 END) AS prior_13w_base_units,
  avg(avg_weekly_units_spm) FILTER (WHERE o BETWEEN -26 AND -14) AS prior_13w_velocity_spm,
  sum(CASE WHEN o BETWEEN 0 AND 12 THEN base_units_yago ELSE 0 END) AS yago_13w_base_units,
  sum(CASE WHEN y AND o < 0 THEN base_units ELSE 0 END) AS pre_ytd_base_units,
  count(*) FILTER (WHERE y AND o < 0) AS pre_ytd_weeks_count,
  sum(CASE WHEN y AND o >= 0 THEN base_units ELSE 0 END) AS post_ytd_base_units,
  count(*) FILTER (WHERE y AND o >= 0) AS post_ytd_weeks_count
FROM (SELECT *, CAST(floor(datediff('day', first_week_selling, week) / 7) AS INTEGER) AS o,
    year(week) = year(first_week_selling) AS y FROM @own) t
GROUP BY ALL
"""

CTE["launch_pairs"] = f"""
SELECT DISTINCT focal_upc, candidate_upc, {MARKET}, focal_first_week_selling,
  relationship_distance, comparison_type, pack_distance
FROM @pool WHERE relationship_distance <= 5
"""

CTE["donor"] = f"""
SELECT p.focal_upc, p.candidate_upc, p.channel_outlet, p.retail_account, p.geography_raw,
  p.focal_first_week_selling, p.relationship_distance, p.comparison_type, p.pack_distance,
  d.description AS candidate_description, d.flavor_raw AS candidate_flavor,
  d.source_pack_count AS candidate_pack_count,
  CASE WHEN d.source_brand LIKE 'OWN%' THEN 'OWN' ELSE d.source_brand END AS candidate_brand,
  d.source_brand AS candidate_brand_line,
  {span_sql(
    "pre_4w:-4:-1:base_units+promo_weeks:velocity_spm post_4w:0:3:base_units+promo_weeks:velocity_spm "
    f"pre_13w:-13:-1:base_units+promo_weeks:{_A13} post_13w:0:12:base_units+promo_weeks:{_A13} "
    "pre_26w:-26:-1:base_units:velocity_spm post_26w:0:25:base_units:velocity_spm", "donor_")},
  sum(CASE WHEN o BETWEEN 0 AND 12 THEN base_units_yago ELSE 0 END) AS donor_yago_13w_base_units
FROM @launch_pairs p
JOIN (SELECT * FROM @filtered) d ON d.upc = p.candidate_upc
  AND d.channel_outlet = p.channel_outlet AND d.retail_account = p.retail_account
  AND d.geography_raw = p.geography_raw
CROSS JOIN LATERAL (
  SELECT CAST(floor(datediff('day', p.focal_first_week_selling, d.week) / 7) AS INTEGER) AS o) w
GROUP BY ALL
"""

_PAIR = """
WITH j AS (
  SELECT f.upc AS focal_upc, f.channel_outlet, f.retail_account, f.geography_raw, f.geography_level,
    f.description AS focal_description, f.parent_brand AS focal_brand,
    f.specific_flavor_normalized AS focal_flavor, f.flavor AS focal_flavor_family,
    f.pack_count AS focal_pack_count, f.first_week_selling AS focal_first_week_selling,
    f.pre_13w_base_units AS b0, f.post_13w_base_units AS b1, f.yago_13w_base_units AS by_,
    f.pre_13w_tdp AS t0, f.post_13w_tdp AS t1, f.pre_13w_velocity_spm AS v0,
    f.post_13w_velocity_spm AS v1, f.pre_13w_velocity_store_selling AS s0,
    f.post_13w_velocity_store_selling AS s1, f.pre_13w_pct_stores_selling AS p0,
    f.post_13w_pct_stores_selling AS p1, f.pre_13w_arp AS a0, f.post_13w_arp AS a1,
    f.pre_13w_promo_weeks AS w0, f.post_13w_promo_weeks AS w1,
    f.pre_13w_units_pct_promo AS u0, f.post_13w_units_pct_promo AS u1,
    f.pre_13w_arp_discount AS d0, f.post_13w_arp_discount AS d1,
    f.pre_13w_weeks_count AS n0, f.post_13w_weeks_count AS n1,
    d.* EXCLUDE (focal_upc, channel_outlet, retail_account, geography_raw, focal_first_week_selling)
  FROM @prepost f JOIN @donor d ON f.upc = d.focal_upc AND f.channel_outlet = d.channel_outlet
    AND f.retail_account = d.retail_account AND f.geography_raw = d.geography_raw
    AND f.first_week_selling = d.focal_first_week_selling
  WHERE f.post_13w_weeks_count >= {min} AND d.donor_pre_13w_weeks_count >= {min}
    AND d.donor_post_13w_weeks_count >= {min} AND f.post_13w_base_units > 0
    AND f.post_13w_tdp > 0 AND d.donor_pre_13w_base_units > 0
), k AS (
  SELECT *, (b1 - b0) / nullif(b0, 0) AS fc,
    (donor_post_13w_base_units - donor_pre_13w_base_units) / nullif(donor_pre_13w_base_units, 0) AS dc,
    (t1 - t0) / nullif(t0, 0) AS tc, (v1 - v0) / nullif(v0, 0) AS vc,
    donor_post_13w_base_units - donor_pre_13w_base_units AS dd
  FROM j
)
SELECT focal_upc, candidate_upc AS donor_upc, channel_outlet, retail_account, geography_raw,
  focal_first_week_selling, geography_level, focal_description, focal_brand, focal_flavor,
  focal_flavor_family, focal_pack_count, candidate_description AS donor_description,
  candidate_flavor AS donor_flavor, candidate_pack_count AS donor_pack_count,
  candidate_brand AS donor_brand, candidate_brand_line AS donor_brand_line,
  relationship_distance, comparison_type, pack_distance, '13w' AS window_type,
  n0 AS focal_pre_weeks_count, n1 AS focal_post_weeks_count,
  donor_pre_13w_weeks_count, donor_post_13w_weeks_count,
  fc AS focal_base_units_pct_chg, dc AS donor_base_units_pct_chg,
  (b1 - b0) + dd AS base_units_delta_diff, tc AS focal_tdp_pct_chg,
  vc AS focal_velocity_spm_pct_chg,
  (donor_post_13w_velocity_spm - donor_pre_13w_velocity_spm)
    / nullif(donor_pre_13w_velocity_spm, 0) AS donor_velocity_spm_pct_chg,
  (v1 - v0) + (donor_post_13w_velocity_spm - donor_pre_13w_velocity_spm) AS velocity_spm_delta_diff,
  (s1 - s0) / nullif(s0, 0) AS focal_velocity_store_selling_pct_chg,
  (donor_post_13w_velocity_store_selling - donor_pre_13w_velocity_store_selling)
    / nullif(donor_pre_13w_velocity_store_selling, 0) AS donor_velocity_store_selling_pct_chg,
  (p1 - p0) / nullif(p0, 0) AS focal_pct_stores_selling_pct_chg,
  (donor_post_13w_pct_stores_selling - donor_pre_13w_pct_stores_selling)
    / nullif(donor_pre_13w_pct_stores_selling, 0) AS donor_pct_stores_selling_pct_chg,
  (a1 - a0) / nullif(a0, 0) AS focal_arp_pct_chg,
  w1 - w0 AS focal_promo_week_delta,
  donor_post_13w_promo_weeks - donor_pre_13w_promo_weeks AS donor_promo_week_delta,
  CASE WHEN abs(w1 - w0) > 2 OR abs(d1 - d0) > 0.05
    OR abs(donor_post_13w_promo_weeks - donor_pre_13w_promo_weeks) > 2 THEN 1 ELSE 0 END
    AS promo_confounded,
  a1 / nullif(focal_pack_count, 0) AS focal_price_per_unit,
  donor_post_13w_arp / nullif(candidate_pack_count, 0) AS donor_price_per_unit,
  (b1 - by_) / nullif(by_, 0) AS focal_base_units_yago_pct_chg,
  (donor_post_13w_base_units - donor_yago_13w_base_units)
    / nullif(donor_yago_13w_base_units, 0) AS donor_base_units_yago_pct_chg,
  b1 AS focal_post_base_units, b0 AS focal_pre_base_units, t1 AS focal_post_tdp,
  t0 AS focal_pre_tdp, v1 AS focal_post_velocity_spm, v0 AS focal_pre_velocity_spm,
  w1 AS focal_post_promo_weeks, w0 AS focal_pre_promo_weeks,
  u1 AS focal_post_units_pct_promo, u0 AS focal_pre_units_pct_promo,
  d1 AS focal_post_arp_discount, d0 AS focal_pre_arp_discount,
  donor_post_13w_base_units, donor_pre_13w_base_units, donor_post_13w_velocity_spm,
  donor_pre_13w_velocity_spm, donor_post_13w_promo_weeks, donor_pre_13w_promo_weeks,
  donor_post_13w_units_pct_promo, donor_pre_13w_units_pct_promo, donor_post_13w_arp_discount,
  donor_pre_13w_arp_discount,
  CASE WHEN dc < -0.10 AND fc > 0.03 THEN 'CANNIBALIZING' WHEN dc < -0.03 AND fc > 0 THEN 'WATCH'
    WHEN dc >= -0.03 THEN 'INCREMENTAL' ELSE 'NEUTRAL' END AS label_deterministic,
  CASE WHEN vc > 0 AND fc > 0 THEN 'DEMAND_LED' WHEN tc > 0.15 AND vc <= 0
    THEN 'DISTRIBUTION_LED' ELSE 'MIXED' END AS demand_vs_dist,
  CASE WHEN b1 > b0 THEN (b1 - b0) / ((b1 - b0) + greatest(0, -dd)) END AS incremental_share,
  CASE WHEN b1 > b0 THEN least(1, greatest(0, -dd) / (b1 - b0)) END AS cannibalization_rate
FROM k
"""
CTE["pairs"] = _PAIR.replace("{min}", "8")
CTE["pairs4"] = _PAIR.replace("{min}", "4")

CTE["rolling"] = """
SELECT e.*,
  avg(base_units) OVER w4 AS base_units_roll4_avg, stddev_samp(base_units) OVER w4
    AS base_units_roll4_std,
  avg(base_units) OVER w8 AS base_units_roll8_avg, stddev_samp(base_units) OVER w8
    AS base_units_roll8_std,
  avg(base_units) OVER w13 AS base_units_roll13_avg, stddev_samp(base_units) OVER w13
    AS base_units_roll13_std,
  avg(avg_weekly_units_spm) OVER w8 AS velocity_spm_roll8_avg,
  stddev_samp(avg_weekly_units_spm) OVER w8 AS velocity_spm_roll8_std,
  avg(avg_weekly_units_spm) OVER w13 AS velocity_spm_roll13_avg,
  stddev_samp(avg_weekly_units_spm) OVER w13 AS velocity_spm_roll13_std,
  avg(tdp) OVER w8 AS tdp_roll8_avg, stddev_samp(tdp) OVER w8 AS tdp_roll8_std,
  avg(tdp) OVER w13 AS tdp_roll13_avg, stddev_samp(tdp) OVER w13 AS tdp_roll13_std,
  base_units - lag(base_units) OVER w AS base_units_wow_delta,
  avg_weekly_units_spm - lag(avg_weekly_units_spm) OVER w AS velocity_spm_wow_delta
FROM @enriched e
WINDOW w AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week),
  w4 AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week
    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  w8 AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week
    ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
  w13 AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week
    ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
"""


def _z(c: str, name: str, n: int) -> str:
    std = f"{name}_roll{n}_std"
    return (f"CASE WHEN {std} > 0 THEN ({c} - {name}_roll{n}_avg) / {std} ELSE 0 END"
            f" AS {name}_z{n}")


def _class(z: str) -> str:
    return (f"CASE WHEN abs({z}) >= 3 THEN 'EXTREME_OUTLIER' WHEN abs({z}) >= 2 THEN 'OUTLIER' "
            f"WHEN abs({z}) >= 1.5 THEN 'WATCH' ELSE 'NORMAL' END")


CTE["events"] = f"""
SELECT z.*, {_class('base_units_z13')} AS base_units_outlier_class,
  {_class('velocity_spm_z13')} AS velocity_spm_outlier_class
FROM (SELECT r.*, {', '.join(_z(c, n, k) for c, n in (('base_units', 'base_units'),
    ('avg_weekly_units_spm', 'velocity_spm'), ('tdp', 'tdp')) for k in (8, 13))} FROM @rolling r) z
"""


# ---------------------------------------------------------------- wins, launches

CTE["flags"] = """
SELECT x.*,
  avg_weekly_units_spm > tv AS velocity_win_flag,
  base_units > tb AS base_units_win_flag,
  dollars > td AS dollars_win_flag,
  tdp > tt * 1.15 AS distribution_jump_flag,
  promo AS promo_confounded_flag,
  CASE WHEN tv IS NOT NULL THEN avg_weekly_units_spm > tv AND NOT promo END AS sku_week_win_flag,
  CASE WHEN tv IS NOT NULL AND tb IS NOT NULL
    THEN base_units > tb AND avg_weekly_units_spm > tv AND NOT promo END AS quality_win_flag
FROM (
  SELECT e.*, avg(avg_weekly_units_spm) OVER p AS tv, avg(base_units) OVER p AS tb,
    avg(dollars) OVER p AS td, avg(tdp) OVER p AS tt,
    promo_weeks > 0 OR incr_units > 0 AS promo, units - lag(units) OVER w AS du
  FROM @enriched e
  WINDOW w AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week),
    p AS (PARTITION BY upc, channel_outlet, retail_account, geography_raw ORDER BY week
      ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
) x
"""

CTE["assoc"] = f"""
SELECT focal_upc, comparison_upc, comparison_type, relationship_distance, {MARKET},
  count(*) AS active_pair_weeks,
  count(*) FILTER (WHERE fw) AS focal_win_weeks,
  count(*) FILTER (WHERE cw) AS comparison_win_weeks,
  count(*) FILTER (WHERE fw AND cw) AS co_win_weeks,
  count(*) FILTER (WHERE fw AND NOT cw) AS focal_win_comparison_loss_weeks,
  co_win_weeks / count(*) AS co_win_rate,
  focal_win_comparison_loss_weeks / count(*) AS opposition_rate,
  focal_win_comparison_loss_weeks / nullif(focal_win_weeks, 0) AS comparison_loss_given_focal_win,
  (focal_win_comparison_loss_weeks / nullif(focal_win_weeks, 0))
    / nullif(count(*) FILTER (WHERE NOT cw) / count(*), 0) AS conditional_loss_lift
FROM (
  SELECT p.focal_upc, p.candidate_upc AS comparison_upc, p.comparison_type,
    p.relationship_distance, p.channel_outlet, p.retail_account, p.geography_raw,
    f.sku_week_win_flag AS fw, c.sku_week_win_flag AS cw
  FROM @pool p
  JOIN @flags f ON f.week = p.week AND f.upc = p.focal_upc AND f.channel_outlet = p.channel_outlet
    AND f.retail_account = p.retail_account AND f.geography_raw = p.geography_raw
  JOIN @flags c ON c.week = p.week AND c.upc = p.candidate_upc
    AND c.channel_outlet = p.channel_outlet AND c.retail_account = p.retail_account
    AND c.geography_raw = p.geography_raw
) j GROUP BY ALL
"""

CTE["conc"] = f"""
SELECT {MW}, sum(du) FILTER (WHERE upc = 'SKU-05') AS focal_units_change,
  sum(du) AS group_units_change,
  greatest(focal_units_change, 0) / nullif(sum(du) FILTER (WHERE du > 0), 0)
    AS win_concentration_ratio,
  focal_units_change / nullif(sum(du), 0) AS focal_share_of_group_gain,
  count(*) FILTER (WHERE upc <> 'SKU-05' AND NOT sku_week_win_flag)
    / nullif(count(sku_week_win_flag) FILTER (WHERE upc <> 'SKU-05'), 0) AS related_loss_pct,
  bool_or(sku_week_win_flag) FILTER (WHERE upc = 'SKU-05') AS focal_won
FROM @flags GROUP BY ALL
"""

CTE["new_upcs"] = f"""
SELECT week, {SERIES}, description, source_brand, flavor_raw, flavor_mapped, flavor,
  specific_flavor_normalized, pack_count, size_oz, first_week_selling, units AS units_first_week,
  base_units AS base_units_first_week, tdp AS tdp_first_week, 'Y' AS manual_review_needed
FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week) AS rn FROM @own
  WHERE first_week_selling >= DATE '1997-04-06') x WHERE rn = 1
"""

CTE["classified"] = """
SELECT n.*,
  CASE WHEN fj.dp > 0 AND n.pack_count IN (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 18, 20, 24)
    THEN 'NEW_PACK_SIZE' WHEN fj.sp > 0 THEN 'DUPLICATE_OR_RELAUNCH'
    ELSE 'NEW_FLAVOR_CANDIDATE' END AS upc_classification,
  fj.partner AS closest_pack_partner_upc, fj.partner_desc AS closest_pack_partner_description,
  CASE WHEN n.flavor_mapped <> n.flavor THEN 'Y' ELSE 'N' END AS flavor_taxonomy_conflict
FROM @new_upcs n LEFT JOIN (
  SELECT p.upc,
    count(*) FILTER (WHERE c.pack_count <> p.pack_count AND p.flavor_mapped = p.flavor) AS dp,
    count(*) FILTER (WHERE c.pack_count = p.pack_count) AS sp,
    min(c.upc) FILTER (WHERE c.pack_count <> p.pack_count) AS partner,
    arg_min(c.description, c.upc) FILTER (WHERE c.pack_count <> p.pack_count) AS partner_desc
  FROM (SELECT DISTINCT upc, specific_flavor_normalized, flavor, flavor_mapped, pack_count
    FROM @new_upcs) p
  LEFT JOIN (SELECT DISTINCT upc, specific_flavor_normalized, flavor, pack_count, description
    FROM @own WHERE first_week_selling < DATE '1997-04-06') c
    ON c.specific_flavor_normalized = p.specific_flavor_normalized AND c.flavor = p.flavor
  GROUP BY p.upc
) fj USING (upc)
"""

_RIBBON = """'RAMP WEEK ' || CAST(n + 1 AS VARCHAR) || ' of {total} · ' || CASE
    WHEN n <= 5 THEN 'Cannibalization scoring suppressed'
    WHEN n <= 7 THEN 'Early signal · Low confidence'
    WHEN n <= {mature} THEN 'Signal maturing' ELSE 'Scoring fully active' END"""

_RAMP = f"""
SELECT week, {SERIES}, description, pack_count, first_week_selling, n AS weeks_since_launch,
  tdp, avg_weekly_units_spm, base_units, arp, peak_tdp, rolling_4w_avg_velocity_spm, tdp_4w_change,
  velocity_vs_4w_avg_ratio, {{trend}} AS distribution_trend,
  CASE WHEN n <= 5 THEN 'SUPPRESSED' WHEN n <= 7 THEN 'LOW_CONFIDENCE' ELSE 'ACTIVE' END
    AS scoring_status,
  {{confidence}} AS ramp_confidence, {{ribbon}} AS ui_ramp_ribbon,
  CASE WHEN {{under}} THEN 1 ELSE 0 END AS underperforming_flag,
  tdp / peak_tdp AS tdp_ratio_to_peak, {{slash}} AS tdp_now_slash_peak
FROM (
  SELECT b.*, max(tdp) OVER (s ROWS UNBOUNDED PRECEDING) AS peak_tdp,
    avg(avg_weekly_units_spm) OVER (s ROWS 3 PRECEDING) AS rolling_4w_avg_velocity_spm,
    tdp - lag(tdp, 4) OVER s AS tdp_4w_change,
    avg_weekly_units_spm / nullif(avg(avg_weekly_units_spm) OVER (s ROWS 3 PRECEDING), 0)
      AS velocity_vs_4w_avg_ratio
  FROM ({{rows}}) b
  WINDOW s AS (PARTITION BY {SERIES} ORDER BY week)
) r
"""
CTE["ramp16"] = _RAMP.format(
    rows="SELECT * FROM (SELECT *, datediff('day', first_week_selling, week) // 7 AS n FROM @own) q"
         " WHERE n BETWEEN 0 AND 15",
    trend="CASE WHEN tdp_4w_change IS NULL OR n < 4 OR tdp_4w_change > 0 THEN 'RAMPING' "
          "WHEN tdp_4w_change = 0 THEN 'STABLE' ELSE 'DECLINING' END",
    confidence="CASE WHEN n <= 5 THEN NULL WHEN n <= 7 THEN 'Low' ELSE 'Medium' END",
    ribbon=_RIBBON.format(total=13, mature=11),
    under="(n >= 6 AND velocity_vs_4w_avg_ratio < 0.85 AND tdp_4w_change <= 0) "
          "OR (n >= 8 AND velocity_vs_4w_avg_ratio < 0.85)",
    slash="CAST(CAST(tdp AS BIGINT) AS VARCHAR) || ' / ' || CAST(CAST(peak_tdp AS BIGINT) AS VARCHAR)",
)
CTE["ramp12"] = _RAMP.format(
    rows="SELECT * FROM (SELECT * REPLACE (fws AS first_week_selling), "
         "datediff('day', fws, week) // 7 AS n FROM (SELECT *, min(week) OVER (PARTITION BY "
         f"{SERIES}) AS fws FROM @own) o) q WHERE n < 12 AND fws >= DATE '1997-10-06'",
    trend="CASE WHEN tdp > coalesce(tdp - tdp_4w_change, tdp) * 1.05 THEN 'RAMPING' "
          "WHEN tdp / peak_tdp < 0.9 THEN 'DECLINING' "
          "WHEN tdp < coalesce(tdp - tdp_4w_change, tdp) * 0.95 THEN 'PEAKED' ELSE 'STABLE' END",
    confidence="CASE WHEN n <= 5 THEN NULL WHEN n <= 7 THEN 'Low' WHEN n <= 10 THEN 'Medium' "
               "ELSE 'High' END",
    ribbon=_RIBBON.format(total=12, mature=10),
    under="velocity_vs_4w_avg_ratio < 0.8",
    slash="printf('%.1f', tdp) || ' / ' || printf('%.1f', peak_tdp)",
)


# ---------------------------------------------------------------- prices

CTE["price"] = f"""
SELECT week, {SERIES}, description, parent_brand, specific_flavor_normalized, flavor, pack_count,
  first_week_selling, arp / pack_count AS price_per_unit,
  base_arp / pack_count AS base_price_per_unit,
  ln(greatest(arp / pack_count, 0.01)) AS ln_price_per_unit,
  ln(greatest(base_units, 1)) AS ln_base_units,
  ln(greatest(avg_weekly_units_spm, 0.01)) AS ln_velocity_spm,
  CASE WHEN disc >= 0.30 THEN '30pct_plus' WHEN disc >= 0.20 THEN '20_30pct'
    WHEN disc >= 0.10 THEN '10_20pct' WHEN disc > 0 THEN '0_10pct' ELSE 'no_promo' END
    AS promo_depth_bucket,
  CASE WHEN promo_weeks > 2 OR disc > 0.05 THEN 1 ELSE 0 END AS promo_confounded,
  weekofyear(week) AS week_of_year,
  base_units / nullif(base_units_yago, 0) - 1 AS base_units_yago_pct_chg,
  base_units, units, tdp, avg_weekly_units_spm, pct_stores_selling, arp, base_arp,
  disc AS arp_pct_discount_any_promo, promo_weeks, incr_units
FROM (SELECT *, arp_pct_discount_any_promo AS disc FROM @own) o
WHERE pack_count > 0 AND arp > 0 AND arp / pack_count >= 0.5 AND upc <> 'SKU-25'
"""

CTE["ladder"] = f"""
SELECT f.week, f.channel_outlet, f.retail_account, f.geography_raw, f.specific_flavor_normalized,
  f.flavor, f.parent_brand, f.upc AS focal_upc, f.description AS focal_description,
  f.pack_count AS focal_pack_count, f.price_per_unit AS focal_price_per_unit, f.arp AS focal_arp,
  f.base_units AS focal_base_units, f.avg_weekly_units_spm AS focal_avg_weekly_units_spm,
  p.upc AS partner_upc, p.description AS partner_description, p.pack_count AS partner_pack_count,
  p.price_per_unit AS partner_price_per_unit, p.arp AS partner_arp,
  p.base_units AS partner_base_units, p.avg_weekly_units_spm AS partner_avg_weekly_units_spm,
  f.price_per_unit / p.price_per_unit - 1 AS price_per_unit_gap_pct,
  abs(f.pack_count - p.pack_count) AS pack_distance,
  CASE WHEN f.pack_count < p.pack_count THEN 'TRADE_UP_AVAILABLE'
    WHEN f.pack_count > p.pack_count THEN 'TRADE_DOWN_AVAILABLE' ELSE 'SAME_PACK' END
    AS pack_direction,
  CASE WHEN p.pack_count > f.pack_count THEN 1 - p.price_per_unit / f.price_per_unit END
    AS trade_up_savings_pct,
  CASE WHEN p.pack_count > f.pack_count AND 1 - p.price_per_unit / f.price_per_unit < 0.10
    THEN 1 ELSE 0 END AS ladder_compression_flag
FROM @price f JOIN @price p USING ({MW}, specific_flavor_normalized, flavor, parent_brand)
WHERE f.upc <> p.upc
"""

CTE["comp"] = f"""
SELECT b.*, r.* EXCLUDE ({MW}), focal_price_per_unit / competitor_price_per_unit - 1
    AS price_gap_pct,
  CASE WHEN competitor_tier = 1 AND focal_flavor = competitor_flavor_raw
    AND focal_price_per_unit / competitor_price_per_unit - 1 >= 0.09 THEN 1 ELSE 0 END
    AS competitive_gap_watch_flag,
  CASE WHEN focal_flavor = competitor_flavor_raw THEN 'SAME_FLAVOR' ELSE 'DIFFERENT_FLAVOR' END
    AS flavor_relationship
FROM (SELECT {MW}, upc AS focal_upc, description AS focal_description, flavor AS focal_flavor,
    pack_count AS focal_pack_count, price_per_unit AS focal_price_per_unit,
    base_units AS focal_base_units FROM @price) b
JOIN (SELECT {MW}, upc AS competitor_upc, description AS competitor_description,
    source_brand AS competitor_brand, flavor_raw AS competitor_flavor_raw,
    source_pack_count AS competitor_pack_count, arp AS competitor_arp,
    arp / source_pack_count AS competitor_price_per_unit, base_units AS competitor_base_units,
    avg_weekly_units_spm AS competitor_velocity_spm,
    CASE source_brand WHEN 'BRAND0' THEN 1 WHEN 'BRAND1' THEN 1 WHEN 'BRAND2' THEN 2
      WHEN 'BRAND3' THEN 3 END AS competitor_tier
  FROM @filtered WHERE source_brand NOT LIKE 'OWN%' AND arp > 0 AND source_pack_count > 0) r
  USING ({MW})
"""

_PW = {"avg_price_per_unit": "avg(p.price_per_unit)", "velocity_spm": "avg(p.avg_weekly_units_spm)",
       "arp_discount": "avg(p.arp_pct_discount_any_promo)", "tdp": "avg(p.tdp)",
       "base_units": "sum(p.base_units)", "promo_weeks": "sum(p.promo_weeks)",
       "weeks_count": "count(*)"}
CTE["pwin"] = f"""
SELECT *, post_13w_avg_price_per_unit / nullif(pre_13w_avg_price_per_unit, 0) - 1 AS price_pct_chg,
  post_13w_base_units / nullif(pre_13w_base_units, 0) - 1 AS base_units_pct_chg,
  post_13w_velocity_spm / nullif(pre_13w_velocity_spm, 0) - 1 AS velocity_spm_pct_chg,
  post_13w_tdp / nullif(pre_13w_tdp, 0) - 1 AS tdp_pct_chg,
  CASE WHEN abs(post_13w_promo_weeks - pre_13w_promo_weeks) > 2
    OR abs(post_13w_arp_discount - pre_13w_arp_discount) > 0.05 THEN 1 ELSE 0 END
    AS promo_confounded,
  CASE WHEN abs(post_13w_avg_price_per_unit / pre_13w_avg_price_per_unit - 1) > 0.01
    THEN (post_13w_base_units / pre_13w_base_units - 1)
      / (post_13w_avg_price_per_unit / pre_13w_avg_price_per_unit - 1) END
    AS naive_price_elasticity
FROM (
  SELECT w.week, w.upc, w.channel_outlet, w.retail_account, w.geography_raw, w.description,
    w.pack_count, w.flavor, w.specific_flavor_normalized,
    {', '.join(f"{e} FILTER (WHERE p.week >= w.week - 84) AS post_13w_{n}" for n, e in _PW.items())},
    {', '.join(f"{e} FILTER (WHERE p.week <= w.week - 91) AS pre_13w_{n}" for n, e in _PW.items())},
    stddev_samp(p.price_per_unit) FILTER (WHERE p.week >= w.week - 84)
      AS post_13w_std_price_per_unit
  FROM @price w JOIN @price p ON p.upc = w.upc AND p.channel_outlet = w.channel_outlet
    AND p.retail_account = w.retail_account AND p.geography_raw = w.geography_raw
    AND p.week BETWEEN w.week - 175 AND w.week
  GROUP BY ALL
) x
WHERE pre_13w_weeks_count >= {{min}} AND post_13w_weeks_count >= {{min}} AND pre_13w_base_units > 0
"""
CTE["pwin4"] = CTE["pwin"].replace("{min}", "4")
CTE["pwin"] = CTE["pwin"].replace("{min}", "8")

CTE["norms"] = f"""
SELECT {MW}, CASE source_pack_count WHEN 1 THEN '1ct' WHEN 4 THEN '4pk' WHEN 8 THEN '8pk'
    WHEN 12 THEN '12pk' WHEN 16 THEN '16pk' WHEN 18 THEN '18pk' WHEN 24 THEN '24pk'
    ELSE 'other' END AS pack_size_bucket, source_pack_count AS pack_count,
  count(DISTINCT upc) AS norm_sku_count,
  avg(arp / source_pack_count) AS norm_avg_price_per_unit,
  median(arp / source_pack_count) AS norm_median_price_per_unit,
  avg(avg_weekly_units_spm) AS norm_avg_velocity_spm,
  avg(avg_weekly_units_per_store_selling_per_item) AS norm_avg_velocity_store_selling,
  avg(pct_stores_selling) AS norm_avg_pct_stores_selling, avg(tdp) AS norm_avg_tdp
FROM @filtered WHERE source_brand NOT LIKE 'OWN%' AND arp > 0 AND source_pack_count > 0
GROUP BY ALL
"""

# a fixed response stands in for the fitted model, so that scoring can be checked
CTE["elas"] = """
SELECT *, CASE WHEN e <= -2 THEN 'Highly Elastic' WHEN e <= -1 THEN 'Elastic'
  WHEN e <= -0.5 THEN 'Moderately Elastic' WHEN e <= 0 THEN 'Inelastic' WHEN e > 0 THEN 'Positive'
  ELSE 'Insufficient Price Variation' END AS elasticity_band, e AS implied_elasticity
FROM (
  SELECT *, CASE WHEN real_price_move
      THEN predicted_log_unit_change / nullif(log_price_change, 0) END AS e
  FROM (
    SELECT *, -0.8 * log_price_change + 0.3 * log_unit_change AS predicted_log_unit_change
    FROM (
      SELECT *, ln(greatest(post_13w_avg_price_per_unit, 0.01)
          / greatest(pre_13w_avg_price_per_unit, 0.01)) AS log_price_change,
        ln((post_13w_base_units + 1) / (pre_13w_base_units + 1)) AS log_unit_change,
        abs(post_13w_avg_price_per_unit - pre_13w_avg_price_per_unit) >= 0.05 AS real_price_move
      FROM @pwin4
    ) a
  ) b
) c
"""

CTE["promo"] = """
SELECT *, CASE WHEN base_units > 5 AND incr_units > 0 THEN least(incr_units / base_units, 5) END
    AS lift_rate_obs,
  CASE WHEN d IS NULL OR d <= 0 THEN 'no_promo' WHEN d >= 0.3 THEN '30pct_plus'
    WHEN d >= 0.2 THEN '20_30pct' WHEN d >= 0.1 THEN '10_20pct' ELSE '0_10pct' END
    AS discount_bucket,
  CASE WHEN d IS NULL OR d <= 0 THEN 'No price reduction' WHEN d >= 0.3 THEN '30%+ off'
    WHEN d >= 0.2 THEN '20–30% off' WHEN d >= 0.1 THEN '10–20% off' ELSE '<10% off' END
    AS discount_label,
  CASE WHEN greatest(lift_tpr, lift_display, lift_feature) <= 0 THEN 'Unknown'
    WHEN lift_tpr >= greatest(lift_display, lift_feature) THEN 'TPR'
    WHEN lift_display >= lift_feature THEN 'Display' ELSE 'Feature' END AS dominant_mechanic
FROM (
  SELECT week, upc, channel_outlet, retail_account, min(description) AS description,
    sum(base_units) AS base_units, sum(incr_units) AS incr_units, sum(units) AS total_units,
    sum(arp_pct_discount_any_promo * units) / nullif(sum(units), 0) AS discount_depth,
    sum(arp_pct_discount_any_promo * units) / nullif(sum(units), 0) AS d,
    avg(units_lift_tpr) AS lift_tpr, avg(units_lift_any_display) AS lift_display,
    avg(units_lift_any_feature) AS lift_feature, avg(arp) AS arp, avg(base_arp) AS base_arp,
    avg(tdp) AS tdp
  FROM @filtered WHERE source_brand LIKE 'OWN%'
    AND (incr_units > 0 OR arp_pct_discount_any_promo > 0.05)
  GROUP BY ALL
) g
"""


# ---------------------------------------------------------------- panel, flat forecast

CTE["flat"] = f"""
SELECT {SERIES}, anchor_week + CAST(7 * h AS INTEGER) AS week, h AS forecast_week_number,
  anchor_week, m * 0.8 AS forecast_units_low, m AS forecast_units_base, m * 1.2 AS forecast_units_high,
  arp, wsl + h AS weeks_since_launch, anchor_value
FROM (
  SELECT {SERIES}, max(week) AS anchor_week, avg(base_units) FILTER (WHERE rb <= 13) AS m,
    max(arp) FILTER (WHERE rb = 1) AS arp, max(base_units) FILTER (WHERE rb = 1) AS anchor_value,
    max(datediff('day', first_week_selling, week) // 7) AS wsl
  FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY week DESC) AS rb FROM @own
    WHERE week <= (SELECT max(week) FROM @own) - 91) q
  GROUP BY ALL
) a, (SELECT unnest(range(1, 14)) AS h) s
"""

CTE["promo_panel"] = f"""
SELECT *, greatest(r8 - arp, 0) AS dd0 FROM (
  SELECT week, {SERIES}, arp, units, base_units, units_promo, incr_units,
    lag(arp) OVER w AS l1, arp - lag(arp) OVER w AS delta,
    CASE WHEN count(arp) OVER p8 >= 2 THEN avg(arp) OVER p8 END AS r8
  FROM @own
  WINDOW w AS (PARTITION BY {SERIES} ORDER BY week),
    p8 AS (PARTITION BY {SERIES} ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
) x
"""
