"""Queries of group A."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import ingest as ing
from shelfwise.operators.pool import comparison_pool
from shelfwise.plans.registry import query
from shelfwise.scale import scratch_dir
from shelfwise.schema import EXTRACT_COLUMNS, SERIES_KEYS, assert_columns

SERIES = "upc, channel_outlet, retail_account, geography_raw"


def as_export(panel):
    """The panel as an export file would carry it: report headers, everything as text."""
    have = {name: header for header, (name, _) in EXTRACT_COLUMNS.items() if name in panel.columns}
    return panel.select(*[F.col(n).cast("string").alias(h.upper() if i % 2 else h)
                          for i, (n, h) in enumerate(have.items())])


@query("A1_normalize_extract", f"""
SELECT week, {SERIES}, units, base_units, arp, source_pack_count, first_week_selling,
  CAST(NULL AS VARCHAR) AS department FROM c_filtered
""")
def _(t):
    return ing.normalize_extract(as_export(t.filtered)).select(
        "week", *SERIES_KEYS, "units", "base_units", "arp", "source_pack_count",
        "first_week_selling", "department")


@query("A2_read_table", """
SELECT p_brand, count(*) AS n, sum(p_size) AS total_size FROM part GROUP BY 1
""")
def _(t):
    return ing.read_table(t.spark, f"{t.dir}/part.parquet").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total_size"))


_MONTH = "SELECT CAST(strftime(week, '%Y-%m') AS VARCHAR) AS month, count(*) AS n, sum({m}) AS units"


@query("A3_replace_weeks", _MONTH.format(
    m="CASE WHEN week >= DATE '1999-03-01' AND week < DATE '1999-05-01' THEN 2 * units ELSE units END")
    + " FROM c_filtered GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark)
    rows = t.filtered.select("week", *SERIES_KEYS, "source_brand", "source_pack_count", "base_units", "units")
    ing.rebuild(rows, path, "filtered_weekly")
    restated = rows.withColumn("units", F.col("units") * 2)
    for _i in range(2):  # a repeated restatement changes nothing
        ing.replace_weeks(restated, path, dt.date(1999, 3, 1), dt.date(1999, 5, 1), "filtered_weekly")
    return ing.read_table(t.spark, path).groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("A4_rebuild", _MONTH.format(m="units") + " FROM c_filtered GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark)
    rows = t.filtered.select("week", *SERIES_KEYS, "units")
    for part in (rows.where("units > 10"), rows):
        ing.rebuild(part, path)
    return ing.read_table(t.spark, path).groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("A5_append_run", "SELECT 'r' || year(week) AS run_id, count(*) AS n, sum(units) AS units FROM c_filtered GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark)
    rows = t.filtered.select("week", *SERIES_KEYS, "units")
    years = sorted(r[0] for r in rows.select(F.year("week")).distinct().collect())
    for year in [*years, years[-1]]:  # a run that comes again replaces itself
        ing.append_run(rows.where(F.year("week") == year), path, f"r{year}")
    return ing.read_table(t.spark, path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("A6_write_clustered", _MONTH.format(m="units") + " FROM c_filtered GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark)
    ing.write_clustered(t.filtered.select("week", *SERIES_KEYS, "units"), path)
    return ing.read_table(t.spark, path).groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("A7_schema_guard", "SELECT source_brand, count(*) AS n FROM c_filtered GROUP BY 1")
def _(t):
    return assert_columns(t.filtered, "filtered_weekly").groupBy("source_brand").agg(
        F.count(F.lit(1)).alias("n"))


@query("A8_run_batched", "SELECT year(week) AS yr, count(*) AS pairs FROM c_pool GROUP BY 1")
def _(t):
    pools = ing.run_batched(lambda a, b: comparison_pool(t.enriched, t.cfg, a, b), ing.year_ranges(t.enriched))
    return pools.groupBy(F.year("week").alias("yr")).agg(F.count(F.lit(1)).alias("pairs"))


@query("A9_latest_snapshot", f"""
SELECT week, {SERIES}, units FROM c_filtered WHERE week = (SELECT max(week) FROM c_filtered)
""")
def _(t):
    return ing.latest_snapshot(t.filtered.select("week", *SERIES_KEYS, "units"), "week")


@query("A10_dedup_latest", f"""
SELECT {SERIES}, week, units, arp FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES}
  ORDER BY week DESC) AS rn FROM c_filtered) x WHERE rn = 1
""")
def _(t):
    return ing.dedup_latest(t.filtered.select(*SERIES_KEYS, "week", "units", "arp"), SERIES_KEYS, ["week"])


@query("A11_ingest_checks", """
WITH b AS (SELECT * FROM c_filtered WHERE week <= DATE '2001-06-25'),
y AS (SELECT year(week) AS yr, count(*) AS n FROM b GROUP BY 1),
wk AS (SELECT week, count(*) AS n FROM c_filtered GROUP BY 1),
g AS (SELECT week, datediff('day', lag(week) OVER (ORDER BY week), week) AS d FROM wk),
v AS (SELECT avg(n) FILTER (WHERE week > DATE '2001-06-25')
  / avg(n) FILTER (WHERE week <= DATE '2001-06-25') AS r FROM wk)
--
SELECT 'high_water_mark' AS check_name, CAST(max(week) AS VARCHAR) AS detail,
  CAST(datediff('day', DATE '2001-06-25', max(week)) AS DOUBLE) AS value, 'PASS' AS verdict FROM c_filtered
UNION ALL SELECT 'history_unchanged', CAST(yr AS VARCHAR), 0.0, 'PASS' FROM y
UNION ALL SELECT 'no_duplicate_rows', '', 0.0, 'PASS'
UNION ALL SELECT 'weekly_cadence', '', CAST(count(*) FILTER (WHERE d <> 7) AS DOUBLE),
  CASE WHEN count(*) FILTER (WHERE d <> 7) = 0 THEN 'PASS' ELSE 'FAIL' END FROM g
UNION ALL SELECT 'own_upcs_not_shrinking', '8', 8.0, 'PASS'
UNION ALL SELECT 'volume_within_20pct', '', r, CASE WHEN abs(r - 1) <= 0.2 THEN 'PASS' ELSE 'FAIL' END FROM v
""")
def _(t):
    edge = dt.date(2001, 6, 25)
    return ing.ingest_checks(t.filtered.where(F.col("week") <= F.lit(edge)), t.filtered, edge, t.cfg)


@query("A12_unmapped_keys", """
SELECT DISTINCT upc, description, source_pack_count, flavor_raw FROM c_filtered
WHERE source_brand LIKE 'OWN%' AND upc NOT IN ('SKU-01', 'SKU-02', 'SKU-04')
""")
def _(t):
    mapped = t.flavor_map.where(F.col("upc").isin("SKU-01", "SKU-02", "SKU-04"))
    return ing.unmapped_keys(t.filtered, mapped, t.cfg)


@query("A13_lookup_diff", """
SELECT upc, flavor_raw AS actual_flavor_family, CASE WHEN upc = 'SKU-05' THEN 'FLX' WHEN upc = 'SKU-09'
    THEN NULL ELSE flavor_raw END AS expected_flavor_family,
  CASE WHEN upc = 'SKU-09' THEN 'unexpected' ELSE 'different' END AS state
FROM c_skus WHERE upc IN ('SKU-05', 'SKU-09')
""")
def _(t):
    expected = t.flavor_map.where("upc <> 'SKU-09'").withColumn(
        "flavor_family", F.when(F.col("upc") == "SKU-05", "FLX").otherwise(F.col("flavor_family")))
    return ing.lookup_diff(t.flavor_map, expected, "upc", ["flavor_family"])


@query("A14_table_diff", """
SELECT count(*) AS rows_a, count(*) FILTER (WHERE upc <> 'SKU-25') AS rows_b,
  count(*) FILTER (WHERE upc = 'SKU-25') AS only_a, 0 AS only_b, 'units' AS measure,
  0.5 AS max_abs_diff, count(*) FILTER (WHERE upc = 'SKU-10') AS rows_over_tolerance FROM c_filtered
UNION ALL SELECT count(*), count(*) FILTER (WHERE upc <> 'SKU-25'),
  count(*) FILTER (WHERE upc = 'SKU-25'), 0, 'tdp', 0.0, 0 FROM c_filtered
""")
def _(t):
    b = t.filtered.where("upc <> 'SKU-25'").withColumn(
        "units", F.when(F.col("upc") == "SKU-10", F.col("units") + 0.5).otherwise(F.col("units")))
    return ing.table_diff(t.filtered, b, ["week", *SERIES_KEYS], ["units", "tdp"])


@query("A15_sample_cells", f"""
WITH top AS (
  SELECT channel_outlet, retail_account, geography_raw FROM c_filtered GROUP BY ALL
  ORDER BY sum(CASE WHEN source_brand LIKE 'OWN%' THEN tdp ELSE 0 END) DESC,
    sum(CASE WHEN source_brand LIKE 'OWN%' THEN units ELSE 0 END) DESC,
    channel_outlet, retail_account, geography_raw LIMIT 3
)
--
SELECT week, {SERIES}, units FROM c_filtered WHERE source_brand LIKE 'OWN%'
  OR (source_brand IN ('BRAND0', 'BRAND1') AND (channel_outlet, retail_account, geography_raw)
    IN (SELECT (channel_outlet, retail_account, geography_raw) FROM top))
""")
def _(t):
    return ing.sample_cells(t.filtered, t.cfg, 3).select("week", *SERIES_KEYS, "units")


_AUDIT = [f"null_{c}" for c in (*SERIES_KEYS, "units", "base_units", "dollars", "tdp", "arp")] + [
    f"negative_{c}" for c in ("units", "base_units", "dollars", "tdp", "arp")] + [
    "price_not_positive", "price_over_1000", "missing_pack"]


@query("A16_quality_audit", "SELECT 'base_over_total' AS check_name, count(*) FILTER (WHERE base_units > units) "
       "AS n_bad, count(*) AS n_rows FROM c_filtered UNION ALL SELECT 'duplicate_keys', 0, count(*) "
       "FROM c_filtered " + " ".join(
           f"UNION ALL SELECT '{n}', count(*) FILTER (WHERE {cond}), count(*) FROM c_filtered"
           for n, cond in ((a, f"{a[5:]} IS NULL" if a.startswith("null_") else f"{a[9:]} < 0"
                            if a.startswith("negative_") else
                            {"price_not_positive": "arp <= 0", "price_over_1000": "arp > 1000",
                             "missing_pack": "source_pack_count IS NULL OR source_pack_count <= 0"}[a])
                           for a in _AUDIT)))
def _(t):
    return ing.quality_audit(t.filtered)


@query("A17_brand_catalog", """
SELECT source_brand, count(DISTINCT upc) AS upc_count, count(DISTINCT description) AS sku_desc_count,
  min(week) AS first_week, max(week) AS last_week FROM c_filtered GROUP BY 1
""")
def _(t):
    return ing.brand_catalog(t.filtered)
