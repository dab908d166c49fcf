"""Sources, sinks, validation and audits (group A)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.config import RetailConfig
from shelfwise.functions.scalar import case, safe_div
from shelfwise.operators.enrich import is_own
from shelfwise.scale import MAX_BROADCAST_ROWS
from shelfwise.schema import (
    EXTRACT_COLUMNS, SERIES_KEYS, assert_columns, normalize_header,
)

# ---------------------------------------------------------------- reading and writing


def normalize_extract(raw: DataFrame, mapping: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A1: rename export headers and cast to the panel types; numbers that do not parse are NULL.

    Columns absent from the export come out as typed NULLs.
    """
    mapping = mapping or EXTRACT_COLUMNS
    found = {normalize_header(c): c for c in raw.columns}
    out = []
    for header, (name, kind) in mapping.items():
        src = found.get(normalize_header(header))
        c = F.lit(None) if src is None else F.col(f"`{src}`")
        out.append((c.cast(kind) if src is None else c.try_cast(kind)).alias(name))
    return raw.select(*out)


def read_extract_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: export as text columns, typed by normalize_extract; no schema inference pass."""
    return normalize_extract(spark.read.option("header", True).csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A2: a published parquet table; column pruning and partition filters reach the scan."""
    return spark.read.parquet(path)


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("week", "yyyy-MM"))


def rebuild(df: DataFrame, path: str, table: str | None = None) -> None:
    """A4: replace a whole table, partitioned by month."""
    if table:
        assert_columns(df, table)
    _by_month(df).write.mode("overwrite").partitionBy("month").parquet(path)


def replace_weeks(df: DataFrame, path: str, start: date, end: date, table: str | None = None) -> None:
    """A3: replace the slice [start, end) of a table and leave every other month untouched.

    Bounds must be first days of months, because a month is the unit that is replaced. Months of
    the slice for which `df` has no rows are emptied as well. Running it twice gives the same table.
    """
    if start.day != 1 or end.day != 1 or start >= end:
        raise ValueError("slice bounds must be first days of months, start before end")
    if table:
        assert_columns(df, table)
    part = df.where((F.col("week") >= F.lit(start)) & (F.col("week") < F.lit(end)))
    spark = df.sparkSession
    _by_month(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month").parquet(path)
    present = {r.month for r in _by_month(part).select("month").distinct().collect()}
    y, m = start.year, start.month
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    while date(y, m, 1) < end:
        label = f"{y:04d}-{m:02d}"
        if label not in present:
            p = fs_path(f"{path}/month={label}")
            p.getFileSystem(conf).delete(p, True)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)


def append_run(df: DataFrame, path: str, run_id: str, table: str | None = None) -> None:
    """A5: append one scoring run under its own partition; repeating a run replaces only itself."""
    if table:
        assert_columns(df, table)
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str] = SERIES_KEYS) -> None:
    """Month partitions whose files are sorted by the join keys.

    Rows are ranged by (month, keys), not hashed by key, so one large market spreads over files.
    """
    m = _by_month(df)
    m.repartitionByRange("month", *keys).sortWithinPartitions("month", *keys).write.mode(
        "overwrite").partitionBy("month").parquet(path)


def run_batched(fn: Callable[[date, date], DataFrame], ranges: Sequence[tuple[date, date]]) -> DataFrame:
    """One result per time range, united. Needed only when a cluster cannot hold one run."""
    out = None
    for start, end in ranges:
        part = fn(start, end)
        out = part if out is None else out.unionByName(part)
    return out


def year_ranges(df: DataFrame, years: int = 2) -> list[tuple[date, date]]:
    """Ranges of whole years (end exclusive) that hold every row of `df`."""
    low, high, lost = df.agg(F.min("week"), F.max("week"), F.count_if(F.col("week").isNull())).first()
    if lost:
        raise ValueError(f"{lost} rows without a week are in no range")
    if low is None:
        return [(date.min, date.max)]
    return [(date(y, 1, 1), date(y + years, 1, 1)) for y in range(low.year, high.year + 1, years)]


# ---------------------------------------------------------------- snapshots and duplicates


def latest_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the newest run."""
    return df.where(F.col(ts) == df.agg(F.max(ts).alias("m")).scalar())


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A10: newest row per key; ties go to the largest remaining values.

    One aggregate with map-side combine: a key that holds a third of all copies costs one row per
    task in the shuffle, where a row_number window would sort all of them in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(
        *[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


# ---------------------------------------------------------------- validation


def ingest_checks(before: DataFrame, after: DataFrame, boundary: date, cfg: RetailConfig) -> DataFrame:
    """The gates a new delivery must pass, as (check_name, detail, value, verdict) rows.

    `boundary` is the last week of the previous delivery.
    """
    edge = F.lit(boundary)

    def rows(df: DataFrame, name: str, detail: Column, value: Column, ok: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("check_name"), detail.cast("string").alias("detail"),
            value.cast("double").alias("value"),
            F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))

    none = F.lit("")
    top = after.agg(F.max("week").alias("w"))
    high = rows(top, "high_water_mark", F.col("w"), F.datediff("w", edge), F.col("w") > edge)

    def yearly(df: DataFrame, tag: str) -> DataFrame:
        return df.where(F.col("week") <= edge).groupBy(F.year("week").alias("yr")).agg(
            F.count(F.lit(1)).alias(tag))

    hist = yearly(before, "_b").join(yearly(after, "_a"), "yr", "full_outer")
    hist = rows(hist, "history_unchanged", F.col("yr"),
                F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)),
                F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    weekly = after.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("u"))
    dup = after.groupBy("week", *SERIES_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dup = dup.agg(F.count(F.lit(1)).alias("c"))
    dup = rows(dup, "no_duplicate_rows", none, F.col("c"), F.col("c") == 0)
    # one row per week from here on
    gap = weekly.withColumn("prev", F.lag("week").over(Window.orderBy("week"))).agg(
        F.count_if(F.datediff("week", "prev") != 7).alias("c"))
    gap = rows(gap, "weekly_cadence", none, F.col("c"), F.col("c") == 0)

    def own_count(df: DataFrame) -> Column:
        return df.where(is_own(cfg)).agg(F.count_distinct("upc").alias("c")).scalar()

    keys = top.select(own_count(after).alias("a"), own_count(before).alias("b"))
    keys = rows(keys, "own_upcs_not_shrinking", F.col("b"), F.col("a"), F.col("a") >= F.col("b"))
    vol = weekly.agg(
        F.avg(F.when(F.col("week") > edge, F.col("n"))).alias("new"),
        F.avg(F.when(F.col("week") <= edge, F.col("n"))).alias("old"))
    ratio = safe_div("new", "old")
    vol = rows(vol, "volume_within_20pct", none, ratio, F.abs(ratio - 1) <= 0.20)
    out = high
    for part in (hist, dup, gap, keys, vol):
        out = out.unionByName(part)
    return out


def unmapped_keys(panel: DataFrame, lookup: DataFrame, cfg: RetailConfig) -> DataFrame:
    """Own products missing from a lookup."""
    own = panel.where(is_own(cfg)).select(
        "upc", "description", "source_pack_count", "flavor_raw").distinct()
    return own.join(lookup.select("upc"), "upc", "left_anti")


def lookup_diff(actual: DataFrame, expected: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of two lookups that differ; an equal pair yields nothing. NULL equals NULL."""
    a = actual.select(key, *[F.col(c).alias(f"actual_{c}") for c in columns], F.lit(True).alias("_a"))
    e = expected.select(key, *[F.col(c).alias(f"expected_{c}") for c in columns], F.lit(True).alias("_e"))
    j = a.join(e, key, "full_outer")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"actual_{c}").eqNullSafe(F.col(f"expected_{c}"))
    state = case([(F.col("_e").isNull(), "unexpected"), (F.col("_a").isNull(), "missing")], "different")
    return j.where(F.col("_a").isNull() | F.col("_e").isNull() | differs).select(
        key, *[f"{s}_{c}" for c in columns for s in ("actual", "expected")], state.alias("state"))


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Key coverage and numeric drift of two versions of a table, one row per measure."""
    left = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures], F.lit(1).alias("_b"))
    j = left.join(right, list(keys), "full_outer")
    aggs = [F.count("_a").alias("rows_a"), F.count("_b").alias("rows_b"),
            F.count_if(F.col("_b").isNull()).alias("only_a"),
            F.count_if(F.col("_a").isNull()).alias("only_b")]
    for m in measures:
        d = F.abs(F.col(f"a_{m}") - F.col(f"b_{m}"))
        null_differs = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (
            F.col(f"a_{m}").isNull() != F.col(f"b_{m}").isNull())
        aggs += [F.max(d).alias(f"d_{m}"), F.count_if((d > tol) | null_differs).alias(f"n_{m}")]
    s = j.agg(*aggs)
    packed = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"d_{m}").cast("double").alias("max_abs_diff"),
                 F.col(f"n_{m}").alias("rows_over_tolerance")) for m in measures]))
    return s.select("rows_a", "rows_b", "only_a", "only_b", packed.alias("m")).select(
        "rows_a", "rows_b", "only_a", "only_b", "m.*")


def sample_cells(panel: DataFrame, cfg: RetailConfig, n: int) -> DataFrame:
    """Pilot extract: own rows everywhere, tier-one rows in the n largest own markets."""
    cell = ["channel_outlet", "retail_account", "geography_level", "geography_raw"]
    own = is_own(cfg)
    top = panel.groupBy(*cell).agg(
        F.sum(F.when(own, F.coalesce("tdp", F.lit(0.0))).otherwise(0.0)).alias("own_tdp"),
        F.sum(F.when(own, F.coalesce("units", F.lit(0.0))).otherwise(0.0)).alias("own_units"),
    ).orderBy(F.desc("own_tdp"), F.desc("own_units"), *cell).limit(n).select(*cell)
    if n <= MAX_BROADCAST_ROWS:
        top = F.broadcast(top)
    rivals = panel.where(F.col("source_brand").isin(*cfg.tier_one_brands)).join(top, cell, "left_semi")
    return panel.where(own).unionByName(rivals)


def quality_audit(df: DataFrame, pack: str = "source_pack_count") -> DataFrame:
    """Counts of nulls, negatives, impossible prices, missing packs and duplicate keys."""
    measures = ["units", "base_units", "dollars", "tdp", "arp"]
    checks = {f"null_{c}": F.col(c).isNull() for c in [*SERIES_KEYS, *measures]}
    checks |= {f"negative_{c}": F.col(c) < 0 for c in measures}
    checks |= {
        "price_not_positive": F.col("arp") <= 0, "price_over_1000": F.col("arp") > 1000,
        "missing_pack": F.col(pack).isNull() | (F.col(pack) <= 0),
        "base_over_total": F.col("base_units") > F.col("units"),
    }
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    long = s.select("n_rows", F.explode(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in checks])).alias("c")
    ).select("c.check_name", "c.n_bad", "n_rows")
    dup = df.groupBy("week", *SERIES_KEYS).agg(F.count(F.lit(1)).alias("n")).agg(
        F.lit("duplicate_keys").alias("check_name"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return long.unionByName(dup)


def brand_catalog(panel: DataFrame) -> DataFrame:
    """Products, descriptions and active span of every brand."""
    return panel.groupBy("source_brand").agg(
        F.count_distinct("upc").alias("upc_count"),
        F.count_distinct("description").alias("sku_desc_count"),
        F.min("week").alias("first_week"), F.max("week").alias("last_week"))
