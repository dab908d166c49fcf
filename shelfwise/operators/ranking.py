"""Top-k, representative rows and as-of lookups (group F, C15, C16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.schema import MARKET_KEYS, SERIES_KEYS


def top_series(panel: DataFrame, n: int, measure: str = "base_units",
               keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """the n largest series (or accounts) by total volume; ties by key.

    orderBy + limit keeps n rows per task, so no global sort happens.
    """
    return panel.groupBy(*keys).agg(F.sum(measure).alias("total")).orderBy(
        F.desc("total"), *keys).limit(n)


def dominant_channel(panel: DataFrame, n: int) -> DataFrame:
    """per product and account the channel selling most, then the n largest."""
    total = panel.groupBy("upc", "retail_account", "channel_outlet").agg(
        F.sum("base_units").alias("total"))
    # one aggregate instead of a window: the largest (total, name) wins
    best = total.groupBy("upc", "retail_account").agg(
        F.min_by("channel_outlet", F.struct(-F.col("total"), "channel_outlet")).alias(
            "channel_outlet"),
        F.max("total").alias("total"),
    )
    return best.orderBy(F.desc("total"), "upc", "retail_account").limit(n)


def one_per_series(events: DataFrame, change: str = "price_pct_chg") -> DataFrame:
    """the event with the largest absolute change per series; ties by the earlier week."""
    order = Window.partitionBy(*SERIES_KEYS).orderBy(F.desc(F.abs(change)), "week")
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def top_rates(rates: DataFrame, n: int = 10) -> DataFrame:
    """F8: focal products with the highest mean rate."""
    return rates.groupBy("focal_upc", *MARKET_KEYS).agg(
        F.avg("cannibalization_rate").alias("avg_rate"), F.count(F.lit(1)).alias("weeks")
    ).orderBy(F.desc("avg_rate"), "focal_upc", *MARKET_KEYS).limit(n)


def qualify_series(panel: DataFrame, cutoff, min_train: int, min_test: int) -> DataFrame:
    """Rows of series with enough weeks before the cutoff and from it on."""
    c = F.lit(cutoff)
    good = panel.groupBy(*SERIES_KEYS).agg(
        F.count_if(F.col("week") < c).alias("_tr"), F.count_if(F.col("week") >= c).alias("_te")
    ).where((F.col("_tr") >= min_train) & (F.col("_te") >= min_test))
    return panel.join(good, SERIES_KEYS, "left_semi")


def asof_last(panel: DataFrame, as_of, columns: Sequence[str]) -> DataFrame:
    """Newest non-null value of each column at or before a date, per series."""
    rows = panel.where(F.col("week") <= F.lit(as_of))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("week"))).alias(c)

    return rows.groupBy(*SERIES_KEYS).agg(
        F.max("week").alias("last_week"), *[newest(c) for c in columns])


def asof_join(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """C16, general form: attach to every left row the newest right value at or before its week.

    Union and carry forward: one shuffle on the series instead of an inequality join.
    """
    both = left.select(*SERIES_KEYS, "week", F.lit(1).alias("_side"),
                       F.lit(None).cast("double").alias("_v")).unionByName(
        right.select(*SERIES_KEYS, "week", F.lit(0).alias("_side"),
                     F.col(value).cast("double").alias("_v")))
    carry = Window.partitionBy(*SERIES_KEYS).orderBy("week", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(carry)).where(
        "_side = 1").drop("_side", "_v")
