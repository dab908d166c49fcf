"""The order tables as a weekly point-of-sale panel.

Order lines stand in for scans: 25 part brands become SKUs, market segments become channels, and
blocks of 1,000 customers become retail accounts, so the panel grows with the data. Money is in
thousands, which brings prices per unit into the range of shelf prices.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.config import PriceRules, RetailConfig
from shelfwise.functions.scalar import case, flag, safe_div
from shelfwise.scale import config_lookup, counted, written

CUSTOMERS_PER_ACCOUNT = 1000
OWN_SKUS = 8
CATEGORY_START = date(1995, 1, 2)
FIRST_LAUNCH = date(1997, 1, 6)
LAUNCH_STEP_DAYS = 56
#: measures with a year-ago twin
YEAR_AGO = ("units", "base_units", "tdp", "arp", "dollars", "avg_weekly_units_spm")

FIXTURE_CONFIG = RetailConfig(
    own_brands=("OWN CORE", "OWN PLUS"),
    own_parent="OWN",
    subcategory="BARS",
    excluded_channels=("MILITARY",),
    excluded_accounts=("ACCT-DECA",),
    brand_tiers={"BRAND0": 1, "BRAND1": 1, "BRAND2": 2, "BRAND3": 3},
    price=PriceRules(excluded_upc_prefixes=("SKU-9",), excluded_upcs=("SKU-25",)),
)

#: flavor override lookup: upc -> canonical flavor
OVERRIDES = [("SKU-06", "FL1")]


def sku_columns(bn: Column) -> dict[str, Column]:
    """Product attributes as a function of the brand number."""
    text = bn.cast("string")
    upc = F.concat(F.lit("SKU-"), F.lpad(text, 2, "0"))
    own = bn <= OWN_SKUS
    return {
        "upc": upc,
        "description": F.concat(F.lit("Item "), text),
        "source_brand": F.when(own & (bn <= 4), "OWN CORE")
        .when(own, "OWN PLUS")
        .otherwise(F.concat(F.lit("BRAND"), F.floor((bn - 9) / 4).cast("string"))),
        "flavor_raw": F.concat(F.lit("FL"), (bn % 2).cast("string")),
        "specific_flavor": F.concat(F.lit("SF"), (bn % 4).cast("string")),
        "source_pack_count": F.element_at(
            F.array(*[F.lit(p) for p in (1, 4, 8, 12)]), ((F.floor(bn / 4) % 4) + 1).cast("int")
        ).cast("bigint"),
        "nfp_protein": F.when(bn % 5 != 0, F.concat((8 + bn).cast("string"), F.lit(" G"))),
        "nfp_protein_range": case(
            [(bn % 4 == 0, "20 - 24 G"), (bn % 4 == 1, "15 - 19 G"), (bn % 4 == 2, "10 - 14 G")],
            "NOT STATED",
        ),
        "first_week_selling": F.when(
            own, F.date_add(F.lit(FIRST_LAUNCH), (bn * LAUNCH_STEP_DAYS).cast("int"))
        ).otherwise(F.lit(CATEGORY_START)),
    }


#: (application, directory, channel, trimmed) -> stored panel; (application, directory, "skus") -> SKUs
_STORED: dict[tuple, DataFrame] = {}


class Tables:
    """Tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, channel: str = "segment",
                 trim_launch: bool = True, cfg: RetailConfig = FIXTURE_CONFIG):
        self.spark, self.dir, self.cfg = spark, sf_dir, cfg
        self.channel, self.trim_launch = channel, trim_launch

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def skus(self) -> DataFrame:
        """One row per SKU found in `part`.

        Stored on first use, so joins plan with its own size. Derived, it counts as large as `part`,
        and each join would move the panel by its few product keys.
        """
        key = (self.spark.sparkContext.applicationId, self.dir, "skus")
        if key not in _STORED:
            bn = F.substring_index("p_brand", "#", -1).cast("int")
            cols = sku_columns(F.col("bn"))
            _STORED[key] = written(self.read("part").select(bn.alias("bn")).distinct().select(
                "bn", *[c.alias(n) for n, c in cols.items()]
            ))
        return _STORED[key]

    @cached_property
    def flavor_map(self) -> DataFrame:
        """Curated flavor lookup, one row per mapped UPC."""
        return self.skus.select(
            "upc",
            F.col("source_brand").alias("brand"),
            F.col("flavor_raw").alias("flavor_family"),
            F.lower("specific_flavor").alias("specific_flavor_raw"),
            F.col("specific_flavor").alias("specific_flavor_normalized"),
            F.col("source_pack_count").alias("pack_count"),
            (F.col("source_pack_count") * 1.5).cast("double").alias("size"),
        )

    @cached_property
    def overrides(self) -> DataFrame:
        return config_lookup(self.spark, OVERRIDES, "upc string, flavor_canonical string")

    @cached_property
    def filtered(self) -> DataFrame:
        """The weekly panel as a stored table; built on first use in an application.

        Every later step scans it several times, so it is written once, as the pipeline this
        library serves does, instead of being derived from the order lines again by each scan.
        """
        key = (self.spark.sparkContext.applicationId, self.dir, self.channel, self.trim_launch)
        if key not in _STORED:
            _STORED[key] = written(self.build_filtered())
        return _STORED[key]

    def build_filtered(self) -> DataFrame:
        """One row per SKU x channel x account x market x week, measures included.

        Order lines are the bulk of the input. They meet the customer of their order on the order
        key and then move once more, as narrow rows, to their channel and account. An account is a
        block of customers, so its rows are bounded; folding, store counts and year-ago twins all
        run where they lie, and columns that follow from others are only added after that.
        """
        lines = self.read("lineitem").select(
            "l_orderkey",
            "l_partkey",
            F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"),
            F.col("l_quantity").alias("qty"),
            # 1 base price, 2 promotion, 0 neither
            F.when(F.col("l_discount") <= 0.05, 1).when(F.col("l_discount") > 0.07, 2).otherwise(0)
            .alias("offer"),
            F.expr("cast(l_discount as decimal(4,2))").alias("disc"),
            F.expr("cast(l_extendedprice as decimal(18,2))").alias("gross"),
        )
        parts = self.read("part").select(
            "p_partkey", F.substring_index("p_brand", "#", -1).cast("int").alias("bn")
        )
        parts = counted(parts, self.read("part").count())
        sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
        if self.trim_launch:
            sold = sold.where(F.col("week") >= sku_columns(F.col("bn"))["first_week_selling"])
        account = F.floor(F.col("c_custkey") / CUSTOMERS_PER_ACCOUNT).cast("int")
        segment = F.col("c_mktsegment") if self.channel == "segment" else F.lit("ALL")
        customers = self.read("customer").select(
            "c_custkey", "c_nationkey", segment.alias("channel_outlet"), account.alias("acct")
        )
        stores = customers.groupBy("channel_outlet", "acct").agg(
            F.count(F.lit(1)).alias("store_count")
        )
        buyers = self.read("orders").select("o_orderkey", "o_custkey").join(
            counted(customers, self.read("customer").count()), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
        # a constant channel is no partition key: all later steps could not rely on it
        place = ["channel_outlet", "acct"] if self.channel == "segment" else ["acct"]
        # a stated number is never merged into fewer: many groups wait here, and large tasks would spill
        n_tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # rows of one customer are folded first, so the distinct counts below need no second pass
        cell = ["week", "bn", "channel_outlet", "acct"]
        per_customer = (
            sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
            .drop("l_orderkey", "o_orderkey")
            .repartition(n_tasks, *place)
            .groupBy(*cell, "c_custkey", "c_nationkey")
            .agg(
                F.sum("qty").alias("units"),
                F.sum(F.when(F.col("offer") == 1, F.col("qty")).otherwise(0.0)).alias("base_units"),
                F.sum(F.when(F.col("offer") == 2, F.col("qty")).otherwise(0.0)).alias("units_promo"),
                F.sum("gross").alias("gross"),
                F.sum(F.expr("gross * (1 - disc)")).alias("net"),
            )
        )
        cells = per_customer.groupBy(*cell).agg(
            F.sum("units").alias("units"),
            F.sum("base_units").alias("base_units"),
            F.sum("units_promo").alias("units_promo"),
            (F.sum("net").cast("double") / 1000).alias("dollars"),
            (F.sum("gross").cast("double") / 1000).alias("base_dollars"),
            F.count_distinct("c_nationkey").cast("double").alias("tdp"),
            F.count(F.lit(1)).alias("stores_selling"),
        )
        sku = sku_columns(F.col("bn"))
        priced = cells.join(stores, ["channel_outlet", "acct"]).select(
            "*",
            sku["upc"].alias("upc"),
            safe_div("dollars", "units").alias("arp"),
            safe_div("units", "tdp").alias("avg_weekly_units_spm"),
        )
        # year-ago twins: the row exactly 52 weeks earlier; an account has one name and one market
        year_ago = Window.partitionBy("channel_outlet", "acct", "upc").orderBy(
            F.datediff("week", F.lit(CATEGORY_START))).rangeBetween(-364, -364)
        rows = priced.select(
            "*",
            *[F.max(c).over(year_ago).alias(f"{c}_yago") for c in YEAR_AGO],
        )
        rows = rows.select(
            "*", *[sku[n].alias(n) for n in sku if n not in ("upc", "specific_flavor")]
        )
        twins = [f"{c}_yago" for c in YEAR_AGO]
        rows = rows.select(
            *twins,
            "week",
            "upc",
            "channel_outlet",
            F.concat(F.lit("ACCT-"), F.col("acct").cast("string")).alias("retail_account"),
            F.concat(F.lit("GEO-"), (F.col("acct") % 4).cast("string")).alias("geography_raw"),
            F.lit("RMA").alias("geography_level"),
            F.lit(self.cfg.subcategory).alias("subcategory"),
            "description", "source_brand", "source_pack_count", "flavor_raw",
            "nfp_protein", "nfp_protein_range", "first_week_selling",
            "units", "base_units", "units_promo", "dollars", "base_dollars", "tdp",
            "stores_selling", "store_count",
            (F.col("units") - F.col("base_units")).alias("incr_units"),
            (F.col("units") - F.col("units_promo")).alias("units_non_promo"),
            safe_div("units_promo", "units").alias("units_pct_promo"),
            "arp",
            safe_div("base_dollars", "units").alias("base_arp"),
            (1 - safe_div("dollars", "base_dollars")).alias("arp_pct_discount_any_promo"),
            "avg_weekly_units_spm",
            safe_div("units", "stores_selling").alias(
                "avg_weekly_units_per_store_selling_per_item"),
            safe_div("stores_selling", "store_count").alias("pct_stores_selling"),
            safe_div(100.0 * F.col("tdp"), F.lit(25.0)).alias("max_acv"),
            safe_div(80.0 * F.col("tdp"), F.lit(25.0)).alias("avg_acv"),
        ).select(
            "*",
            flag(F.col("arp_pct_discount_any_promo") > 0.05).cast("bigint").alias("promo_weeks"),
            (F.col("arp_pct_discount_any_promo") * 2).alias("units_lift_tpr"),
            (F.col("units_pct_promo") / 2).alias("units_lift_any_display"),
            safe_div("incr_units", "units").alias("units_lift_any_feature"),
        )
        return rows.select(*[c for c in rows.columns if c not in twins], *twins)

    @cached_property
    def enriched(self) -> DataFrame:
        from shelfwise.operators.enrich import enrich

        return enrich(self.filtered, self.flavor_map, self.overrides, self.cfg)


def launch_date(bn: int) -> date:
    return FIRST_LAUNCH + timedelta(days=LAUNCH_STEP_DAYS * bn) if bn <= OWN_SKUS else CATEGORY_START
