"""How often the way to the distinct launch pairs moves the panel, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import pool, transfer
from shelfwise.scale import keys_in_part
from shelfwise.sources.fixtures import FIXTURE_CONFIG as CFG

MON = dt.date(1999, 3, 1)
PART = "spark.sql.requireAllClusterKeysForCoPartition"


def rows(spark):
    """Three own and two foreign products in three markets, some weeks twice, unknown flavors and markets."""
    goods = [("a", "OWN", "S1", "F1", 1), ("b", "OWN", "S1", "F1", 4), ("c", "OWN", None, "F2", 4),
             ("x", "BRAND0", "S1", "F1", 1), ("y", "BRAND1", None, "F2", None)]
    seen = [(MON + dt.timedelta(days=7 * w), *g, ch, acct, "GEO-0") for w in range(6) for g in goods
            for ch, acct in (("A", "ACCT-0"), ("A", "ACCT-1"), (None, "ACCT-1")) if (w, g[0]) != (3, "b")]
    df = spark.createDataFrame(
        [*seen, seen[0]], "week date, upc string, parent_brand string, specific_flavor_normalized string, flavor string, "
        "pack_count long, channel_outlet string, retail_account string, geography_raw string")
    return df.select(
        "*", F.lit("RMA").alias("geography_level"), F.lit(0).alias("market_excluded_flag"),
        F.col("parent_brand").alias("brand_line"), F.col("parent_brand").alias("source_brand"), F.col("upc").alias("description"),
        F.lit(MON).alias("first_week_selling"), F.lit(2.0).alias("arp"), F.lit(3.0).alias("base_units"),
        *[F.lit(1.0).alias(c) for c in (
            "size_oz", "promo_weeks", "units_pct_promo", "base_arp", "base_units_yago", "units", "incr_units", "tdp",
            "avg_weekly_units_spm", "avg_weekly_units_per_store_selling_per_item", "store_count", "stores_selling",
            "pct_stores_selling", "arp_pct_discount_any_promo", "units_lift_tpr", "units_lift_any_display",
            "units_lift_any_feature")])


@pytest.fixture
def shuffled(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", PART)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_pool_by_market_has_the_same_rows(spark):
    plain, dealt = (pool.comparison_pool(rows(spark), CFG, by_market=m) for m in (False, True))
    with keys_in_part(spark):
        got = sorted(map(repr, dealt.select(plain.columns).collect()))
    assert got == sorted(map(repr, plain.collect())) and len(got) > 100


def test_panel_moves_once_a_side_to_the_launch_pairs(spark, shuffled):
    pairs = pool.launch_pairs(pool.comparison_pool(rows(spark), CFG, by_market=True))
    with keys_in_part(spark):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    # neither the tokens nor a pair's weeks are moved
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 2


def test_donor_history_folds_pairs_where_they_lie(spark, monkeypatch):
    seen = []

    def written(df):
        seen.append((df.sparkSession.conf.get(PART), df.count(), df.distinct().count()))
        return df

    monkeypatch.setattr(transfer, "written", written)
    df, was = rows(spark), spark.conf.get(PART)
    filtered = df.withColumns({"flavor_raw": F.col("flavor"), "source_pack_count": F.col("pack_count")})
    out = transfer.donor_prepost(pool.comparison_pool(df, CFG, by_market=True), filtered, CFG)
    # 12 directed pairs (ab, ac, bc, ax, bx, cy) in each of the two known markets
    assert seen == [("false", 24, 24)] and out.count() == 24
    assert spark.conf.get(PART) == was


def test_setting_is_restored_after_an_error(spark):
    was = spark.conf.get(PART)
    with pytest.raises(RuntimeError), keys_in_part(spark):
        raise RuntimeError
    assert spark.conf.get(PART) == was


def test_pairs_and_histories_are_never_sent_whole(spark):
    """However few bytes their files take: a pair of launches takes a hundredth there."""
    df = rows(spark)
    filtered = df.withColumns({"flavor_raw": F.col("flavor"), "source_pack_count": F.col("pack_count")})
    donors = transfer.donor_prepost(pool.comparison_pool(df, CFG, by_market=True), filtered, CFG)
    pairs = transfer.pair_features(transfer.focal_prepost(df, CFG), donors, min_weeks=0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan
