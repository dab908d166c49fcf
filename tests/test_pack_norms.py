"""Joins behind the pack norms: what is broadcast follows from rows in memory, not from the size of files."""

from statistics import median

import pytest

from shelfwise import scale
from shelfwise.operators import price

FILES, STAGES = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def rows(spark):
    seen = [("A" if a % 2 else "B", f"ACCT-{a}", "GEO-0", f"u{u}", p, 1.0 + (a * 7 + u * 3) % 11 / 4 + p / 8, float(u % 4))
            for a in range(6) for u in range(5) for p in (1, 4) if (a, u) != (2, 3)]
    return seen, spark.createDataFrame(
        seen, "channel_outlet string, retail_account string, geography_raw string, competitor_upc string, "
        "competitor_pack_count long, competitor_price_per_unit double, competitor_velocity_spm double")


def test_norms_are_joined_by_measured_sizes(spark, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scale.written(df)

    monkeypatch.setattr(price, "written", written)
    seen, df = rows(spark)
    was = spark.conf.get(FILES), spark.conf.get(STAGES, None)
    got = {tuple(r[:4]): tuple(r[4:7]) for r in price.pack_norms(df).select(
        "norm_scope", "channel_outlet", "retail_account", "pack_count", "norm_sku_count", "norm_median_price",
        "norm_median_velocity").collect()}
    assert (spark.conf.get(FILES), spark.conf.get(STAGES, None)) == was
    # the file of a few products would allow all of these joins to be broadcast
    assert "BroadcastHashJoin" not in plans[-1] and plans[-1].count("SortMergeJoin") >= 6
    want = {}
    for ch, ac, _, upc, pack, p, v in seen:
        for key in (("account", ch, ac, pack), ("channel", ch, "ALL", pack), ("overall", "ALL", "ALL", pack)):
            want.setdefault(key, []).append((upc, p, v))
    assert got == {k: (len({u for u, *_ in x}), pytest.approx(median(p for _, p, _ in x)), pytest.approx(median(v for *_, v in x)))
                   for k, x in want.items()}


def test_limit_of_files_becomes_that_of_stages_and_is_restored(spark):
    was = spark.conf.get(FILES)
    with pytest.raises(RuntimeError), scale.sizes_measured(spark):
        assert (spark.conf.get(FILES), spark.conf.get(STAGES)) == ("-1", was)
        raise RuntimeError
    assert (spark.conf.get(FILES), spark.conf.get(STAGES, None)) == (was, None)
    spark.conf.set(STAGES, "5m")
    try:
        with scale.sizes_measured(spark):
            assert spark.conf.get(STAGES) == "5m"
        assert spark.conf.get(STAGES) == "5m"
    finally:
        spark.conf.unset(STAGES)
