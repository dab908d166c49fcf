"""The weekly panel from hand-made order tables, and how often it moves the order lines."""

import datetime as dt
from decimal import Decimal

import pytest

from shelfwise import scale
from shelfwise.operators.enrich import enrich
from shelfwise.sources.fixtures import Tables

MON = dt.datetime(1999, 3, 1)
WEEK = dt.timedelta(days=7)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("orders")

    def save(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    save("part", "p_partkey long, p_brand string", [(1, "Brand#9"), (2, "Brand#9"), (3, "Brand#8")])
    save("customer", "c_custkey long, c_nationkey int, c_mktsegment string", [
        (1, 5, "A"), (2, 5, "A"), (3, 6, "A"), (4, 6, "B"), (5, 6, None), (1001, 5, "A")])
    save("orders", "o_orderkey long, o_custkey long", [
        (10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 1001), (70, None)])
    line = "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, " \
        "l_discount double, l_shipdate timestamp"
    save("lineitem", line, [
        (10, 1, 3.0, 3000.0, 0.0, MON), (10, 2, 1.0, 1000.0, 0.10, MON + WEEK / 7),
        (20, 1, 2.0, 2000.0, 0.06, MON), (10, 1, 4.0, 4000.0, 0.05, MON + 52 * WEEK),
        (30, 2, 5.0, 5000.0, None, MON + 52 * WEEK), (40, 1, 7.0, 7000.0, 0.0, MON),
        (50, 1, 8.0, 8000.0, 0.0, MON), (60, 1, 9.0, 9000.0, 0.0, MON), (70, 1, 6.0, 6000.0, 0.0, MON),
        # brand 8 is launched in 1998, so this week is cut unless launches are kept whole
        (10, 3, 2.0, 2000.0, 0.0, MON - 104 * WEEK)])
    return str(d)


def rows(t):
    cols = ["week", "upc", "channel_outlet", "retail_account", "units", "base_units", "units_promo", "dollars",
            "base_dollars", "tdp", "stores_selling", "store_count", "units_yago", "arp_yago"]
    return {(r.upc, r.channel_outlet, r.retail_account, r.week): tuple(r[4:])
            for r in t.build_filtered().select(*cols).collect()}


def test_panel_rows(spark, folder):
    got = rows(Tables(spark, folder))
    first, later = MON.date(), (MON + 52 * WEEK).date()
    assert got == {
        ("SKU-09", "A", "ACCT-0", first): (
            6.0, 3.0, 1.0, float(Decimal("5.78")), 6.0, 1.0, 2, 3, None, None),
        ("SKU-09", "A", "ACCT-0", later): (9.0, 4.0, 0.0, 3.8, 9.0, 2.0, 2, 3, 6.0, 5.78 / 6.0),
        ("SKU-09", "B", "ACCT-0", first): (7.0, 7.0, 0.0, 7.0, 7.0, 1.0, 1, 1, None, None),
        ("SKU-09", "A", "ACCT-1", first): (9.0, 9.0, 0.0, 9.0, 9.0, 1.0, 1, 1, None, None),
    }


def test_panel_keeps_weeks_before_launch_on_request(spark, folder):
    got = rows(Tables(spark, folder, trim_launch=False))
    assert ("SKU-08", "A", "ACCT-0", (MON - 104 * WEEK).date()) in got and len(got) == 5


def test_panel_of_one_channel(spark, folder):
    got = rows(Tables(spark, folder, channel="all"))
    assert got["SKU-09", "ALL", "ACCT-0", MON.date()][:1] + got["SKU-09", "ALL", "ACCT-0", MON.date()][5:8] == (
        21.0, 2.0, 4, 5)


@pytest.mark.parametrize("channel", ["segment", "all"])
def test_order_lines_move_once_to_their_account(spark, folder, channel):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = Tables(spark, folder, channel=channel).build_filtered()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    # everything from the fold to the year-ago twins runs on the one exchange by account
    assert plan.split("REPARTITION_BY_NUM")[0].count("Exchange ") == 1
    # lines, parts, lines to orders, orders, customers, buyers, account, the two sides of store counts
    assert plan.count("Exchange ") <= 9


def test_enrichment_leaves_the_panel_where_it_lies(spark, tmp_path):
    """Neither lookup moves the panel by product, however large `part` is."""
    t = Tables(spark, str(tmp_path))
    spark.createDataFrame([(k, f"Brand#{k % 25 + 1}") for k in range(20000)], "p_partkey long, p_brand string").write.parquet(
        f"{tmp_path}/part.parquet")
    panel = [(f"SKU-{k:02d}", "A", "ACCT-0", "OWN CORE", "FL9", 1) for k in (6, 7, 99)]
    spark.createDataFrame(panel, "upc string, channel_outlet string, retail_account string, source_brand string, "
                          "flavor_raw string, source_pack_count long").write.parquet(f"{tmp_path}/panel.parquet")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        # less than `part` counts for, more than its SKUs do
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = enrich(t.read("panel"), t.flavor_map, t.overrides, t.cfg)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan
    assert {r.upc: (r.flavor, r.pack_count) for r in out.collect()} == {
        "SKU-06": ("FL1", 4), "SKU-07": ("FL1", 4), "SKU-99": ("FL9", 1)}


def test_large_lookups_are_not_broadcast_by_the_size_of_their_files(spark, folder, monkeypatch):
    def joins():
        plan = Tables(spark, folder).build_filtered()._jdf.queryExecution().executedPlan().toString()
        return [f"BroadcastHashJoin [{k}" in plan for k in ("l_partkey", "o_custkey")]

    assert joins() == [True, True]
    was = rows(Tables(spark, folder))
    monkeypatch.setattr(scale, "MAX_LOOKUP_ROWS", 2)
    assert joins() == [False, False] and rows(Tables(spark, folder)) == was
