"""Registered queries against DuckDB on the smallest fixture.

SHELFWISE_ALL=1 runs every query with SQL; the default is one or two per operator group.
"""

import os

import pytest
from oracle_check import TESTDATA, compare, duck

import __spark_entry__ as entry

SF = TESTDATA / "sf0.001"
SOME = """A3_replace_weeks A10_dedup_latest A14_table_diff B2_enrich B6_extract_flavor B16_select_pool
C1_comparison_pool C16_asof_join D1_focal_prepost D2_donor_prepost D9_pack_norms E3_zscores
E13_rolling_elasticity E17_pack_family F2_dominant_channel G2_classify_new G4_ramp_monitor_12w
H1_pair_features_single_channel H7_rate_weekly H11_win_association I2_pack_ladder I4_price_windows
I19_promo_events J2_price_cascade J11_recursive_rule J17_portfolio_constraint J18_tdp_velocity
L3_rolling_cv L3_refit_fits L5_refit_rollforward L11_ks_shift M6_diff_in_diff H16_win_interval
I22_refutation_pvalues J21_segments""".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="fixture tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("SHELFWISE_ALL") else SOME)
def test_matches_sql(spark, con, name):
    _, problem = compare(spark, con, name, entry.queries(), entry.oracle_sql(), SF)
    assert problem == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
