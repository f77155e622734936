"""Registered queries against their SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# One query per family; `python -m checks.compare <folder>` runs them all.
SAMPLE = [
    "s10_replace_slice", "p16_rounding", "f8_errors_and_trend", "gold_features",
    "j1_null_safe_outer", "j12_four_key_lookup", "j15_asof_orders_bucketed", "a20_mae_by_position",
    "a25_null_counts", "w1_blend_5", "w7_top_two_receivers", "w12_total_with_page",
    "l8_biggest_misses", "u3_bypass_rows", "m2_walk_forward_split", "g10_slate_features",
    "i1_prompt_text", "q10_team_roster", "v7_gold_report",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 73 and df.limit(1).count() == 1
