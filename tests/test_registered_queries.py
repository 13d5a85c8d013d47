"""Registered queries against their SQL counterparts on the smallest tables, and plan checks."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
SOME = [
    "x2_net_quantity", "x12_numeric_repair", "r9_unit_price", "e3_dashboard", "e8_violation_buckets", "w7_page",
    "f17_upload_admission", "f31_trusted_urls", "j4_profile_upsert", "s5_upsert_newest_version", "s9_declaration_audit",
    "x14_vocabulary_table", "f9_indexed_wildcard_search", "f10_indexed_history_search", "f13_lookup_in_log",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_is_a_top_k_and_status_is_pushed_down(spark):
    plan = _plan(entry.queries()["w7_page"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "EqualTo(status,FAIL)" in plan


def test_rules_spread_their_rows_once_and_shuffle_nothing_else(spark):
    exchanges = [line for line in _plan(entry.queries()["r22_all_rules"](spark, FOLDER)).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(insp_no" in exchanges[0] and "REPARTITION_BY" in exchanges[0]
