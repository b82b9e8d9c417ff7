"""Every registered report against its DuckDB oracle statement.

sf0.01 with the default plan (small dimensions are broadcast), and sf0.001
with broadcasts disabled, which is the plan a cluster gets for big dimensions.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tally.plans import oracle, reports
from tests.oracle_check import compare, duck

NAMES = sorted(reports.REPORTS)


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(reports.REPORTS)
    assert set(entry.queries()) >= set(reports.REPORTS) and set(entry.queries()) >= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck01():
    return duck("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck001():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck01, name):
    problems, _ = compare(spark, duck01, name, entry.queries()[name], entry.oracle_sql()[name],
                          "/root/testdata/sf0.01")
    assert not problems, problems


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_without_broadcast(no_broadcast, duck001, name):
    problems, _ = compare(no_broadcast, duck001, name, entry.queries()[name], entry.oracle_sql()[name],
                          "/root/testdata/sf0.001")
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["order_month", "sales"] and len(rows) == 12


@pytest.mark.parametrize("name", ["calendar_parts", "parse_day_first", "parse_month_first", "orders_by_weekday",
                                  "orders_by_hour", "orders_by_month_sparse", "first_rows", "kpi_labels"])
def test_session_zone_and_ansi_do_not_matter(spark, duck01, name):
    old_tz, old_ansi = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        problems, _ = compare(spark, duck01, name, entry.queries()[name], entry.oracle_sql()[name],
                              "/root/testdata/sf0.01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.ansi.enabled", old_ansi)
    assert not problems, problems
