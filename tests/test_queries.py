"""Registered queries beside their SQL counterparts on the smallest data set.

The default run takes one query per kind of work; SLOPEWATCH_ALL=1 takes all.
"""

import os

import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "top3_alert_list", "win1_latest_per_cell", "agg3_municipality_rollup", "sco14_total_score", "ts1_rain_events", "ts5_ts6_ts7_quality",
    "join19_nearest_in_time", "agg22_average_precision", "agg27_stability_index", "join8_worst_hazard", "join27_dominant_lithology",
    "src3_hourly_samples", "snk9_content_versions", "txt1_briefing_check", "str1_str2_contract", "pip1_monitoring_run",
)
NAMES = sorted(contract.queries()) if os.environ.get("SLOPEWATCH_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    line = check.compare(spark, check.connect(SF), name, contract.queries()[name], contract.oracle_sql().get(name), SF)
    assert not line.startswith("FAIL"), line


def test_every_sql_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
