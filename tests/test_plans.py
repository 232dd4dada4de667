"""What the plans must and must not contain."""

import re

import pytest
from conftest import SF

from pulseline.operators import filters, journeys, paging, rollups, trends
from pulseline.plans.registry import QUERIES
from pulseline.sources import tables, testdata

# These write files before they return a plan.
RUN_AT_CALL = {"activity_table", "csv_export", "csv_export_paths", "json_export", "loaded_verdicts", "loaded_alerts"}
LAZY = sorted(n for n in QUERIES if n not in RUN_AT_CALL and not n.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_gathers_everything(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name != "blocklist":
        assert "EvalPython" not in text and "InPandas" not in text
    # A window over a single partition would show as a sort below a single-partition exchange.
    for window in re.findall(r"Window(?:GroupLimit)? \[.*?\n", text):
        assert "], []\n" not in window


def test_top_per_group_is_limited_before_the_shuffle(spark):
    ua = testdata.activity(spark, SF)
    for df in (trends.top_pages(ua), journeys.journeys(ua)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit.*Partial", text)


def test_pages_use_distributed_top_k(spark):
    ua = testdata.activity(spark, SF)
    text = plan(paging.page(ua, ["timestamp", "id"], 10, 5))
    assert "TakeOrderedAndProject" in text


def test_one_day_reaches_the_event_scan(spark):
    ua = filters.on_day(testdata.activity(spark, SF, 20240115, 20240115), 20240115)
    text = ua._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-14T16:00)" in text
    assert "LessThan(ts,2024-01-15T16:00)" in text


def test_page_html_is_not_read_for_activity(spark):
    assert "html:string" not in plan(testdata.activity(spark, SF))


def test_trailing_window_prunes_days(spark, act, tmp_path):
    path = str(tmp_path / "t")
    tables.write_activity(act(dict()), path)
    ua = tables.read_activity(spark, path)
    text = filters.trailing(ua, 1705248000, 1800)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*date_num#\d+ >= 20240114", text)
    columns = rollups.first_seen(ua)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<hostname:string,user_cookie:string>" in columns


def test_moves_shuffle_the_events_once(spark):
    moves = journeys.page_moves(testdata.activity(spark, SF))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(moves)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_bucket = r"hashpartitioning\(date_num#\d+, user_cookie#\d+, bucket#\d+L"
    made = [line for line in text.splitlines() if re.search(by_bucket, line)]
    assert len([line for line in made if "ReusedExchange" not in line]) == 1
    assert "ReusedExchange" in text


def test_large_top_n_is_salted_and_exact(spark):
    df = spark.range(5000).selectExpr("id", "0 AS g")
    got = paging.top_n(df, 1500, ["id"], per=["g"])
    assert "_salt" in plan(got)
    assert sorted(r.id for r in got.collect()) == list(range(1500))


def test_touched_days_are_broadcast(spark):
    ua = testdata.activity(spark, SF)
    text = plan(rollups.refresh_rollup(ua, 1706000000))
    assert re.search(r"BroadcastHashJoin \[date_num#\d+\], \[date_num#\d+\], LeftSemi", text)
    assert "SortMergeJoin" not in text
