from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.functions import aggs, text
from pulseline.functions.timefn import local_date_num, local_hour, shift_day, slot_start, to_day
from pulseline.operators import (
    filters,
    paging,
    periods,
    realtime,
    rollups,
    sessions,
    summary,
    trends,
)

DAY = 20240115


def test_day_changes_at_local_midnight(spark):
    df = spark.createDataFrame([(DAY_START - 1,), (DAY_START,)], "ts bigint")
    got = df.select(local_date_num("ts"), local_hour("ts")).collect()
    assert [tuple(r) for r in got] == [(20240114, 23), (20240115, 0)]


def test_day_arithmetic(spark):
    df = spark.createDataFrame([(20240301,)], "d int")
    row = df.select(shift_day("d", -1), shift_day("d", -7), to_day("d").cast("string")).first()
    assert tuple(row) == (20240229, 20240223, "2024-03-01")
    assert periods.days_needed([20240301]) == [20240223, 20240229, 20240301]


def test_hosts_and_paths(spark):
    urls = [
        ("http://a_b.example.com:8080/x?y=1#z", "a_b.example.com", "/x"),
        ("https://u:p@h.example.com", "h.example.com", "/"),
        ("not a url", "", "/"),
        ("", "", "/"),
    ]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "u string")
    got = df.select(text.host_of("u"), text.path_of("u")).collect()
    assert [tuple(r) for r in got] == [(h, p) for _, h, p in urls]


def test_rounding_is_half_away(spark):
    df = spark.createDataFrame([(0.25,), (-0.25,), (2.5,)], "x double")
    assert [r[0] for r in df.select(aggs.round_at("x", 1)).collect()] == [0.3, -0.3, 2.5]


def test_empty_table_gives_no_rows_or_zeroes(act):
    ua = act().limit(0)
    first = rollups.first_seen(ua)
    for df in (
        summary.summary_by_host(ua, first),
        summary.daily_report_totals(ua, first),
        sessions.session_detail(ua),
        trends.top_pages(ua),
        periods.period_change(rollups.daily_rollup(ua)),
    ):
        assert df.count() == 0
    assert tuple(realtime.window_stats(ua, DAY_START, 30).first()) == (0, 0, 0, 0, 0, 0)


def test_day_with_bots_only_reports_zero(act):
    ua = act(dict(is_bot=1, session_id="b"), dict(timestamp=DAY_START + 86400, is_bot=0))
    first = rollups.first_seen(ua)
    got = rows(
        summary.daily_report_totals(ua, first).filter("day_offset = 0"),
        "report_day", "users", "views", "bot_sessions", "new_users",
    )
    assert got == [(20240115, 0, 0, 0, 0), (20240116, 1, 1, 0, 0)]


def test_missing_days_are_zero_filled(act):
    ua = act(dict())
    got = rows(summary.period_totals(ua, days=[20240116]), "day_offset", "date_num", "users")
    assert got == [(-7, 20240109, 0), (-1, 20240115, 1), (0, 20240116, 0)]


def test_period_change_zero_rules(spark):
    rollup = spark.createDataFrame(
        [(20240114, "h", 0, 4), (20240115, "h", 0, 5), (20240116, "h", 3, 5)],
        "date_num int, hostname string, users bigint, views bigint",
    )
    got = periods.period_change(rollup, metrics=("users", "views"))
    day = {(r.date_num, r.metric): (r.pct_day, r.report_day, r.daily_day) for r in got.collect()}
    assert day[20240115, "users"] == (None, "N/A", "0%")
    assert day[20240116, "users"] == (None, "+100%", "+100%")
    assert day[20240115, "views"] == (25.0, "up", "up")
    assert day[20240116, "views"] == (0.0, "down", "up")


def test_stay_bounds_are_exclusive(act):
    ua = act(
        dict(session_id="zero"),
        dict(session_id="long", timestamp=DAY_START),
        dict(session_id="long", timestamp=DAY_START + 7200),
        dict(session_id="ok", timestamp=DAY_START),
        dict(session_id="ok", timestamp=DAY_START + 7199),
    )
    assert rows(summary.average_stay(ua)) == [(DAY, 7199)]


def test_heartbeats_are_not_views(act):
    ua = act(*[dict(timestamp=DAY_START + 10 * i) for i in range(6)])
    got = rollups.daily_rollup(ua).first()
    assert (got.users, got.views, got.sessions, got.stay_seconds) == (1, 1, 1, 60)
    assert sessions.engagement(ua).first().bounce_rate == 0.0


def test_session_sample_does_not_depend_on_order(act):
    same = [dict(timestamp=DAY_START, referer=r, url=u) for r, u in (("b", "x"), ("a", "y"))]
    for order in (same, same[::-1]):
        got = sessions.session_detail(act(*order).repartition(2)).first()
        assert (got.referer, got.url) == ("a", "y")


def test_ties_are_broken_by_key(act):
    ua = act(*[dict(hostname=h, url=h) for h in "edcba"])
    assert rows(trends.top_pages(ua, n=2), "url") == [("a",), ("b",)]
    assert rows(trends.daily_top_hosts(ua, n=2), "hostname") == [("a",), ("b",)]


def test_peak_hour_takes_the_earliest_on_a_tie(act):
    ua = act(dict(timestamp=DAY_START + 7200), dict(timestamp=DAY_START + 3600))
    assert rows(trends.peak_hour(ua)) == [(DAY, 1, 1)]


def test_pages_cover_all_rows_once(act):
    ua = act(*[dict(session_id=f"s{i:02}", timestamp=DAY_START + i // 3) for i in range(25)])
    whole = rows(sessions.session_detail(ua), "session_id")
    by_offset, by_cursor, cursor = [], [], None
    for i in range(0, 30, 7):
        by_offset += [r.session_id for r in sessions.session_page(ua, DAY, limit=7, offset=i).collect()]
        if cursor is None:
            page = sessions.session_page(ua, DAY, limit=7).collect()
        else:
            page = sessions.session_page_after(ua, DAY, cursor, limit=7).collect()
        by_cursor += [r.session_id for r in page]
        if page:
            cursor = (page[-1].last_ts, page[-1].session_id, page[-1].user_cookie)
    assert by_offset == by_cursor
    assert sorted((s,) for s in by_offset) == whole
    assert sessions.session_page(ua, DAY, limit=7).first().total_count == 25


def test_total_pages(spark):
    df = spark.createDataFrame([(0,), (20,), (21,)], "n bigint")
    assert [r[0] for r in df.select(paging.total_pages(F.col("n"), 20)).collect()] == [0, 1, 2]


def test_filters_take_text_literally(act):
    ua = act(dict(ip_user="10.0.0.1"), dict(ip_user="10_0"), dict(ip_user="1%"))
    assert filters.ip_contains(ua, "_").count() == 1
    assert filters.ip_contains(ua, " ").count() == 3
    assert filters.for_host(ua, " a.example.com ").count() == 3
    assert filters.for_host(ua, "x' OR '1'='1").count() == 0


def test_new_users_per_host_and_overall(act):
    ua = act(
        dict(user_cookie="u1", hostname="a"),
        dict(user_cookie="u1", hostname="b", timestamp=DAY_START + 86400),
        dict(user_cookie="u2", hostname="b", timestamp=DAY_START + 86400),
    )
    first = rollups.first_seen(ua)
    assert rows(summary.new_users(first)) == [(20240115, 1), (20240116, 2)]
    assert rows(summary.new_users_by_host(first)) == [(20240115, "a", 1), (20240116, "b", 2)]
    got = rows(summary.range_by_host(ua, first, 20240116, 20240116), "hostname", "new_users")
    assert got == [("b", 2)]


def test_window_stats(act):
    now = DAY_START + 50000
    ua = act(
        dict(user_cookie="old", timestamp=now - 3000),
        dict(user_cookie="old", timestamp=now - 60, session_id="s2"),
        dict(user_cookie="new", timestamp=now, session_id="s2"),
        dict(user_cookie="bot", timestamp=now, is_bot=1),
        dict(user_cookie="later", timestamp=now + 1),
    )
    got = realtime.window_stats(ua, now, 30).first()
    assert got.asDict() == dict(hits=2, users=2, new_users=1, online=2, peak=1, avg_stay=60)


def test_online_slots_merge_over_refreshes(act):
    ua = act(*[dict(timestamp=DAY_START + 100 * i, user_cookie=f"u{i % 7}") for i in range(60)])
    whole = rows(rollups.online_slots(ua))
    parts = [rollups.slot_keys(ua, DAY_START + t, 2400) for t in (2000, 4000, 6000)]
    merged = parts[0].union(parts[1]).union(parts[2]).distinct()
    assert rows(merged.groupBy("slot_start", "hostname").count()) == whole
    assert ua.select(slot_start("timestamp") % 600).distinct().first()[0] == 0


def test_first_seen_merges(act):
    a = rollups.first_seen(act(dict(timestamp=DAY_START + 86400)))
    b = rollups.first_seen(act(dict(), dict(hostname="b")))
    got = rollups.first_seen_dates(rollups.merge_first_seen(a, b))
    assert rows(got.select("hostname", F.col("first_date").cast("string"))) == [
        ("a.example.com", "2024-01-15"),
        ("b", "2024-01-15"),
    ]


def test_sketches_merge_within_bounds(spark):
    ua = spark.range(40000).selectExpr(
        "id", "20240115 AS date_num", "concat('h', id % 2) AS hostname",
        "concat('s', id % 9966) AS session_id", "concat('p', id % 3) AS url",
        "concat('u', id % 7000) AS user_cookie", "int(id % 10 = 0) AS is_bot",
    )
    exact = rollups.daily_rollup(ua, by=["date_num"]).first()
    states = rollups.rollup_states(ua)
    for merged in (states, rollups.compact_states(states.union(states))):
        got = rollups.merge_states(merged.drop("bot_hits", "stay_seconds"), by=["date_num"]).first()
        for name in ("users", "views", "sessions", "bot_sessions"):
            assert abs(got[name] - exact[name]) <= 0.05 * exact[name]
