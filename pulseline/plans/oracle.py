"""SQL twins of the named queries, for DuckDB on the same tables."""

from pulseline.functions.text import (
    ATTACK_PATTERN,
    BOT_KEYWORDS,
    HOST_PATTERN,
    MOBILE_PATTERN,
    PATH_PATTERN,
    QUERY_PATTERN,
    SENSITIVE_PATTERN,
)
from pulseline.operators import alerts as alert_rules
from pulseline.operators import clusters as cluster_rules
from pulseline.operators import ips as ip_rules
from pulseline.operators import journeys as journey_rules
from pulseline.operators import periods
from pulseline.operators import referers as referer_rules
from pulseline.plans.registry import (
    CLUSTER_LIMITS,
    DAY,
    DISMISSED,
    HOUR,
    MINUTES,
    REFERER_LISTS,
    WEEK,
)
from pulseline.sources.testdata import USER_AGENTS


def _date_num(epoch: str) -> str:
    return f"CAST(strftime(make_timestamp(({epoch} + 28800) * 1000000), '%Y%m%d') AS INTEGER)"


def _day(num: str) -> str:
    return f"CAST(strptime(CAST({num} AS VARCHAR), '%Y%m%d') AS DATE)"


def _num(day: str) -> str:
    return f"CAST(strftime({day}, '%Y%m%d') AS INTEGER)"


def _words(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ")"


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_AGENT = "CASE user_id % 8 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(USER_AGENTS)) + " END"

ACTIVITY = f"""
np AS (SELECT count(*) AS n FROM pages),
ev AS (
  SELECT event_id, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp
  FROM events
),
joined AS (
  SELECT ev.*, coalesce(p.url, '') AS page_url, coalesce(r.url, '') AS from_url
  FROM ev CROSS JOIN np
  LEFT JOIN pages p ON p.page_id = (user_id * 7 + k % 10) % np.n
  LEFT JOIN pages r ON r.page_id = (user_id * 3 + k + 17) % np.n
),
ua AS (
  SELECT event_id AS id,
         's' || user_id || '-' || (timestamp // 14400) AS session_id,
         regexp_extract(page_url, '{HOST_PATTERN}', 1) AS hostname,
         CASE WHEN event_type = 'error' AND k % 5 = 0 THEN page_url || '/wp-admin'
              WHEN event_type = 'error' AND k % 5 = 1 THEN page_url || '?q=UNION%20select'
              ELSE page_url END AS url,
         CASE WHEN event_type = 'signup' THEN ''
              WHEN k = 13 THEN 'not a url'
              WHEN k = 14 THEN 'http://best-casino.example.net/x'
              ELSE from_url END AS referer,
         {_AGENT} AS browser,
         CAST(regexp_matches(lower({_AGENT}), '{"|".join(BOT_KEYWORDS)}') AS INTEGER) AS is_bot,
         CASE WHEN user_id % 8 = 7 THEN '' ELSE 'u' || user_id END AS user_cookie,
         CASE WHEN user_id % 5 = 1 THEN '203.0.113.9'
              WHEN user_id % 7 = 0 THEN '2001:db8:0:' || (user_id % 4) || '::' || (user_id // 14)
              ELSE '10.' || (user_id // 187500 % 250) || '.' || (user_id // 750 % 250) || '.' || (user_id // 3 % 250)
         END AS ip_user,
         timestamp,
         {_date_num("timestamp")} AS date_num,
         regexp_replace(regexp_extract(page_url, '{HOST_PATTERN}', 1), '^(www|m|blog)\\.', '') AS domain,
         timestamp AS created_at
  FROM joined
),
latest AS (SELECT max(timestamp) AS as_of FROM ua)
"""

ORACLE: dict[str, str] = {}


def twin(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = "WITH " + ",\n".join([ACTIVITY.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


VIEWS = "count(DISTINCT (session_id, url))"
USERS = "count(DISTINCT user_cookie) FILTER (WHERE is_bot = 0)"
BOTS = "count(DISTINCT session_id) FILTER (WHERE is_bot = 1)"


def _first(*cols: str) -> str:
    """Struct of the columns on the earliest event; equal seconds ordered by the columns."""
    return "min({'t': timestamp, " + ", ".join(f"'{c}': {c}" for c in cols) + "})"


def _last(*cols: str) -> str:
    return _first(*cols).replace("min(", "max(", 1)


FIRST = "first AS (SELECT user_cookie, hostname, min(date_num) AS first_date_num FROM ua GROUP BY ALL)"
NEW = """new AS (SELECT first_date_num AS date_num, count(DISTINCT user_cookie) AS new_users
FROM first GROUP BY ALL)"""
NEW_HOST = """newh AS (SELECT first_date_num AS date_num, hostname, count(*) AS new_users
FROM first GROUP BY ALL)"""
TOTALS = f"""totals AS (SELECT date_num, {USERS} AS users, {VIEWS} AS views, {BOTS} AS bot_sessions
FROM ua GROUP BY ALL)"""

# Sources, ingest, sinks

twin("activity", "SELECT * FROM ua")
twin("activity_table", "SELECT * FROM ua")
twin("stream_activity", "SELECT * FROM ua")
twin("row_count", "SELECT count(*) AS rows FROM ua")

def _normal(is_bot: str) -> str:
    return f"""
SELECT id,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE session_id END AS session_id,
  CASE id % 50 WHEN 2 THEN '' WHEN 3 THEN 'h' ELSE hostname END AS hostname,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE url END AS url,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE referer END AS referer,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE browser END AS browser,
  CAST(CASE id % 50 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE {is_bot} END AS INTEGER) AS is_bot,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE user_cookie END AS user_cookie,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE ip_user END AS ip_user,
  CASE WHEN id % 50 IN (2, 3) THEN 0 ELSE timestamp END AS timestamp,
  CAST(CASE WHEN id % 50 IN (2, 3) THEN 0 ELSE date_num END AS INTEGER) AS date_num,
  CASE WHEN id % 50 IN (2, 3) THEN '' ELSE domain END AS domain,
  CASE WHEN id % 50 IN (2, 3) THEN 0 ELSE created_at END AS created_at
FROM ua WHERE id % 50 NOT IN (0, 1, 4, 5)
"""


# Senders leave the flag out for every fiftieth event; the stream sets it by user agent.
twin("normalized_events", _normal("CASE WHEN id % 50 = 6 THEN 0 ELSE is_bot END"))
twin("stream_messages", _normal("is_bot"))
twin(
    "refused_messages",
    """
SELECT CASE id % 50 WHEN 0 THEN '{"id": ' || id || ', "url": "' WHEN 1 THEN '{"id": "x' || id || '"}'
         WHEN 4 THEN '{"id": ' || id || ', "url": "u"} junk' ELSE '{"id": "' || id || '.9"}' END AS value,
       CASE WHEN id % 50 IN (0, 4) THEN 'malformed json' ELSE 'bad number' END AS reason
FROM ua WHERE id % 50 IN (0, 1, 4, 5)
""",
)
twin(
    "stream_heartbeats",
    """SELECT timestamp * 1000 AS id, session_id, hostname, url, referer, browser, is_bot, user_cookie, ip_user,
  timestamp, date_num, domain, timestamp AS created_at FROM ua""",
)
twin("stream_settled_activity", "SELECT * FROM ua")
twin("enriched_time", "SELECT timestamp * 1000 AS id, timestamp, date_num, created_at FROM ua")
twin("client_ip", "SELECT id, CASE id % 4 WHEN 0 THEN ip_user WHEN 1 THEN '192.0.2.1' WHEN 2 THEN ip_user ELSE '127.0.0.1' END AS ip_user FROM ua")
twin("bot_flags", "SELECT browser, is_bot, count(*) AS hits FROM ua GROUP BY ALL")
twin(
    "legacy_events",
    """
SELECT id, ip_user, browser, referer, id % 300 AS stay_duration, hostname, url, user_cookie,
  CASE WHEN id % 10 <> 0 THEN timestamp ELSE 1704067200 END AS timestamp, is_bot, date_num,
  timestamp AS timestamp_int, id % 7 AS domain_id, CAST(0 AS BIGINT) AS label_id,
  CAST(0 AS INTEGER) AS is_updated_label, domain,
  CASE WHEN id % 10 <> 0 THEN created_at ELSE 1704067200 END AS created_at
FROM ua
""",
)

# Maintained tables

SLOTS = """slots AS (SELECT DISTINCT timestamp // 600 * 600 AS slot_start, hostname, user_cookie
FROM ua WHERE is_bot = 0)"""
_ONLINE = "SELECT slot_start, hostname, count(*) AS active_users FROM slots GROUP BY ALL"
twin("online_slots", _ONLINE, SLOTS)
twin("stream_online_slots", _ONLINE, SLOTS)
twin(
    "stream_closed_slots",
    # The watermark follows the rows it is applied to, which are the human ones.
    """SELECT slot_start, hostname, count(*) AS active_users FROM slots
WHERE slot_start + 600 <= (SELECT max(timestamp) FROM ua WHERE is_bot = 0) - 2400 GROUP BY ALL""",
    SLOTS,
)
twin(
    "online_slots_refresh",
    f"""
SELECT timestamp // 600 * 600 AS slot_start, hostname, count(DISTINCT user_cookie) AS active_users
FROM ua, latest WHERE is_bot = 0 AND timestamp >= as_of - {MINUTES * 60} GROUP BY ALL
""",
)
_ROLLUP = f"""
SELECT date_num, hostname, {USERS} AS users, {VIEWS} AS views, count(DISTINCT session_id) AS sessions,
  {BOTS} AS bot_sessions, CAST(sum(is_bot) AS BIGINT) AS bot_hits,
  CAST(sum(CASE WHEN is_bot = 0 THEN 10 ELSE 0 END) AS BIGINT) AS stay_seconds
FROM ua"""
twin("daily_rollup", f"{_ROLLUP} GROUP BY ALL")
twin("stream_daily_rollup", f"{_ROLLUP} GROUP BY ALL")
twin("stream_rollup_compacted", f"{_ROLLUP} GROUP BY ALL")
_TOUCHED = "touched AS (SELECT DISTINCT date_num FROM ua, latest WHERE timestamp >= as_of - 172800)"
twin("touched_dates", "SELECT date_num FROM touched", _TOUCHED)
twin("refresh_rollup", f"{_ROLLUP} WHERE date_num IN (SELECT date_num FROM touched) GROUP BY ALL", _TOUCHED)
twin("first_seen", "SELECT * FROM first", FIRST)
twin("stream_first_seen", "SELECT * FROM first", FIRST)
twin("stream_first_seen_upsert", "SELECT * FROM first", FIRST)
twin(
    "stream_first_seen_compacted",
    "SELECT * FROM first WHERE first_date_num BETWEEN 20240108 AND 20240114",
    FIRST,
)
twin(
    "daily_rollup_sketch_error",
    """
SELECT date_num, CAST(sum(is_bot) AS BIGINT) AS bot_hits,
  CAST(sum(CASE WHEN is_bot = 0 THEN 10 ELSE 0 END) AS BIGINT) AS stay_seconds,
  CAST(1 AS INTEGER) AS users_close, CAST(1 AS INTEGER) AS views_close,
  CAST(1 AS INTEGER) AS sessions_close, CAST(1 AS INTEGER) AS bot_sessions_close
FROM ua GROUP BY ALL
""",
)

# Filters

BUSIEST = "(SELECT hostname FROM ua GROUP BY hostname ORDER BY count(*) DESC, hostname LIMIT 1)"

def _hits(name: str, where: str, by: str) -> None:
    twin(name, f"SELECT {by}, count(*) AS hits FROM ua, latest WHERE {where} GROUP BY ALL")


_NEEDED = ", ".join(str(d) for d in periods.days_needed([DAY]))
_hits("day_filter", f"date_num = {DAY}", "date_num, hostname")
_hits("day_list_filter", f"date_num IN ({_NEEDED})", "date_num, hostname")
_hits("day_range_filter", f"date_num BETWEEN {WEEK[0]} AND {WEEK[1]}", "date_num, hostname")
_hits("host_filter", f"hostname = {BUSIEST}", "date_num, hostname")
_hits("ip_search", "contains(ip_user, '10.0.0.1')", "ip_user")
ORACLE["ip_search_index"] = ORACLE["ip_search"]
_hits("time_range_filter", "timestamp >= as_of - 345600 AND timestamp < as_of - 86400", "date_num, hostname")
_LOCAL_HOUR = "CAST((timestamp + 28800) // 3600 % 24 AS INTEGER)"
_hits("hour_cutoff", f"{_LOCAL_HOUR} <= {HOUR}", "date_num")
_hits("human_page_hits", "is_bot = 0 AND url <> ''", "date_num, url")
_hits("direct_hits", "coalesce(referer, '') = ''", "date_num, hostname")
_hits("sensitive_hits", f"regexp_matches(url, '{SENSITIVE_PATTERN}')", "date_num, url")
_hits("attack_hits", f"regexp_matches(url, '{ATTACK_PATTERN}')", "date_num, url")

# Daily and weekly reports

twin(
    "summary_grand_total",
    "SELECT t.*, coalesce(new_users, 0) AS new_users FROM totals t LEFT JOIN new USING (date_num)",
    TOTALS,
    FIRST,
    NEW,
)
BY_HOST = f"""byhost AS (
SELECT b.date_num, b.hostname, users, views, bot_sessions, coalesce(new_users, 0) AS new_users,
  CAST(round(stay / sessions) AS BIGINT) AS avg_stay
FROM (SELECT date_num, hostname, {USERS} AS users, {VIEWS} AS views, {BOTS} AS bot_sessions,
        sum(CASE WHEN is_bot = 0 THEN 10 ELSE 0 END) AS stay, count(DISTINCT session_id) AS sessions
      FROM ua GROUP BY ALL) b LEFT JOIN newh USING (date_num, hostname))"""
twin("summary_by_host", "SELECT * FROM byhost", FIRST, NEW_HOST, BY_HOST)
twin("stream_summary_by_host", "SELECT * FROM byhost", FIRST, NEW_HOST, BY_HOST)
twin(
    "summary_page",
    f"""SELECT *, (SELECT count(*) FROM byhost WHERE date_num = {DAY}) AS total_rows,
  CAST(ceil((SELECT count(*) FROM byhost WHERE date_num = {DAY}) / 10.0) AS BIGINT) AS total_pages FROM byhost
WHERE date_num = {DAY} ORDER BY users DESC, hostname LIMIT 10 OFFSET 10""",
    FIRST,
    NEW_HOST,
    BY_HOST,
)


def _sessions(where: str = "true") -> str:
    return f"""detail AS (SELECT session_id, user_cookie, date_num,
  l.hostname AS hostname, l.url AS url, f.referer AS referer, f.browser AS browser, f.is_bot AS is_bot,
  f.ip_user AS ip_user, f.domain AS domain, first_ts, last_ts, last_ts - first_ts AS stay_duration
FROM (SELECT session_id, user_cookie, date_num, {_last("hostname", "url")} AS l,
    {_first("referer", "browser", "is_bot", "ip_user", "domain")} AS f,
    min(timestamp) AS first_ts, max(timestamp) AS last_ts
  FROM ua WHERE {where} GROUP BY ALL))"""


_NEWEST = "ORDER BY last_ts DESC, session_id DESC, user_cookie DESC"
twin("session_detail", "SELECT * FROM detail", _sessions())
twin(
    "session_page",
    f"SELECT *, (SELECT count(*) FROM detail) AS total_count, CAST(ceil((SELECT count(*) FROM detail) / 50.0) AS BIGINT) AS total_pages FROM detail {_NEWEST} LIMIT 50 OFFSET 20",
    _sessions(f"date_num = {DAY} AND contains(ip_user, '10.0')"),
)
twin(
    "session_page_deep",
    f"""SELECT *, (SELECT count(*) FROM detail) AS total_count FROM detail {_NEWEST}, date_num DESC
LIMIT 50 OFFSET (SELECT count(*) // 2 FROM detail)""",
    _sessions(),
)
twin(
    "session_page_after",
    f"""SELECT * FROM detail WHERE last_ts < 1705330000
OR (last_ts = 1705330000 AND session_id < 's') {_NEWEST} LIMIT 50""",
    _sessions(f"date_num = {DAY}"),
)
ONLINE = f"""online AS (SELECT hostname, count(DISTINCT user_cookie) AS active_users
FROM slots, latest WHERE slot_start >= as_of - {MINUTES * 60} AND slot_start <= as_of GROUP BY ALL)"""
twin("online_by_host", "SELECT * FROM online", SLOTS, ONLINE)
twin(
    "online_page",
    "SELECT *, (SELECT count(*) FROM online) AS total_rows, CAST(ceil((SELECT count(*) FROM online) / 20.0) AS BIGINT) AS total_pages FROM online ORDER BY active_users DESC, hostname LIMIT 20",
    SLOTS,
    ONLINE,
)


def _spine(days: str) -> str:
    return f"""spine AS (SELECT report_day, CAST(o AS INTEGER) AS day_offset,
  {_num(f"{_day('report_day')} + CAST(o AS INTEGER)")} AS date_num
FROM ({days}) d, (VALUES (0), (-1), (-7)) v(o))"""


_ALL_DAYS = "SELECT DISTINCT date_num AS report_day FROM ua"


def _compare(name: str, metrics, source: str, *ctes: str, days: str = _ALL_DAYS, where: str = "true") -> None:
    cells = ", ".join(f"coalesce(t.{m}, 0) AS {m}" for m in metrics)
    twin(
        name,
        f"""SELECT report_day, day_offset, date_num, {cells}
FROM spine LEFT JOIN {source} t USING (date_num) WHERE {where}""",
        *ctes,
        _spine(days),
    )


_METRICS = ["users", "views", "bot_sessions"]
_compare("period_totals", _METRICS, "totals", TOTALS)
_compare(
    "period_totals_one_day",
    _METRICS,
    "totals",
    TOTALS.replace("FROM ua", f"FROM ua WHERE hostname = {BUSIEST}"),
    days="SELECT CAST(20240104 AS INTEGER) AS report_day",
)
_compare(
    "period_totals_same_hour",
    ["users", "hits", "views", "bot_sessions"],
    "partial",
    f"""partial AS (SELECT date_num, count(DISTINCT user_cookie) AS users, count(*) AS hits, {VIEWS} AS views,
  {BOTS} AS bot_sessions FROM ua WHERE {_LOCAL_HOUR} <= {HOUR} GROUP BY ALL)""",
    days=f"SELECT DISTINCT date_num AS report_day FROM ua WHERE {_LOCAL_HOUR} <= {HOUR}",
    where="day_offset < 0",
)


def _change(name: str, by: str) -> None:
    keys = f"date_num{by}"
    cells = []
    for span in ("day", "week"):
        prev = f"prev_{span}"
        cells.append(
            f"""CASE WHEN {prev} <> 0 THEN round(CAST(100 * (value - {prev}) / {prev} AS DOUBLE) * 10) / 10 + 0.0 END AS pct_{span},
CASE WHEN {prev} = 0 AND value > 0 THEN '+100%' WHEN {prev} = 0 THEN 'N/A'
  WHEN value > {prev} THEN 'up' ELSE 'down' END AS report_{span},
CASE WHEN {prev} = 0 AND value > 0 THEN '+100%' WHEN {prev} = 0 THEN '0%'
  WHEN value >= {prev} THEN 'up' ELSE 'down' END AS daily_{span}"""
        )
    join = "b.day = a.day - {n} AND b.metric = a.metric" + (" AND b.hostname = a.hostname" if by else "")
    twin(
        name,
        f"SELECT {keys}, metric, value, prev_day, prev_week, {', '.join(cells)} FROM pairs",
        f"""base AS (SELECT {keys}, {USERS} AS users, {VIEWS} AS views, {BOTS} AS bot_sessions
FROM ua GROUP BY ALL)""",
        f"""long AS (SELECT *, {_day("date_num")} AS day FROM (
  SELECT {keys}, 'users' AS metric, users AS value FROM base
  UNION ALL SELECT {keys}, 'views', views FROM base
  UNION ALL SELECT {keys}, 'bot_sessions', bot_sessions FROM base))""",
        f"""pairs AS (SELECT a.*, coalesce(b.value, 0) AS prev_day, coalesce(c.value, 0) AS prev_week
FROM long a LEFT JOIN long b ON {join.format(n=1)}
LEFT JOIN long c ON {join.format(n=7).replace("b.", "c.")})""",
    )


_change("period_change", ", hostname")
_change("period_change_total", "")


def _top(name: str, n: int, metric: str, key: str, source: str, columns: str) -> None:
    twin(
        name,
        f"""SELECT date_num, {columns} FROM rows
QUALIFY row_number() OVER (PARTITION BY date_num ORDER BY {metric} DESC, {key}) <= {n}""",
        f"rows AS ({source})",
    )


_top(
    "top_hosts", 5, "users", "hostname",
    f"SELECT date_num, hostname, {USERS} AS users, {VIEWS} AS views, {BOTS} AS bot_sessions FROM ua GROUP BY ALL",
    "hostname, users, views, bot_sessions",
)
_top(
    "top_sources_domain", 3, "sessions", "source",
    f"""SELECT date_num, CASE WHEN referer = '' THEN 'Direct / Bookmark'
  ELSE regexp_extract(referer, '{HOST_PATTERN}', 1) END AS source, count(DISTINCT session_id) AS sessions
FROM ua GROUP BY ALL""",
    "source, sessions",
)
_top("top_pages", 3, "hits", "url", "SELECT date_num, url, count(*) AS hits FROM ua GROUP BY ALL", "url, hits")
_top("top_ips", 10, "hits", "ip_user", "SELECT date_num, ip_user, count(*) AS hits FROM ua GROUP BY ALL", "ip_user, hits")
_top(
    "daily_top_sources_raw", 3, "sessions", "source",
    """SELECT date_num, CASE WHEN coalesce(referer, '') = '' THEN 'Direct / Bookmark' ELSE referer END AS source,
  count(DISTINCT session_id) AS sessions FROM ua WHERE is_bot = 0 GROUP BY ALL""",
    "source, sessions",
)
_top(
    "daily_top_pages", 3, "hits", "url",
    "SELECT date_num, url, count(*) AS hits FROM ua WHERE is_bot = 0 AND url <> '' GROUP BY ALL",
    "url, hits",
)
_top(
    "daily_top_hosts", 5, "users", "hostname",
    f"SELECT date_num, hostname, {USERS} AS users FROM ua GROUP BY ALL",
    "hostname, users",
)
HOURLY = f"""hourly AS (SELECT date_num, {_LOCAL_HOUR} AS hour, count(DISTINCT user_cookie) AS users
FROM ua GROUP BY ALL)"""
twin("hourly_trend", "SELECT * FROM hourly", HOURLY)
twin(
    "peak_hour",
    "SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY date_num ORDER BY users DESC, hour) = 1",
    HOURLY,
)
_DEVICE = f"CASE WHEN regexp_matches(browser, '{MOBILE_PATTERN}') THEN 'Mobile' ELSE 'Desktop' END AS device"
twin("device_breakdown", f"SELECT date_num, {_DEVICE}, count(DISTINCT session_id) AS visitors FROM ua GROUP BY ALL")


def _stays(where: str = "true") -> str:
    return f"""stays AS (SELECT date_num, session_id, max(timestamp) - min(timestamp) AS stay, count(*) AS hits
FROM ua WHERE {where} GROUP BY ALL)"""


_BOUNCE = "round(100 * CAST(count(*) FILTER (WHERE hits = 1) AS DOUBLE) / count(*) * 10) / 10 AS bounce_rate"
twin(
    "engagement",
    f"SELECT date_num, round(avg(stay) * 10) / 10 AS avg_duration, {_BOUNCE} FROM stays GROUP BY ALL",
    _stays(),
)
twin("daily_bounce", f"SELECT date_num, {_BOUNCE} FROM stays GROUP BY ALL", _stays("is_bot = 0"))
twin(
    "traffic_label",
    "SELECT *, CASE WHEN users > 5 THEN 'Excellent' ELSE 'Low' END AS label FROM base",
    f"base AS (SELECT date_num, hostname, {USERS} AS users FROM ua GROUP BY ALL)",
)
_compare(
    "daily_report_totals",
    _METRICS + ["new_users", "avg_stay"],
    "counted",
    TOTALS,
    FIRST,
    NEW,
    _stays("is_bot = 0"),
    """avgs AS (SELECT date_num, CAST(floor(avg(stay)) AS BIGINT) AS avg_stay FROM stays
WHERE stay > 0 AND stay < 7200 GROUP BY ALL)""",
    """counted AS (SELECT * FROM totals LEFT JOIN new USING (date_num) LEFT JOIN avgs USING (date_num)
WHERE users > 0)""",
)
_WEEK = _num(f"date_trunc('week', {_day('{c}')})")


def _period(week: str, first_week: str, where: str, first_where: str) -> list[str]:
    return [
        FIRST,
        f"act AS (SELECT *, {week} AS week FROM ua WHERE {where})",
        f"came AS (SELECT DISTINCT {first_week} AS week, user_cookie FROM first WHERE {first_where})",
        """nh AS (SELECT week, hostname, count(DISTINCT user_cookie) AS new_users FROM act
SEMI JOIN came USING (week, user_cookie) GROUP BY ALL)""",
        "nt AS (SELECT week, count(*) AS new_users FROM came GROUP BY ALL)",
        f"""hosts AS (SELECT a.*, coalesce(new_users, 0) AS new_users FROM (
  SELECT week, hostname, {USERS} AS users, {VIEWS} AS views FROM act GROUP BY ALL) a
LEFT JOIN nh USING (week, hostname))""",
        f"""total AS (SELECT a.*, coalesce(new_users, 0) AS new_users FROM (
  SELECT week, {USERS} AS users, {VIEWS} AS views FROM act GROUP BY ALL) a LEFT JOIN nt USING (week))""",
    ]


_WEEKLY = _period(_WEEK.format(c="date_num"), _WEEK.format(c="first_date_num"), "true", "true")
_RANGE = _period(
    "1", "1", f"date_num BETWEEN {WEEK[0]} AND {WEEK[1]}", f"first_date_num BETWEEN {WEEK[0]} AND {WEEK[1]}"
)
twin("weekly_by_host", "SELECT * FROM hosts", *_WEEKLY)
twin("weekly_grand_total", "SELECT * FROM total", *_WEEKLY)
twin(
    "range_by_host",
    "SELECT hostname, users, views, new_users FROM hosts ORDER BY users DESC, hostname LIMIT 5000",
    *_RANGE,
)
twin("range_grand_total", "SELECT users, views, new_users FROM total", *_RANGE)
_SPAN = MINUTES * 60
_NOW = f"now AS (SELECT ua.* FROM ua, latest WHERE is_bot = 0 AND timestamp >= as_of - {_SPAN})"
twin(
    "window_stats",
    """
SELECT (SELECT count(*) FROM now) AS hits,
  (SELECT count(DISTINCT user_cookie) FROM now) AS users,
  (SELECT count(DISTINCT user_cookie) FROM now WHERE user_cookie NOT IN (SELECT user_cookie FROM before)) AS new_users,
  (SELECT count(DISTINCT user_cookie) FROM ua, latest WHERE is_bot = 0 AND timestamp >= as_of - 120) AS online,
  (SELECT max(u) FROM (SELECT timestamp // 60, count(DISTINCT user_cookie) AS u FROM now GROUP BY 1)) AS peak,
  (SELECT CAST(floor(coalesce(avg(stay), 0)) AS BIGINT) FROM (
     SELECT session_id, max(timestamp) - min(timestamp) AS stay FROM now GROUP BY ALL)
   WHERE stay > 0 AND stay < 7200) AS avg_stay
""",
    _NOW,
    f"""before AS (SELECT ua.* FROM ua, latest WHERE is_bot = 0 AND timestamp >= as_of - {2 * _SPAN}
AND timestamp < as_of - {_SPAN})""",
)
twin("window_devices", f"SELECT {_DEVICE}, count(DISTINCT user_cookie) AS visitors FROM now GROUP BY ALL", _NOW)
twin(
    "realtime_by_host",
    """SELECT hostname, count(DISTINCT user_cookie) AS active_users, count(*) AS hits FROM now
GROUP BY ALL ORDER BY active_users DESC, hostname LIMIT 100""",
    _NOW,
)
twin("realtime_total", "SELECT count(DISTINCT user_cookie) AS active_users FROM now", _NOW)
_SUMMARY = """
SELECT date_num, hostname, users, sessions, avg_stay, coalesce(new_users, 0) AS new_users
FROM (SELECT date_num, hostname, count(DISTINCT user_cookie) AS users, count(session_id) AS sessions,
        round(avg(last_ts - first_ts) * 10000) / 10000 AS avg_stay FROM s GROUP BY ALL) b
LEFT JOIN (SELECT s.date_num, s.hostname,
    count(DISTINCT CASE WHEN s.first_ts = f.seen THEN s.user_cookie END) AS new_users
  FROM s LEFT JOIN f USING (user_cookie, hostname) GROUP BY ALL) n USING (date_num, hostname)
"""
_SESSION_CTES = [
    f"""s AS (SELECT *, {_date_num("first_ts")} AS date_num FROM (
  SELECT session_id, user_cookie, hostname, min(timestamp) AS first_ts, max(timestamp) AS last_ts
  FROM ua GROUP BY ALL))""",
    "f AS (SELECT user_cookie, hostname, min(first_ts) AS seen FROM s GROUP BY ALL)",
]
twin("session_summary_by_host", _SUMMARY, *_SESSION_CTES)
twin("json_export", _SUMMARY, *_SESSION_CTES)

# Threats and alerts


def _profile(per: str, source: str = "ua") -> str:
    return f"""profile AS (SELECT *, CAST(attack_hits * {ip_rules.ATTACK_WEIGHT} + sensitive_hits * {ip_rules.SENSITIVE_WEIGHT}
  + CASE WHEN rps > {ip_rules.FAST_RPS} THEN rps * {ip_rules.RPS_WEIGHT} ELSE 0 END + total_requests AS DOUBLE) AS score
FROM (SELECT *, round(total_requests / CAST(greatest(duration_sec, 1) AS DOUBLE) * 100) / 100 AS rps FROM (
  SELECT {per}, ip_user, count(DISTINCT user_cookie) AS distinct_cookies,
    CAST(max(user_cookie <> '') AS INTEGER) AS has_cookie, {_first("browser")}.browser AS user_agent,
    count(*) AS total_requests, count(DISTINCT hostname) AS distinct_hostnames, count(DISTINCT url) AS distinct_urls,
    count(*) FILTER (WHERE regexp_matches(url, '{SENSITIVE_PATTERN}')) AS sensitive_hits,
    count(*) FILTER (WHERE regexp_matches(url, '{ATTACK_PATTERN}')) AS attack_hits,
    {_last("referer")}.referer AS sample_referer, CAST(sum(is_bot) AS BIGINT) AS bot_flags,
    max(timestamp) - min(timestamp) AS duration_sec
  FROM {source} GROUP BY ALL)))"""


def _threats(per: str) -> list[str]:
    tools = _words("user_agent", ip_rules.TOOL_WORDS)
    limits = ip_rules.IpThresholds()
    rules = [
        ("Critical", "Web Attack", "attack_hits > 0", "attack_hits", "Block IP immediately"),
        ("Critical", "Dirty Referer", _words("sample_referer", ip_rules.DIRTY_REFERER_WORDS), "sample_referer", "Block IP and Referer domain"),
        ("Critical", "Sensitive Scan", f"sensitive_hits > {limits.sensitive}", "sensitive_hits", "Block IP immediately"),
        ("Critical", "Multi-host Scan", f"distinct_hostnames > {limits.hosts}", "distinct_hostnames", "Block IP immediately"),
        ("Suspicious", "Cookie Abuse", f"distinct_cookies > {limits.cookies}", "distinct_cookies", "Rate limit"),
        ("Suspicious", "Automation Tool", tools, "user_agent", "Rate limit"),
        ("Suspicious", "Request Burst", f"total_requests > {limits.burst_requests} AND duration_sec < {limits.burst_seconds}", "total_requests", "Rate limit"),
        ("Suspicious", "High Rate", f"rps > {limits.rps}", "rps", "Rate limit"),
        ("Suspicious", "Spoofed Browser", f"{_words('user_agent', ip_rules.BROWSER_WORDS)} AND NOT {tools} AND (has_cookie = 0 OR sample_referer = '') AND rps > {limits.spoof_rps}", "rps", "Monitor"),
        ("Suspicious", "Quiet Probing", f"total_requests < {limits.quiet_requests} AND sensitive_hits > 0", "sensitive_hits", "Monitor"),
        ("Suspicious", "Shared Agent", f"agent_ips >= {limits.shared_agent_ips}", "agent_ips", "Monitor"),
    ]
    whens = " ".join(
        f"""WHEN {cond} THEN {{'verdict': '{verdict}', 'threat_type': '{threat}',
'reason': '{metric}=' || CAST({metric} AS VARCHAR), 'solution': '{solution}'}}"""
        for verdict, threat, cond, metric, solution in rules
    )
    return [
        f"shared AS (SELECT *, count(*) OVER (PARTITION BY {per}, user_agent) AS agent_ips FROM profile)",
        f"judged AS (SELECT *, CASE {whens} END AS hit FROM shared)",
        f"""threats AS (SELECT {per}, ip_user AS ip,
  CAST(CASE WHEN hit.verdict = 'Critical' THEN least(100, 90 + floor(score / 100))
       ELSE least(89, 60 + floor(score / 100)) END AS INTEGER) AS score,
  hit.verdict AS verdict, hit.threat_type AS threat_type, hit.reason AS reason, hit.solution AS solution
FROM judged WHERE hit IS NOT NULL)""",
    ]


_RANKED = [
    f"""today AS (SELECT as_of, {_date_num("as_of")} AS d, {_date_num("as_of - 86400")} AS y FROM latest)""",
    f"""ranked AS (SELECT ua.*, CAST(CASE WHEN date_num = d AND timestamp >= as_of - {ip_rules.RECENT_SECONDS} THEN 1
  WHEN date_num = d THEN 2 ELSE 3 END AS INTEGER) AS window_rank
FROM ua, today WHERE date_num IN (d, y))""",
    "recent AS (SELECT * FROM ranked WHERE window_rank = (SELECT min(window_rank) FROM ranked))",
    _profile("window_rank", "recent"),
]
PROFILE = _profile("date_num")
THREATS = [PROFILE, *_threats("date_num")]
_RISKIEST = "QUALIFY row_number() OVER (PARTITION BY date_num ORDER BY score DESC, ip_user) <= {n}"

twin("ip_profile", "SELECT * FROM profile", PROFILE)
twin("ip_profile_top", "SELECT * FROM profile " + _RISKIEST.format(n=100), PROFILE)
twin("ip_profile_recent", "SELECT * FROM profile ORDER BY score DESC, ip_user LIMIT 300", *_RANKED)
twin("ip_threats", "SELECT * FROM threats", *THREATS)
_CLIPPED = "CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '{s}' ELSE {c} END AS {c}"
twin(
    "csv_export",
    f"""SELECT date_num, ip_user, total_requests, {_CLIPPED.format(c="user_agent", n=50, s="..")},
{_CLIPPED.format(c="sample_referer", n=50, s="..")}, rps FROM (SELECT * FROM profile {_RISKIEST.format(n=300)})""",
    PROFILE,
)

_JOURNEYS = """
SELECT date_num, user_cookie, ip, ua_short, steps, duration,
  CASE WHEN length(path) > 500 THEN left(path, 500) || '...' ELSE path END AS path
FROM (
  SELECT date_num, user_cookie, {first}.ip_user AS ip, left({first}.browser, 50) AS ua_short,
    count(*) AS steps, max(timestamp) - min(timestamp) AS duration,
    string_agg(url, ' -> ' ORDER BY timestamp, id) AS path
  FROM ua WHERE {where} GROUP BY ALL HAVING count(*) >= 2)
QUALIFY row_number() OVER (PARTITION BY date_num ORDER BY duration, user_cookie) <= 100
"""
twin("journeys_all_days", _JOURNEYS.format(first=_first("ip_user", "browser", "url"), where="true"))
twin("csv_export_paths", _JOURNEYS.format(first=_first("ip_user", "browser", "url"), where="true"))
twin("journeys_one_day", _JOURNEYS.format(first=_first("ip_user", "browser", "url"), where=f"date_num = {DAY}"))
_MOVES = """moves AS (SELECT date_num, user_cookie, from_url, url AS to_url, count(*) AS moves FROM (
  SELECT *, lag(url) OVER (PARTITION BY date_num, user_cookie ORDER BY timestamp, id) AS from_url FROM ua)
WHERE from_url IS NOT NULL AND from_url <> url GROUP BY ALL)"""
twin("page_moves", "SELECT * FROM moves", _MOVES)
twin(
    "journey_threats",
    """
SELECT date_num, user_cookie, ip, steps, duration, machine_speed, looping, direct_hunting,
  CASE WHEN machine_speed + looping + direct_hunting > 1 THEN 'Critical' ELSE 'Suspicious' END AS verdict
FROM flagged WHERE machine_speed + looping + direct_hunting > 0
""",
    _MOVES,
    f"""flagged AS (SELECT j.*, CAST(steps > 3 AND duration < 2 AS INTEGER) AS machine_speed,
  CAST(coalesce(m >= 3, false) AS INTEGER) AS looping,
  CAST({_words("first_url", journey_rules.HUNTING_WORDS)} AS INTEGER) AS direct_hunting
FROM (SELECT date_num, user_cookie, {_first("ip_user", "browser", "url")}.ip_user AS ip,
  {_first("ip_user", "browser", "url")}.url AS first_url,
  count(*) AS steps, max(timestamp) - min(timestamp) AS duration FROM ua GROUP BY ALL) j
LEFT JOIN (SELECT date_num, user_cookie, max(moves) AS m FROM moves GROUP BY ALL) l USING (date_num, user_cookie))""",
)
_CLUSTERS = f"""clusters AS (SELECT date_num, hostname,
  CASE WHEN p = '' THEN '/' ELSE p END AS path, count(DISTINCT ip_user) AS distinct_ips, count(*) AS reqs,
  count(DISTINCT browser) AS distinct_uas, count(DISTINCT nullif(referer, '')) AS distinct_refs,
  {_first("browser", "referer")}.browser AS ua_sample, {_first("browser", "referer")}.referer AS ref_sample
FROM (SELECT *, regexp_extract(url, '{PATH_PATTERN}', 1) AS p FROM ua) GROUP BY date_num, hostname, path)"""
twin("url_clusters", "SELECT * FROM clusters", _CLUSTERS)
_SAFE = f"""((distinct_ips >= {CLUSTER_LIMITS.ips} AND distinct_uas > {CLUSTER_LIMITS.diverse_share} * distinct_ips
  AND {_words("path", cluster_rules.CONTENT_WORDS)})
OR path = '/' OR regexp_matches(path, '{cluster_rules.STATIC_PATTERN}'))"""
_BOTNET = f"""(distinct_ips >= {CLUSTER_LIMITS.ips}
AND (distinct_uas <= {CLUSTER_LIMITS.agents} OR distinct_refs = 0))"""
_TARGET = f"""({_words("path", cluster_rules.SENSITIVE_PATHS)} AND reqs >= {CLUSTER_LIMITS.sensitive_requests})"""
twin(
    "url_cluster_threats",
    f"""SELECT date_num, hostname, path, distinct_ips, reqs,
  CASE WHEN {_BOTNET} THEN 'Critical' ELSE 'Suspicious' END AS verdict,
  CASE WHEN {_BOTNET} THEN 'DDoS / Botnet' ELSE 'Mass Targeting' END AS threat_type
FROM clusters WHERE NOT {_SAFE} AND ({_BOTNET} OR {_TARGET})""",
    _CLUSTERS,
)


# The second-level names that occur in the test tables' hosts.
_TWO_LEVEL = "('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.vn', 'edu.vn', 'gov.vn', 'com.au', 'co.jp', 'com.br')"


def _registered(host: str) -> str:
    two = f"regexp_extract(lower({host}), '([^.]+\\.[^.]+)$', 1)"
    three = f"regexp_extract(lower({host}), '([^.]+\\.[^.]+\\.[^.]+)$', 1)"
    return f"""(CASE WHEN {two} = '' THEN lower({host})
  WHEN {two} IN {_TWO_LEVEL} AND {three} <> '' THEN {three} ELSE {two} END)"""


_TARGETS = """targets AS (SELECT date_num, referer, hostname, count(*) AS reqs FROM ua
WHERE referer <> '' GROUP BY ALL)"""
_META = referer_rules.META_PATTERN.replace("'", "''")
_REFERERS = [
    _TARGETS,
    """shown AS (SELECT date_num, referer, string_agg(hostname, ',' ORDER BY hostname) AS targets
FROM targets GROUP BY ALL)""",
    f"""texts AS (SELECT url AS referer, arg_min(t, page_id) AS title, arg_min(d, page_id) AS description FROM (
  SELECT url, page_id, trim(regexp_extract(html, '{referer_rules.TITLE_PATTERN}', 1)) AS t,
    trim(regexp_extract(html, '{_META}', 1)) AS d FROM pages) GROUP BY ALL)""",
    f"""refs AS (SELECT date_num, referer, regexp_extract(referer, '{HOST_PATTERN}', 1) AS ref_domain,
  count(DISTINCT ip_user) AS ips, count(*) AS reqs,
  count(*) FILTER (WHERE {_registered(f"regexp_extract(referer, '{HOST_PATTERN}', 1)")} <> {_registered("domain")}) AS reqs_elsewhere,
  count(DISTINCT hostname) AS target_hosts
FROM ua WHERE referer <> '' GROUP BY ALL)""",
    """rprofile AS (SELECT refs.*, targets, coalesce(title, '') AS title, coalesce(description, '') AS description
FROM refs JOIN shown USING (date_num, referer) LEFT JOIN texts USING (referer))""",
]
twin("referer_targets", "SELECT * FROM targets", _TARGETS)
twin("referer_profile", "SELECT * FROM rprofile", *_REFERERS)
_RD = _registered("ref_domain")
_UNRELATED = f"reqs_elsewhere > {REFERER_LISTS.high_traffic}"
_REF_RULES = [
    (f"{_RD} IN {_list(REFERER_LISTS.spam)}", "Suspicious|Referer Spam|Block referer"),
    (_words("ref_domain", REFERER_LISTS.adult), "Critical|Adult / Gambling|Block referer"),
    (_words(f"regexp_extract(referer, '{QUERY_PATTERN}', 1)", REFERER_LISTS.seo), "Suspicious|SEO Injection|Block referer"),
    (f"{_RD} IN {_list(REFERER_LISTS.social)}", ""),
    (f"({_words('title', REFERER_LISTS.page)} OR {_words('description', REFERER_LISTS.page)})", "Critical|Content Mismatch|Block referer"),
    (f"{_UNRELATED} AND {_RD} IN {_list(REFERER_LISTS.portals)}", "Suspicious|Referer Spoofing|Monitor"),
    (
        f"""({_RD} IN ('bbc.co.uk', 'bbc.com', 'cnn.com', 'google.com', 'nytimes.com', 'reuters.com',
  'theguardian.com', 'wikipedia.org', 'yahoo.com')
OR regexp_matches(lower(ref_domain), '(^|\\.)(gov|edu|mil)(\\.|$)'))""",
        "",
    ),
    (_UNRELATED, "Critical|Compromised Site|Block referer"),
]
_REF_CASE = " ".join(f"WHEN {cond} THEN '{text}'" for cond, text in _REF_RULES)
twin(
    "referer_threats",
    f"""SELECT date_num, referer, reqs, targets, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS type,
  split_part(v, '|', 3) AS action
FROM (SELECT *, CASE {_REF_CASE} ELSE '' END AS v FROM rprofile) WHERE v <> ''""",
    *_REFERERS,
)

_PRIORITY = "CASE lower(verdict) WHEN 'critical' THEN 2 ELSE 1 END"
twin(
    "alerts_dedupe",
    f"""SELECT *, CAST({_PRIORITY} AS INTEGER) AS priority FROM threats
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY {_PRIORITY} DESC, date_num) = 1""",
    *THREATS,
)
ALERTS = f"""alerts AS (SELECT verdict, CAST(score AS VARCHAR) AS score, ip, CAST(NULL AS VARCHAR) AS country,
  CAST(NULL AS VARCHAR) AS isp, threat_type, reason, solution,
  strftime({_day("date_num")}, '%Y-%m-%d 00:00:00') AS created_at,
  CAST(epoch({_day("date_num")}) AS BIGINT) AS timestamp FROM threats)"""
_SHOWN = "CASE WHEN length(reason) > 80 THEN left(reason, 80) || '...' ELSE reason END AS reason_display"


def _matching(text: str) -> str:
    return " OR ".join(f"contains(lower(coalesce({c}, '')), '{text}')" for c in alert_rules.SEARCH_COLUMNS)


twin("alerts_search", f"SELECT *, {_SHOWN} FROM alerts WHERE {_matching('attack')}", *THREATS, ALERTS)
twin(
    "alerts_page",
    f"""SELECT *, {_SHOWN}, (SELECT count(*) FROM alerts WHERE {_matching("scan")}) AS total_rows,
  CAST(ceil((SELECT count(*) FROM alerts WHERE {_matching("scan")}) / 20.0) AS BIGINT) AS total_pages
FROM alerts WHERE {_matching("scan")}
ORDER BY timestamp DESC, ip, threat_type, reason LIMIT 20 OFFSET 20""",
    *THREATS,
    ALERTS,
)
twin("alerts_dismiss", f"SELECT * FROM alerts WHERE ip NOT IN {_list(DISMISSED)}", *THREATS, ALERTS)
twin(
    "alerts_dismiss_table",
    "SELECT * FROM alerts WHERE ip NOT IN (SELECT ip FROM alerts WHERE threat_type = 'Multi-host Scan')",
    *THREATS,
    ALERTS,
)
twin(
    "alerts_table",
    f"""
SELECT * FROM alerts
WHERE NOT (ip IN {_list(DISMISSED)} AND timestamp < epoch(make_timestamp({DAY // 10000}, {DAY // 100 % 100}, {DAY % 100}, 0, 0, 0)))
  AND ip NOT IN (SELECT ip FROM alerts WHERE threat_type = 'Multi-host Scan')
""",
    *THREATS,
    ALERTS,
)
twin("loaded_alerts", "SELECT * FROM alerts", *THREATS, ALERTS)
twin(
    "loaded_verdicts",
    """SELECT date_num, verdict, CAST(score AS VARCHAR) AS score, ip, 'US' AS country, 'Example Net' AS isp, threat_type,
  reason || ',' || chr(10) || 'checked' AS reason, solution
FROM threats""",
    *THREATS,
)
twin(
    "blocklist",
    f"""
SELECT DISTINCT CAST(CASE WHEN contains(ip, ':') THEN 6 ELSE 4 END AS INTEGER) AS version,
  CASE WHEN ip LIKE '2001:db8:0:0::%' THEN '2001:db8::/64'
       WHEN contains(ip, ':') THEN regexp_extract(ip, '^([0-9a-f]+:[0-9a-f]+:[0-9a-f]+:[0-9a-f]+)::', 1) || '::/64'
       ELSE ip END AS ip,
  '{alert_rules.BLOCK_COMMENT}' AS comment
FROM threats
""",
    *THREATS,
)
twin(
    "stream_abuse_alerts",
    """SELECT verdict, CAST(score AS VARCHAR) AS score, ip, CAST(NULL AS VARCHAR) AS country,
  CAST(NULL AS VARCHAR) AS isp, threat_type, reason, solution,
  strftime(make_timestamp(as_of * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, as_of AS timestamp
FROM threats, latest""",
    *_RANKED,
    *_threats("window_rank"),
)
ORACLE["stream_abuse_by_address"] = ORACLE["stream_abuse_alerts"]
twin(
    "stream_sliding_users",
    """
SELECT slot_start, count(DISTINCT user_cookie) AS users FROM (
  SELECT user_cookie, unnest(range(timestamp // 60 * 60 - 29 * 60, timestamp // 60 * 60 + 1, 60)) AS slot_start
  FROM ua WHERE is_bot = 0) GROUP BY ALL
""",
)
twin(
    "stream_sliding_hits",
    """
SELECT slot_start, count(*) AS hits FROM (
  SELECT unnest(range(timestamp // 60 * 60 - 29 * 60, timestamp // 60 * 60 + 1, 60)) AS slot_start
  FROM ua WHERE is_bot = 0) GROUP BY ALL
""",
)
twin(
    "stream_open_slots",
    "SELECT slot_start, hostname, CAST(count(*) AS BIGINT) AS active_users FROM slots GROUP BY ALL",
    SLOTS,
)
twin(
    "stream_minute_peak",
    """
SELECT CAST(max(users) AS BIGINT) AS peak FROM (
  SELECT timestamp // 60 AS minute, count(DISTINCT user_cookie) AS users FROM ua WHERE is_bot = 0 GROUP BY ALL)
""",
)
twin(
    "monthly_users_bitmap",
    f"SELECT CAST(date_num // 100 AS BIGINT) AS month, CAST({USERS} AS BIGINT) AS users FROM ua GROUP BY ALL HAVING {USERS} > 0",
)
twin(
    "daily_new_users_sketch_error",
    f"""
SELECT s.date_num, count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM seen b WHERE b.user_cookie = s.user_cookie
      AND {_day("b.date_num")} < {_day("s.date_num")} AND {_day("b.date_num")} >= {_day("s.date_num")} - 7
  )) AS new_users, 1 AS close
FROM seen s GROUP BY s.date_num
""",
    "seen AS (SELECT DISTINCT date_num, user_cookie FROM ua WHERE is_bot = 0)",
)
