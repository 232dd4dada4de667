import random
from collections import Counter

import pytest
from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.operators import alerts, clusters, ips, journeys, referers
from pulseline.sources import tables

DAY = 20240115


def test_profile_counts_requests_of_folded_urls(act):
    bad = "http://a.example.com/wp-admin?q=UNION%20select"
    ua = act(*[dict(url=bad, timestamp=DAY_START + i) for i in range(4)], dict(user_cookie="", referer="r", timestamp=DAY_START + 10))
    got = ips.ip_profile(ua).first()
    assert (got.total_requests, got.sensitive_hits, got.attack_hits) == (5, 4, 4)
    assert (got.distinct_cookies, got.distinct_urls, got.has_cookie) == (2, 2, 1)
    assert (got.duration_sec, got.rps, got.sample_referer) == (10, 0.5, "r")
    assert got.score == 4 * 50 + 4 * 20 + 5


def profile(spark, **changes):
    base = dict(
        date_num=DAY, ip_user="1.1.1.1", distinct_cookies=1, has_cookie=1, total_requests=20,
        distinct_hostnames=1, distinct_urls=1, sensitive_hits=0, attack_hits=0, bot_flags=0,
        duration_sec=100, user_agent="Mozilla Chrome", sample_referer="http://x", rps=0.2, score=20.0,
    )
    base.update(changes)
    return spark.createDataFrame([base])


def test_ip_rules(spark):
    cases = [
        (dict(), None),
        (dict(attack_hits=1), "Web Attack"),
        (dict(sample_referer="http://PORN.example"), "Dirty Referer"),
        (dict(sensitive_hits=6), "Sensitive Scan"),
        (dict(distinct_hostnames=6), "Multi-host Scan"),
        (dict(distinct_hostnames=5), None),
        (dict(distinct_cookies=16), "Cookie Abuse"),
        (dict(user_agent="Mozilla (+http://crawler.example)"), "Automation Tool"),
        (dict(total_requests=501, duration_sec=9), "Request Burst"),
        (dict(rps=50.1), "High Rate"),
        (dict(rps=2.1, has_cookie=0), "Spoofed Browser"),
        (dict(rps=2.1, sample_referer=""), "Spoofed Browser"),
        (dict(rps=2.1, sample_referer="", user_agent="Opera"), None),
        (dict(total_requests=9, sensitive_hits=1), "Quiet Probing"),
    ]
    for changes, threat in cases:
        got = [r.threat_type for r in ips.ip_threats(profile(spark, **changes)).collect()]
        assert got == ([threat] if threat else []), changes


def test_shared_agent_rule_and_score(spark):
    rows_ = [profile(spark, ip_user=f"1.1.1.{i}") for i in range(3)]
    shared = rows_[0].union(rows_[1]).union(rows_[2])
    limits = ips.IpThresholds(shared_agent_ips=3)
    assert {r.reason for r in ips.ip_threats(shared, limits).collect()} == {"agent_ips=3"}
    worst = ips.ip_threats(profile(spark, attack_hits=9, score=1e6)).first()
    assert (worst.verdict, worst.score) == ("Critical", 100)


def test_recent_activity_falls_back(act):
    now = DAY_START + 86400 + 50000
    yesterday, today, recent = (dict(timestamp=t) for t in (DAY_START, now - 9000, now - 60))
    for given, rank in (
        ([yesterday, today, recent], 1),
        ([yesterday, today], 2),
        ([yesterday], 3),
    ):
        got = ips.recent_activity(act(*given), now).collect()
        assert [r.window_rank for r in got] == [rank]


def test_path_keeps_what_can_show(act):
    steps = [dict(url=f"/{i}" if i % 2 else "", timestamp=DAY_START + i // 2, id=i) for i in range(300)]
    for days in (None, [DAY]):
        got = journeys.journeys(act(*steps), days=days).first()
        whole = " -> ".join(s["url"] for s in steps)
        assert got.path == whole[:500] + "..."
        assert (got.steps, got.duration) == (300, 149)


def test_empty_urls_fill_the_path(act):
    steps = [dict(url="", timestamp=DAY_START + i) for i in range(200)]
    assert journeys.journeys(act(*steps)).first().path == (" -> " * 199)[:500] + "..."


def test_page_moves_against_brute_force(act):
    rng = random.Random(7)
    events, when = [], DAY_START
    for i in range(400):
        when += rng.choice([0, 1, 5, 30, 90, 600])
        cookie = "" if rng.random() < 0.6 else f"u{rng.randrange(3)}"
        events.append(dict(timestamp=when, id=i, user_cookie=cookie, url=rng.choice("abc"), date_num=DAY))
    want, last = Counter(), {}
    for e in events:
        before = last.get(e["user_cookie"])
        if before is not None and before != e["url"]:
            want[e["user_cookie"], before, e["url"]] += 1
        last[e["user_cookie"]] = e["url"]
    for seconds in (1, 60, 100000):
        got = journeys.page_moves(act(*events).repartition(5), seconds)
        assert {(r.user_cookie, r.from_url, r.to_url): r.moves for r in got.collect()} == want


def test_journey_rules(act):
    ua = act(
        *[dict(user_cookie="fast", url=f"/{i}", timestamp=DAY_START, id=i) for i in range(4)],
        *[dict(user_cookie="loop", url="ab"[i % 2], timestamp=DAY_START + i * 50) for i in range(7)],
        *[dict(user_cookie="stay", url="/same", timestamp=DAY_START + i * 10) for i in range(9)],
        dict(user_cookie="hunt", url="http://x/Login", timestamp=DAY_START),
    )
    got = rows(journeys.journey_threats(ua), "user_cookie", "machine_speed", "looping", "direct_hunting")
    assert got == [("fast", 1, 0, 0), ("hunt", 0, 0, 1), ("loop", 0, 1, 0)]


def cluster(spark, **changes):
    base = dict(date_num=DAY, hostname="h", path="/x", distinct_ips=2000, reqs=9000, distinct_uas=3, distinct_refs=5)
    base.update(changes)
    return spark.createDataFrame([base])


def test_cluster_rules(spark):
    cases = [
        (dict(), "DDoS / Botnet"),
        (dict(distinct_uas=6), None),
        (dict(distinct_uas=6, distinct_refs=0), "DDoS / Botnet"),
        (dict(distinct_uas=401, path="/News/1", distinct_refs=0), None),
        (dict(distinct_uas=400, path="/news/1", distinct_refs=0), "DDoS / Botnet"),
        (dict(path="/"), None),
        (dict(path="/app.CSS"), None),
        (dict(distinct_ips=5, path="/login", reqs=100), "Mass Targeting"),
        (dict(distinct_ips=5, path="/login", reqs=99), None),
    ]
    for changes, threat in cases:
        got = [r.threat_type for r in clusters.url_cluster_threats(cluster(spark, **changes)).collect()]
        assert got == ([threat] if threat else []), changes


def referer(spark, **changes):
    base = dict(
        date_num=DAY, referer="http://shop.example.com/", ref_domain="shop.example.com", reqs=900,
        reqs_elsewhere=0, targets="t", title="", description="",
    )
    base.update(changes)
    return spark.createDataFrame([base])


def test_referer_rules(spark):
    cases = [
        (dict(), None),
        (dict(ref_domain="www.semalt.com"), "Referer Spam"),
        (dict(ref_domain="best-casino.example.net"), "Adult / Gambling"),
        (dict(referer="http://x.example/?q=buy-now"), "SEO Injection"),
        (dict(referer="http://x.example/cialis"), None),
        (dict(title="Online CASINO"), "Content Mismatch"),
        (dict(ref_domain="m.facebook.com", title="casino", reqs_elsewhere=999), None),
        (dict(ref_domain="www.msn.com", reqs_elsewhere=501), "Referer Spoofing"),
        (dict(reqs_elsewhere=501), "Compromised Site"),
        (dict(reqs_elsewhere=500), None),
    ]
    for changes, kind in cases:
        got = [r.type for r in referers.referer_threats(referer(spark, **changes)).collect()]
        assert got == ([kind] if kind else []), changes


def test_page_texts(spark):
    html = "<HTML><title>\n A &amp; b </title><meta name='description' content='d e'>"
    pages = spark.createDataFrame([(2, "u", "<title>z</title>"), (1, "u", html)], "page_id bigint, url string, html string")
    got = referers.page_texts(pages).first()
    assert (got.title.strip(), got.description) == ("A &amp; b", "d e")


REPORT = '''```csv
score, ip ,verdict,threat_type,reason,country
90,1.1.1.1,CRITICAL,Web Attack,"5 tries, ""admin""",US
50,1.1.1.1,Suspicious,Later,x,US
60,2.2.2.2,suspicious,First,x,
61,2.2.2.2,Suspicious,Second,x,US
10,3.3.3.3,Safe,None,x,US
90,<IP>,Critical,Web Attack,x,US
90,4.4.4.4,Critical,&lt;threat_type&gt;,x,US
```
'''


def test_verdict_report(spark, tmp_path):
    (tmp_path / "r1.csv").write_text(REPORT)
    (tmp_path / "r2.csv").write_text("verdict,ip,threat_type\nCritical,2.2.2.2,Worse\n")
    verdicts = tables.load_verdicts(spark, str(tmp_path))
    assert sorted((r.ip, str(r.score)) for r in verdicts.collect()) == [
        ("1.1.1.1", "50"),
        ("1.1.1.1", "90"),
        ("2.2.2.2", "60"),
        ("2.2.2.2", "61"),
        ("2.2.2.2", "None"),
        ("3.3.3.3", "10"),
    ]
    best = alerts.alerts_dedupe(verdicts, order=["line_no"], per=["report"])
    got = {(r.report[-6:], r.ip): r for r in best.collect()}
    assert set(got) == {("r1.csv", "1.1.1.1"), ("r1.csv", "2.2.2.2"), ("r2.csv", "2.2.2.2")}
    assert got["r1.csv", "1.1.1.1"].reason == '5 tries, "admin"'
    first = got["r1.csv", "2.2.2.2"]
    assert (first.threat_type, first.country, first.solution) == ("First", "UNK", "Check logs manually")
    overall = alerts.alerts_dedupe(verdicts, order=["report", "line_no"])
    assert rows(overall, "ip", "threat_type") == [("1.1.1.1", "Web Attack"), ("2.2.2.2", "Worse")]


def alert_rows(spark, n=25):
    data = [("Critical", str(i), f"1.1.1.{i}", "US", None, "Web Attack", "r" * (70 + i), "s", "t", 100 + i) for i in range(n)]
    return spark.createDataFrame(data, tables.ALERT_SCHEMA)


def test_alert_pages_and_search(spark):
    df = alert_rows(spark)
    page = alerts.alerts_page(df, "WEB", limit=10, offset=20).collect()
    assert [r.ip for r in page] == [f"1.1.1.{i}" for i in (4, 3, 2, 1, 0)]
    assert page[0].total_rows == 25
    assert alerts.alerts_page(df, "1.1.1.2").count() == 6
    shown = alerts.alerts_search(df).filter("ip IN ('1.1.1.10', '1.1.1.11')").orderBy("timestamp").collect()
    assert [r.reason_display for r in shown] == ["r" * 80, "r" * 80 + "..."]


def test_dismiss(spark):
    df = alert_rows(spark, 3)
    left = alerts.alerts_dismiss(df, ["1.1.1.0", "9.9.9.9"])
    assert rows(left, "ip") == [("1.1.1.1",), ("1.1.1.2",)]
    table = df.select("ip").limit(1)
    assert alerts.alerts_dismiss(df, table).count() == 2


def test_malformed_alert_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ip": "1.1.1.1", "timestamp": 5}\n{"ip": \n')
    assert rows(tables.load_alerts(spark, str(tmp_path)), "ip", "timestamp") == [("1.1.1.1", 5)]


def test_blocklist(spark):
    ips_ = ["1.2.3.4", "1.2.3.4", "256.1.1.1", "x", None, "2001:DB8:0:1::5", "2001:db8:0:1:0:0:0:9", "::1", "01.2.3.4"]
    df = spark.createDataFrame([(i,) for i in ips_], "ip string")
    got = rows(alerts.blocklist(df, "c"))
    assert got == [(4, "1.2.3.4", "c"), (6, "2001:db8:0:1::/64", "c"), (6, "::/64", "c")]


def test_cluster_samples_and_referers(act):
    ua = act(dict(referer="", ip_user="1"), dict(referer="r", ip_user="2"), dict(url="http://h"))
    got = clusters.url_clusters(ua).orderBy(F.desc("path")).first()
    assert (got.path, got.distinct_ips, got.distinct_refs, got.ref_sample) == ("/p", 2, 1, "")


def test_reports_with_line_breaks_and_many_columns(spark, tmp_path):
    names = [f"x{i}" for i in range(33)] + ["verdict", "ip", "threat_type", "reason"]
    cells = [""] * 33 + ["Critical", "1.1.1.1", "Scan", '"two\nlines, ""quoted"""']
    (tmp_path / "r.csv").write_text("```csv\n" + ",".join(names) + "\n" + ",".join(cells) + "\n```\n")
    (tmp_path / "empty.csv").write_text("")
    got = tables.load_verdicts(spark, str(tmp_path)).collect()
    assert [(r.verdict, r.ip, r.threat_type, r.reason, r.line_no) for r in got] == [
        ("Critical", "1.1.1.1", "Scan", 'two\nlines, "quoted"', 1)
    ]


def test_alert_lines_count_whichever_columns_are_read(spark, tmp_path):
    lines = ['{"ip": "1.1.1.1", "timestamp": 5}', '{"ip": "2.2.2.2", "timestamp": "x"}', '{"ip": ', '{"ip": "3"} junk']
    (tmp_path / "a.json").write_text("\n".join(lines))
    loaded = tables.load_alerts(spark, str(tmp_path))
    assert rows(loaded.fillna(0), "ip", "timestamp") == [("1.1.1.1", 5), ("2.2.2.2", 0)]
    assert loaded.count() == 2
    assert [r.total_rows for r in alerts.alerts_page(loaded).collect()] == [2, 2]


def test_public_and_mainstream_referers_are_safe(spark):
    schema = "date_num int, referer string, ref_domain string, reqs long, reqs_elsewhere long, targets string, title string, description string"
    hosts = ["tax.gov", "x.edu.vn", "www.bbc.co.uk", "shop.example.co.uk", "steel.example"]
    data = [(1, f"http://{h}/", h, 900, 900, "t", "", "") for h in hosts]
    got = referers.referer_threats(spark.createDataFrame(data, schema))
    assert rows(got, "referer", "type") == [
        ("http://shop.example.co.uk/", "Compromised Site"),
        ("http://steel.example/", "Compromised Site"),
    ]


def test_all_targets_are_listed(act):
    hosts = [f"h{i:02d}.example" for i in range(25)]
    ua = act(*[dict(hostname=h, referer="http://r.example/x") for h in hosts])
    pages = ua.sparkSession.createDataFrame([], "page_id long, url string, html string")
    got = referers.referer_profile(ua, pages).first()
    assert got.targets == ",".join(hosts) and got.target_hosts == 25


@pytest.mark.parametrize(
    "host,domain",
    [
        ("shop.example.co.uk", "example.co.uk"),
        ("other.co.uk", "other.co.uk"),
        ("co.uk", "co.uk"),
        ("a.b.com.vn", "b.com.vn"),
        ("a.b.example", "b.example"),
        ("localhost", "localhost"),
    ],
)
def test_registered_domain(spark, host, domain):
    from pulseline.functions.text import registered_domain

    assert spark.createDataFrame([(host,)], "h string").select(registered_domain("h")).first()[0] == domain
