"""Hot keys: a third and more of the rows on one host, address, cookie and URL."""

import random
from collections import defaultdict

import pytest
from conftest import DAY_START

from pulseline.operators import clusters, ips, paging, rollups, sessions, summary


@pytest.fixture(scope="module")
def rows_():
    rng = random.Random(11)

    def hot(name, n):
        return f"{name}-hot" if rng.random() < 0.4 else f"{name}{rng.randrange(n)}"

    return [
        dict(
            id=i,
            timestamp=DAY_START + rng.randrange(172800),
            hostname=hot("h", 4),
            url="http://x/" + hot("p", 6),
            session_id=hot("s", 30),
            user_cookie="" if rng.random() < 0.35 else f"u{rng.randrange(25)}",
            ip_user=hot("ip", 8),
            browser=hot("b", 3),
            referer=hot("r", 3) if rng.random() < 0.8 else "",
            is_bot=int(rng.random() < 0.3),
        )
        for i in range(1500)
    ]


def groups(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        day = 20240115 + (r["timestamp"] - DAY_START) // 86400
        out[(day, *[r[k] for k in keys])].append(r)
    return out


def test_daily_rollup(act, rows_):
    got = {(r.date_num, r.hostname): r for r in rollups.daily_rollup(act(*rows_).repartition(6)).collect()}
    want = groups(rows_, "hostname")
    assert set(got) == set(want)
    for key, rs in want.items():
        human = [r for r in rs if not r["is_bot"]]
        assert got[key].asDict() == dict(
            date_num=key[0],
            hostname=key[1],
            users=len({r["user_cookie"] for r in human}),
            views=len({(r["session_id"], r["url"]) for r in rs}),
            sessions=len({r["session_id"] for r in rs}),
            bot_sessions=len({r["session_id"] for r in rs if r["is_bot"]}),
            bot_hits=len(rs) - len(human),
            stay_seconds=10 * len(human),
        )


def test_rollup_of_merged_states(act, rows_):
    ua = act(*rows_)
    parts = [rollups.page_loads(ua.filter(f"id % 3 = {i}")) for i in range(3)]
    merged = rollups.merge_page_loads(parts[0].union(parts[1]).union(parts[2]))
    for by in (["date_num", "hostname"], ["date_num"], []):
        a = sorted(map(tuple, rollups.rollup_from_loads(merged, by).collect()))
        assert a == sorted(map(tuple, rollups.daily_rollup(ua, by).collect()))


def test_ip_profile(act, rows_):
    got = {(r.date_num, r.ip_user): r for r in ips.ip_profile(act(*rows_).repartition(6)).collect()}
    want = groups(rows_, "ip_user")
    assert set(got) == set(want)
    for key, rs in want.items():
        g = got[key]
        last = max(rs, key=lambda r: (r["timestamp"], r["referer"]))
        first = min(rs, key=lambda r: (r["timestamp"], r["browser"]))
        times = [r["timestamp"] for r in rs]
        assert (g.total_requests, g.bot_flags) == (len(rs), sum(r["is_bot"] for r in rs))
        assert g.distinct_cookies == len({r["user_cookie"] for r in rs})
        assert g.distinct_hostnames == len({r["hostname"] for r in rs})
        assert g.distinct_urls == len({r["url"] for r in rs})
        assert (g.user_agent, g.sample_referer) == (first["browser"], last["referer"])
        assert g.duration_sec == max(times) - min(times)


def test_url_clusters(act, rows_):
    got = {(r.date_num, r.hostname, r.path): r for r in clusters.url_clusters(act(*rows_)).collect()}
    want = groups(rows_, "hostname", "url")
    assert set(got) == {(d, h, u.removeprefix("http://x")) for d, h, u in want}
    for (day, host, url), rs in want.items():
        g = got[day, host, url.removeprefix("http://x")]
        assert (g.reqs, g.distinct_ips) == (len(rs), len({r["ip_user"] for r in rs}))
        assert g.distinct_uas == len({r["browser"] for r in rs})
        assert g.distinct_refs == len({r["referer"] for r in rs} - {""})


def test_session_detail_and_stays(act, rows_):
    ua = act(*rows_)
    got = {(r.date_num, r.session_id, r.user_cookie): r for r in sessions.session_detail(ua).collect()}
    want = groups(rows_, "session_id", "user_cookie")
    assert set(got) == set(want)
    for key, rs in want.items():
        last = max(rs, key=lambda r: (r["timestamp"], r["hostname"], r["url"]))
        assert (got[key].hostname, got[key].url) == (last["hostname"], last["url"])
    stays = {(r.date_num, r.session_id): (r.stay, r.hits) for r in summary.session_stays(ua).collect()}
    for key, rs in groups(rows_, "session_id").items():
        times = [r["timestamp"] for r in rs]
        assert stays[key] == (max(times) - min(times), len(rs))


def test_top_n_of_a_hot_group(act, rows_):
    df = act(*rows_)
    got = paging.top_n(df, 3, ["timestamp", "id"], per=["ip_user"]).select("ip_user", "id").collect()
    want = set()
    by_ip = defaultdict(list)
    for r in rows_:
        by_ip[r["ip_user"]].append((r["timestamp"], r["id"]))
    for ip, events in by_ip.items():
        want |= {(ip, i) for _, i in sorted(events)[:3]}
    assert {tuple(r) for r in got} == want
