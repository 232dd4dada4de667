"""Address profiles and rule-based verdicts on them."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.text import any_word, blank, is_attack, is_sensitive
from pulseline.functions.timefn import LOCAL_TZ, as_column, local_date_num, shift_day
from pulseline.operators.paging import top_n

# Words and weights of the address rules.
DIRTY_REFERER_WORDS = ["porn", "gamble", "viagra", "sex"]
TOOL_WORDS = ["python", "curl", "http", "headless"]
BROWSER_WORDS = ["chrome", "safari"]
ATTACK_WEIGHT = 50
SENSITIVE_WEIGHT = 20
FAST_RPS = 5
RPS_WEIGHT = 10
PROFILE_ROWS = 300
RECENT_SECONDS = 7200


@dataclass(frozen=True)
class IpThresholds:
    """Limits of the address rules; the defaults are fixed values but for the shared agents."""

    hosts: int = 5
    sensitive: int = 5
    cookies: int = 15
    burst_requests: int = 500
    burst_seconds: int = 10
    rps: float = 50.0
    spoof_rps: float = 2.0
    quiet_requests: int = 10
    shared_agent_ips: int = 20


VISIT = ["user_cookie", "hostname", "url", "browser", "referer", "is_bot"]


def _visits(ua: DataFrame, per) -> DataFrame:
    """Requests of one address folded per cookie, agent and page load.

    The URL patterns then run once per URL instead of once per request, and a busy
    address is spread over its URLs before its distincts are counted.
    """
    return aggs.fold(ua, *per, "ip_user", *VISIT)


def ip_profile(ua: DataFrame, per=("date_num",), approx: bool = False) -> DataFrame:
    """One row per address and ``per`` columns, with its risk score.

    ``approx`` counts distincts by sketches, which copies no row.
    """
    return profile_of_visits(_visits(ua, per), per, approx).drop("last_ts")


def profile_of_visits(visits: DataFrame, per=("date_num",), approx: bool = False) -> DataFrame:
    """The profile from folded visits, and the second of an address's last request as ``last_ts``."""
    rows = visits.groupBy(*per, "ip_user").agg(
        aggs.uniq("user_cookie", approx=approx).alias("distinct_cookies"),
        F.max(F.when(blank("user_cookie"), 0).otherwise(1)).alias("has_cookie"),
        aggs.first_of("browser").alias("first"),
        F.sum("hits").alias("total_requests"),
        aggs.uniq("hostname", approx=approx).alias("distinct_hostnames"),
        aggs.uniq("url", approx=approx).alias("distinct_urls"),
        F.sum(F.when(is_sensitive("url"), F.col("hits")).otherwise(0)).alias("sensitive_hits"),
        F.sum(F.when(is_attack("url"), F.col("hits")).otherwise(0)).alias("attack_hits"),
        aggs.last_of("referer").alias("last"),
        F.sum(F.col("hits") * F.col("is_bot")).alias("bot_flags"),
        aggs.span().alias("duration_sec"),
        F.max("last_ts").alias("last_ts"),
    )
    rps = aggs.round_at(F.col("total_requests") / F.greatest("duration_sec", F.lit(1)), 2)
    score = (
        F.col("attack_hits") * ATTACK_WEIGHT
        + F.col("sensitive_hits") * SENSITIVE_WEIGHT
        + F.when(F.col("rps") > FAST_RPS, F.col("rps") * RPS_WEIGHT).otherwise(0.0)
        + F.col("total_requests")
    )
    return (
        rows.withColumns(
            {
                "user_agent": F.col("first.browser"),
                "sample_referer": F.col("last.referer"),
                "rps": rps,
            }
        )
        .withColumn("score", score)
        .drop("first", "last")
    )


def riskiest(profile: DataFrame, n: int = PROFILE_ROWS, per=("date_num",)) -> DataFrame:
    """The ``n`` addresses with the highest score, overall (``per=None``) or per group."""
    return top_n(profile, n, [F.desc("score"), "ip_user"], per=per)


def recent_activity(ua: DataFrame, as_of, seconds: int = RECENT_SECONDS, tz: str = LOCAL_TZ) -> DataFrame:
    """Today's last two hours; if empty, all of today; if empty, yesterday.

    Every row is ranked by the first of the three windows it falls in and the best rank
    present decides which rows stay.
    """
    as_of = as_column(as_of)
    today = local_date_num(as_of, tz)
    yesterday = shift_day(today, -1)
    rank = (
        F.when((F.col("date_num") == today) & (F.col("timestamp") >= as_of - F.lit(seconds)), 1)
        .when(F.col("date_num") == today, 2)
        .otherwise(3)
    )
    rows = (
        ua.filter((F.col("date_num") >= yesterday) & (F.col("date_num") <= today))
        .filter(F.col("timestamp") <= as_of)
        .withColumn("window_rank", rank)
    )
    best = rows.select(F.min("window_rank")).scalar()
    return rows.filter(F.col("window_rank") == best)


def ip_profile_recent(ua: DataFrame, as_of, n: int = PROFILE_ROWS) -> DataFrame:
    """Profile of the freshest non-empty window, with the window that was used."""
    per = ("window_rank",)
    return riskiest(ip_profile(recent_activity(ua, as_of), per), n, per=None)


def shared_agents(profile: DataFrame, at_least: int, per=("date_num",)) -> DataFrame:
    """User agents that at least so many addresses have in common."""
    return (
        profile.groupBy(*per, "user_agent")
        .agg(F.count("*").alias("agent_ips"))
        .filter(F.col("agent_ips") >= at_least)
    )


def ip_threats(
    profile: DataFrame,
    limits: IpThresholds = IpThresholds(),
    per=("date_num",),
    shared: DataFrame | None = None,
) -> DataFrame:
    """Critical and suspicious addresses; the first rule that holds names the threat.

    The profile has one row per address and is read twice, so pass a stored one. A common
    user agent makes the join key hot, which the adaptive skew join splits; the other
    side has one row per agent. ``shared`` holds the shared agents where the profile
    has not all addresses.
    """
    if shared is None:
        shared = shared_agents(profile, limits.shared_agent_ips, per)
    rows = profile.join(shared, [*per, "user_agent"], "left")

    c = F.col
    looks_like_browser = any_word("user_agent", BROWSER_WORDS) & ~any_word("user_agent", TOOL_WORDS)
    no_identity = (c("has_cookie") == 0) | blank("sample_referer")
    rules = [
        # (verdict, threat type, condition, metric named in the reason, solution)
        ("Critical", "Web Attack", c("attack_hits") > 0, "attack_hits", "Block IP immediately"),
        ("Critical", "Dirty Referer", any_word("sample_referer", DIRTY_REFERER_WORDS), "sample_referer", "Block IP and Referer domain"),
        ("Critical", "Sensitive Scan", c("sensitive_hits") > limits.sensitive, "sensitive_hits", "Block IP immediately"),
        ("Critical", "Multi-host Scan", c("distinct_hostnames") > limits.hosts, "distinct_hostnames", "Block IP immediately"),
        ("Suspicious", "Cookie Abuse", c("distinct_cookies") > limits.cookies, "distinct_cookies", "Rate limit"),
        ("Suspicious", "Automation Tool", any_word("user_agent", TOOL_WORDS), "user_agent", "Rate limit"),
        ("Suspicious", "Request Burst", (c("total_requests") > limits.burst_requests) & (c("duration_sec") < limits.burst_seconds), "total_requests", "Rate limit"),
        ("Suspicious", "High Rate", c("rps") > limits.rps, "rps", "Rate limit"),
        ("Suspicious", "Spoofed Browser", looks_like_browser & no_identity & (c("rps") > limits.spoof_rps), "rps", "Monitor"),
        ("Suspicious", "Quiet Probing", (c("total_requests") < limits.quiet_requests) & (c("sensitive_hits") > 0), "sensitive_hits", "Monitor"),
        ("Suspicious", "Shared Agent", c("agent_ips").isNotNull(), "agent_ips", "Monitor"),
    ]
    found = None
    for verdict, threat, condition, metric, solution in rules:
        hit = F.struct(
            F.lit(verdict).alias("verdict"),
            F.lit(threat).alias("threat_type"),
            F.concat(F.lit(f"{metric}="), c(metric).cast("string")).alias("reason"),
            F.lit(solution).alias("solution"),
        )
        found = F.when(condition, hit) if found is None else found.when(condition, hit)

    extra = F.floor(c("score") / 100)
    risk = F.when(c("verdict") == "Critical", F.least(F.lit(100), 90 + extra)).otherwise(
        F.least(F.lit(89), 60 + extra)
    )
    return (
        rows.withColumn("hit", found)
        .filter("hit IS NOT NULL")
        .select(*per, c("ip_user").alias("ip"), "score", "hit.*")
        .withColumn("score", risk.cast("int"))
    )
