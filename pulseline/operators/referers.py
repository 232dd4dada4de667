"""Referer profiles and verdicts on dirty or hacked referers."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.text import (
    TWO_LEVEL_SUFFIXES,
    any_word,
    blank,
    host_of,
    query_of,
    registered_domain,
)

# Word and domain lists of the referer rules.
SPAM_DOMAINS = ["semalt.com", "buttons-for-website.com"]
ADULT_WORDS = ["porn", "casino", "sex", "betting"]
SEO_WORDS = ["viagra", "cialis", "buy-now"]
PAGE_WORDS = ["casino", "sex", "porn", "betting", "viagra"]
SOCIAL_DOMAINS = [
    "facebook.com",
    "instagram.com",
    "tiktok.com",
    "twitter.com",
    "linkedin.com",
    "youtube.com",
]
PORTAL_DOMAINS = ["msn.com"]
# Mainstream sites may send much traffic anywhere: labels of public bodies and schools, and
# large news sites.
MAINSTREAM_LABELS = ["gov", "edu", "mil"]
MAINSTREAM_DOMAINS = [
    "bbc.co.uk",
    "bbc.com",
    "cnn.com",
    "google.com",
    "nytimes.com",
    "reuters.com",
    "theguardian.com",
    "wikipedia.org",
    "yahoo.com",
]

# HTML of a crawled page: its title and meta description.
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
META_PATTERN = r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']"

REFERER = ["date_num", "referer"]


@dataclass(frozen=True)
class RefererLists:
    """Lists and the traffic limit of the referer rules; the defaults are fixed values."""

    spam: list = field(default_factory=lambda: list(SPAM_DOMAINS))
    adult: list = field(default_factory=lambda: list(ADULT_WORDS))
    seo: list = field(default_factory=lambda: list(SEO_WORDS))
    page: list = field(default_factory=lambda: list(PAGE_WORDS))
    social: list = field(default_factory=lambda: list(SOCIAL_DOMAINS))
    portals: list = field(default_factory=lambda: list(PORTAL_DOMAINS))
    mainstream_labels: list = field(default_factory=lambda: list(MAINSTREAM_LABELS))
    mainstream: list = field(default_factory=lambda: list(MAINSTREAM_DOMAINS))
    suffixes: list = field(default_factory=lambda: list(TWO_LEVEL_SUFFIXES))
    high_traffic: int = 500


def page_texts(pages: DataFrame) -> DataFrame:
    """Title and description per URL, taken out of the HTML before anything is shuffled."""
    def found(pattern):
        return F.trim(F.regexp_extract("html", pattern, 1))

    texts = pages.select(
        "url",
        "page_id",
        found(TITLE_PATTERN).alias("title"),
        found(META_PATTERN).alias("description"),
    )
    first = F.min(F.struct("page_id", "title", "description")).alias("p")
    return texts.groupBy("url").agg(first).select("url", "p.title", "p.description")


def referer_targets(ua: DataFrame) -> DataFrame:
    """Requests per day, referer and target host: the complete target list."""
    return ua.filter(~blank("referer")).groupBy(*REFERER, "hostname").agg(
        F.count("*").alias("reqs")
    )


def referer_profile(
    ua: DataFrame,
    pages: DataFrame,
    suffixes: list = TWO_LEVEL_SUFFIXES,
    approx: bool = False,
) -> DataFrame:
    """Per day and referer: domain, addresses, requests, targets, title, description.

    ``targets`` names all hosts that receive traffic, ``target_hosts`` counts them;
    ``referer_targets`` has them as rows with their requests. One scan of the activity feeds everything.
    """
    hosts = (
        ua.filter(~blank("referer"))
        .groupBy(*REFERER, "hostname", "domain", "ip_user")
        .agg(F.count("*").alias("reqs"))
        .withColumn("ref_domain", host_of("referer"))
    )
    elsewhere = registered_domain("ref_domain", suffixes) != registered_domain("domain", suffixes)
    totals = hosts.groupBy(*REFERER).agg(
        F.max("ref_domain").alias("ref_domain"),
        aggs.uniq("ip_user", approx=approx).alias("ips"),
        F.sum("reqs").alias("reqs"),
        F.sum(F.when(elsewhere, F.col("reqs")).otherwise(0)).alias("reqs_elsewhere"),
    )
    # A referer's hosts are made distinct before they are gathered into its list.
    targets = (
        hosts.select(*REFERER, "hostname")
        .distinct()
        .groupBy(*REFERER)
        .agg(F.array_sort(F.collect_list("hostname")).alias("hosts"))
        .select(
            *REFERER,
            F.size("hosts").cast("bigint").alias("target_hosts"),
            F.array_join("hosts", ",").alias("targets"),
        )
    )
    # Only pages that refer to us have their HTML looked at.
    pages = pages.join(
        totals.select(F.col("referer").alias("url")).distinct(), "url", "left_semi"
    )
    texts = page_texts(pages).withColumnRenamed("url", "referer")
    return totals.join(targets, REFERER).join(texts, "referer", "left").fillna(
        "", ["title", "description"]
    )


def referer_verdict(lists: RefererLists) -> Column:
    """Struct of verdict, type and action; null for clean referers."""
    c = F.col
    domain = registered_domain("ref_domain", lists.suffixes)

    def listed(domains) -> Column:
        return domain.isin(domains)

    def says(verdict: str, kind: str, action: str) -> Column:
        return F.struct(
            F.lit(verdict).alias("verdict"), F.lit(kind).alias("type"), F.lit(action).alias("action")
        )

    adult_domain = any_word("ref_domain", lists.adult)
    bad_page = any_word("title", lists.page) | any_word("description", lists.page)
    unrelated = c("reqs_elsewhere") > lists.high_traffic
    public = F.arrays_overlap(
        F.split(F.lower("ref_domain"), r"\."), F.array(*[F.lit(x) for x in lists.mainstream_labels])
    )
    mainstream = listed(lists.mainstream) | public
    return (
        F.when(listed(lists.spam), says("Suspicious", "Referer Spam", "Block referer"))
        .when(adult_domain, says("Critical", "Adult / Gambling", "Block referer"))
        .when(any_word(query_of("referer"), lists.seo), says("Suspicious", "SEO Injection", "Block referer"))
        .when(listed(lists.social), F.lit(None))
        .when(bad_page, says("Critical", "Content Mismatch", "Block referer"))
        .when(unrelated & listed(lists.portals), says("Suspicious", "Referer Spoofing", "Monitor"))
        .when(mainstream, F.lit(None))
        .when(unrelated, says("Critical", "Compromised Site", "Block referer"))
    )


def referer_threats(profile: DataFrame, lists: RefererLists = RefererLists()) -> DataFrame:
    """Critical and suspicious referers."""
    return (
        profile.withColumn("v", referer_verdict(lists))
        .filter("v IS NOT NULL")
        .select(*REFERER, "reqs", "targets", "v.*")
    )
