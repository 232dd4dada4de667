"""Text expressions: hosts, paths, clipping and the fixed match patterns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide which rows match.
BOT_KEYWORDS = ["bot", "spider", "crawl", "slurp", "bingpreview", "googlebot", "yahoo"]
MOBILE_PATTERN = r"(?i)(Mobile|Android|iPhone|iPad)"
SENSITIVE_PATTERN = r"(?i)(/admin|wp-admin|\.env|\.git|\.bak|/config|phpinfo|\.sql|\.dump)"
ATTACK_PATTERN = (
    r"(?i)(union%20select|<script>|alert\(|eval\(|document\.cookie|\.\./|etc/passwd|1=1)"
)
DIRECT_SOURCE = "Direct / Bookmark"

HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_PATTERN = r"\?([^#]*)"
REGISTERED_PATTERN = r"([^.]+\.[^.]+)$"
THREE_LABEL_PATTERN = r"([^.]+\.[^.]+\.[^.]+)$"
# Second-level names under which a country registers domains.
TWO_LEVEL_SUFFIXES = [
    f"{second}.{country}"
    for country, seconds in {
        "uk": "ac co gov ltd me net nhs org plc sch",
        "vn": "ac biz com edu gov health info int name net org pro",
        "au": "asn com edu gov id net org",
        "br": "com edu gov mil net org",
        "cn": "ac com edu gov net org",
        "hk": "com edu gov idv net org",
        "id": "ac co desa go mil my net or sch web",
        "in": "ac co edu firm gen gov ind net nic org res",
        "jp": "ac ad co ed go gr lg ne or",
        "kr": "ac co go ne or re",
        "my": "com edu gov mil name net org",
        "nz": "ac co geek gen govt net org school",
        "ph": "com edu gov mil net ngo org",
        "sg": "com edu gov net org per",
        "th": "ac co go in mi net or",
        "tr": "av bel com edu gov net org",
        "tw": "com edu gov idv net org",
        "za": "ac co edu gov net org web",
    }.items()
    for second in seconds.split()
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url) -> Column:
    """Host of a URL, '' when there is none."""
    return F.regexp_extract(_col(url), HOST_PATTERN, 1)


def path_of(url) -> Column:
    """Path of a URL without query and fragment; '/' for the bare host."""
    path = F.regexp_extract(_col(url), PATH_PATTERN, 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_of(url) -> Column:
    return F.regexp_extract(_col(url), QUERY_PATTERN, 1)


def registered_domain(host, suffixes=TWO_LEVEL_SUFFIXES) -> Column:
    """The last two labels of a host name, three below a two-level suffix, or all it has."""
    h = F.lower(_col(host))
    last_two = F.regexp_extract(h, REGISTERED_PATTERN, 1)
    last_three = F.regexp_extract(h, THREE_LABEL_PATTERN, 1)
    return (
        F.when(last_two == "", h)
        .when(last_two.isin(list(suffixes)) & (last_three != ""), last_three)
        .otherwise(last_two)
    )


def bot_flag(user_agent) -> Column:
    """1 when the user agent names a crawler, else 0."""
    return F.lower(F.coalesce(_col(user_agent), F.lit(""))).rlike("|".join(BOT_KEYWORDS)).cast("int")


def device_of(user_agent) -> Column:
    return F.when(_col(user_agent).rlike(MOBILE_PATTERN), "Mobile").otherwise("Desktop")


def is_sensitive(url) -> Column:
    return _col(url).rlike(SENSITIVE_PATTERN)


def is_attack(url) -> Column:
    return _col(url).rlike(ATTACK_PATTERN)


def blank(c) -> Column:
    return F.coalesce(_col(c), F.lit("")) == ""


def clip(c, length: int, suffix: str) -> Column:
    """Text cut to ``length`` characters, with ``suffix`` only if something was cut."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(suffix))).otherwise(text)


def any_word(c, words) -> Column:
    """Case-insensitive: the column contains one of the literal words."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word.lower())
    return found
