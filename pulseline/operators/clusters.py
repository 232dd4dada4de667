"""URL clusters: traffic per host and path, and verdicts on coordinated access."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.text import any_word, path_of

# Path words of the cluster rules.
SENSITIVE_PATHS = ["/admin", "/login", "/api/v1/users"]
CONTENT_WORDS = ["news", "video", "stream", "product", "truc-tiep"]
STATIC_PATTERN = r"(?i)\.(css|js|jpg)$"

CLUSTER = ["date_num", "hostname", "path"]


@dataclass(frozen=True)
class ClusterThresholds:
    """Limits of the cluster rules; the defaults are fixed values but for the sensitive requests."""

    ips: int = 1000
    agents: int = 5
    sensitive_requests: int = 100
    diverse_share: float = 0.2


def url_clusters(ua: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct addresses, agents and referers per day, host and path.

    Requests are folded per address, agent and referer first, which spreads a busy path.
    ``approx`` counts distincts by sketches, which copies no row.
    """
    paths = ua.withColumn("path", path_of("url"))
    folded = aggs.fold(paths, *CLUSTER, "ip_user", "browser", "referer")
    return (
        folded.groupBy(*CLUSTER)
        .agg(
            aggs.uniq("ip_user", approx=approx).alias("distinct_ips"),
            F.sum("hits").alias("reqs"),
            aggs.uniq("browser", approx=approx).alias("distinct_uas"),
            aggs.uniq(F.nullif("referer", F.lit("")), approx=approx).alias("distinct_refs"),
            aggs.first_of("browser", "referer").alias("sample"),
        )
        .withColumns(
            {"ua_sample": F.col("sample.browser"), "ref_sample": F.col("sample.referer")}
        )
        .drop("sample")
    )


def cluster_verdict(limits: ClusterThresholds = ClusterThresholds()) -> Column:
    """Struct of verdict and threat type; safe traffic is recognised first."""
    c = F.col
    diverse = c("distinct_uas") > limits.diverse_share * c("distinct_ips")
    safe = (
        ((c("distinct_ips") >= limits.ips) & diverse & any_word("path", CONTENT_WORDS))
        | (c("path") == "/")
        | c("path").rlike(STATIC_PATTERN)
    )
    crowd = c("distinct_ips") >= limits.ips
    botnet = crowd & ((c("distinct_uas") <= limits.agents) | (c("distinct_refs") == 0))
    targeting = any_word("path", SENSITIVE_PATHS) & (c("reqs") >= limits.sensitive_requests)

    def says(verdict: str, threat: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(threat).alias("threat_type"))

    return (
        F.when(safe, says("Safe", "Normal"))
        .when(botnet, says("Critical", "DDoS / Botnet"))
        .when(targeting, says("Suspicious", "Mass Targeting"))
        .otherwise(says("Safe", "Normal"))
    )


def url_cluster_threats(clusters: DataFrame, limits: ClusterThresholds = ClusterThresholds()) -> DataFrame:
    """Clusters that look like an attack."""
    return (
        clusters.withColumn("v", cluster_verdict(limits))
        .filter("v.verdict <> 'Safe'")
        .select(*CLUSTER, "distinct_ips", "reqs", "v.verdict", "v.threat_type")
    )
