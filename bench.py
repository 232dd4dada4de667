"""Time the headline queries and print one JSON line."""

import json
import os
import statistics
import time

from pulseline.plans.registry import QUERIES
from pulseline.session import local_session

HEADLINE = [
    "summary_grand_total",
    "summary_by_host",
    "summary_page",
    "session_detail",
    "session_page",
    "online_by_host",
    "period_totals",
    "period_change",
    "top_hosts",
    "top_sources_domain",
    "top_pages",
    "hourly_trend",
    "device_breakdown",
    "engagement",
    "daily_report_totals",
    "weekly_by_host",
    "window_stats",
    "realtime_by_host",
    "session_summary_by_host",
    "daily_rollup",
    "daily_rollup_sketch",
    "online_slots",
    "first_seen",
    "ip_profile",
    "ip_threats",
    "journeys_one_day",
    "journey_threats",
    "url_clusters",
    "referer_profile",
    "alerts_dedupe",
    "normalized_events",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")

    def once(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        once(name)
    seconds = {
        name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in HEADLINE
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
