"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs up to $BENCH_RUNS times (3); the best time counts, so that start-up and
code generation of the first run stay out. ``cold`` holds the first times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "visitor_tokens", "build_events", "scrub_documents", "scrub_pages", "scrub_props", "kanon_bucket", "kanon_arrival",
    "kanon_arrival_ttl", "daily_totals", "daily_dimensions", "daily_top_keys", "daily_report", "released_top_pages",
    "resolve_trackers", "resolve_custom", "effective_config", "intercept_requests", "page_resources", "protection_counters",
    "strip_urls", "ga4_params", "usage_monthly", "feed_totals", "feed_breakdown", "leakage_verdict", "rate_limit_fixed",
    "rate_limit_renewing", "suspicious_sources", "authenticated_requests", "revoked_filter", "domain_lock", "customer_view",
    "erased_users", "cascade_feed", "purge_expired", "stream_usage", "stream_rollup",
]


def main() -> None:
    from kveil.plans.registry import QUERIES
    from kveil.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "kveil-bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1).count()
    times, cold = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for run in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = round(time.time() - start, 3)
            cold.setdefault(name, took)
            times[name] = min(took, times.get(name, took))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
