"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (table folder) and BENCH_CPUS (local cores) choose the run.
"""

from __future__ import annotations

import json
import os
import time

from eventloom.plans.catalogue import REGISTERED
from eventloom.session import local_session

HEADLINE = (
    "build_rollups",
    "rolling_counts",
    "daily_uniques",
    "hll_uniques",
    "metrics_minute",
    "metrics_hour",
    "metrics_unique",
    "funnel_1h",
    "funnel_1d",
    "funnel_same_event",
    "retention",
    "retention_long",
    "user_profiles",
    "users_page",
    "attach_project",
    "rate_limit",
    "dedup_events",
    "ingest_status",
    "validate_properties",
    "route_valid_rejected",
    "geo_enrich",
    "ua_enrich",
    "sessionize",
    "fixed_ttl_anchor",
    "fixed_ttl_anchor_tree",
    "enrich_project",
    "dlq_current",
    "dlq_retry",
    "stage_rates",
    "lag_p99",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "eventloom-bench")

    def run(name: str) -> float:
        started = time.perf_counter()
        # Every row and column is computed, nothing is returned to the driver.
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # JVM start and first compilation are not part of any query.
    run("metrics_hour")
    timings = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
