"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Each query runs
once to warm up and is then timed writing to the ``noop`` sink, so that every
column of the result is computed.
"""

from __future__ import annotations

import json
import os
import time

from boardsift.catalog import queries
from boardsift.session import local_session

HEADLINE = [
    "listing_clean", "match_text", "age_hours_v2", "location_class", "title_relevance",
    "category_rules", "experience_filter", "keyword_score_v2", "combined_score_status",
    "tfidf_pair_score", "semantic_max_profile", "dedup_first_wins", "new_listings_anti",
    "per_source_cap", "verdict_merge", "top_matches", "notify_once", "tagged_top", "funnel_stats",
    "stats_object", "status_latest", "retention_survivors", "api_usage_monthly", "rotation_slice",
    "html_extract", "normalize_remoteok", "normalize_jobicy", "normalize_wwremotely",
    "normalize_hn_hiring", "normalize_linkedin", "stream_tumbling", "stream_first_seen",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
