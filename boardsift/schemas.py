"""Table schemas."""

from __future__ import annotations

LANDING = (
    "source STRING, board STRING, keyword STRING, ord BIGINT, "
    "fetched_at TIMESTAMP, payload STRING, error STRING, duration_ms BIGINT"
)

LISTING_RAW = (
    "job_id STRING, title STRING, company STRING, location STRING, "
    "description STRING, url STRING, source STRING, posted STRING, "
    "salary STRING, job_type STRING, raw_data STRING, fetched_at TIMESTAMP"
)

LISTING_SCORED = (
    "job_id STRING, title STRING, company STRING, location STRING, "
    "description STRING, url STRING, source STRING, posted STRING, "
    "salary STRING, job_type STRING, status STRING, category STRING, "
    "semantic_score DOUBLE, keyword_score DOUBLE, combined_score DOUBLE, "
    "llm_suitable BOOLEAN, llm_experience_required STRING, llm_reason STRING, "
    "is_india BOOLEAN, is_remote BOOLEAN, city STRING, age_hours DOUBLE, "
    "fetched_at TIMESTAMP, processed_at TIMESTAMP, notified_at TIMESTAMP, "
    "applied_at TIMESTAMP"
)

VERDICT = (
    "job_id STRING, suitable BOOLEAN, experience_required STRING, "
    "reason STRING, confidence DOUBLE"
)

SCAN_HISTORY = (
    "run_id STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
    "total_fetched BIGINT, total_new BIGINT, total_matched BIGINT, "
    "total_filtered_location BIGINT, total_filtered_relevance BIGINT, "
    "total_filtered_llm BIGINT, total_notified BIGINT, best_score DOUBLE, "
    "avg_score DOUBLE, source_counts MAP<STRING,BIGINT>, errors STRING"
)

API_CALLS = "api_name STRING, called_at TIMESTAMP"

STATUS_EVENTS = (
    "job_id STRING, status STRING, at TIMESTAMP, seq BIGINT, extras MAP<STRING,STRING>"
)

OUTBOX = (
    "job_id STRING, combined_score DOUBLE, message STRING, queued_at TIMESTAMP"
)

HISTORY_CSV = "id STRING"

TABLES = {
    "listings": LISTING_SCORED,
    "scan_history": SCAN_HISTORY,
    "api_calls": API_CALLS,
    "status_events": STATUS_EVENTS,
    "outbox": OUTBOX,
}
