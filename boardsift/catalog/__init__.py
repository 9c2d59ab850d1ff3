"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from functools import wraps


def _parts():
    from boardsift.catalog import listing_queries, payload_queries, stream_queries

    return [listing_queries, payload_queries, stream_queries]


def _in_utc(query):
    """Posting times and windows are read in UTC, whatever the session's zone is."""

    @wraps(query)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _in_utc(v) for part in _parts() for k, v in part.QUERIES.items()}


def oracles() -> dict:
    return {k: v for part in _parts() for k, v in part.ORACLES.items()}
