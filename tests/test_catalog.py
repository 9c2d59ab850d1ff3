"""Registered queries against their SQL.  ALL_QUERIES=1 runs every one."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SHORT = ["listing_clean", "combined_score_status", "tfidf_pair_score", "verdict_merge", "notify_once",
         "funnel_stats", "stats_object", "status_latest", "normalize_jobicy", "normalize_wwremotely",
         "stream_tumbling", "embed_distinct", "classify_stub", "history_csv"]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SHORT


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v

    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(rel.columns, rel.fetchall())
    assert got


def test_flagship(spark):
    assert entry.entry(spark).count() == 15
