"""The plans Spark picks, since those decide whether a query scales."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from boardsift.catalog import queries
from boardsift.operators import dedup, report
from boardsift.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def of(spark, sf_dir, name):
    return plan(queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", [
    "combined_score_status", "listing_clean", "experience_filter", "tfidf_pair_score", "top_matches",
    "verdict_merge", "funnel_stats", "normalize_remoteok", "notify_once", "semantic_max_profile"])
def test_no_python_in_the_core(spark, sf_dir, name):
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", of(spark, sf_dir, name))


@pytest.mark.parametrize("name", [
    "dedup_first_wins", "per_source_cap", "top_matches", "normalize_jobicy", "new_listings_anti"])
def test_groups_are_cut_before_the_shuffle(spark, sf_dir, name):
    text = of(spark, sf_dir, name)
    assert len(re.findall("WindowGroupLimit", text)) >= 2 and "Partial" in text


@pytest.mark.parametrize("name", [n for n in [
    "stats_object", "tagged_configs", "semantic_max_profile", "funnel_stats", "quota_gate",
    "rotation_slice", "tfidf_pair_score", "combined_score_status"]])
def test_no_cross_joins(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", of(spark, sf_dir, name))


@pytest.mark.parametrize("name", [
    "listing_clean", "match_text", "age_hours_v2", "combined_score_status", "tfidf_pair_score",
    "normalize_cutshort", "normalize_hn_hiring", "html_extract"])
def test_row_local_work_does_not_shuffle_by_content(spark, sf_dir, name):
    exchanges = re.findall(r"Exchange (\w+\([^)]*\))", of(spark, sf_dir, name))
    assert all("doc_id" in e for e in exchanges)  # at most the spreading of one small file


def moved(df):
    """Names of the columns in each exchange of a plan."""
    explain = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#\d+", m)) for m in re.findall(
        r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", explain)]


@pytest.mark.parametrize("name", ["top_matches", "top_descriptions", "by_status_top", "notify_once", "mark_notified"])
def test_top_lists_move_no_descriptions(spark, sf_dir, name):
    exchanges = moved(queries()[name](spark, sf_dir))
    assert exchanges and not any("description" in columns for columns in exchanges)


def test_copies_are_not_scored(spark, sf_dir):
    text = of(spark, sf_dir, "top_matches")
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_scores_are_made_once(spark, sf_dir):
    assert "documents.parquet" not in of(spark, sf_dir, "mark_notified")  # it reads what was scored before


def test_leading_rows_are_those_first_wins_picks(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, None, "w"), ("b", 5, "v"), ("b", 5, "u")],
                                 "k string, o int, t string")
    want = [("a", 1, "y"), ("b", 5, "u"), ("b", 5, "v"), (None, None, "w")]
    assert sorted(map(tuple, dedup.leading(rows, ["k"], ["o"]).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(dedup, "SENT_KEYS", 2)
    assert dedup.leading(rows, ["k"], ["o"]).count() == 6  # too many keys to send: all rows stay


def test_short_list_goes_to_the_rows(spark):
    rows = spark.range(1000).selectExpr("id", "repeat('x', 1000) AS text")
    top = rows.orderBy(F.desc("id")).select("id").limit(5)
    found = report.with_rows(top, rows, ["id"])
    assert "BroadcastHashJoin" in plan(found) and not any("text" in columns for columns in moved(found))
    assert sorted(r.id for r in found.collect()) == list(range(995, 1000))


def test_quota_cuts_payloads_per_task(spark):
    landing = spark.range(1000).selectExpr(
        "IF(id % 2 = 0, 's', 'x') AS source", "CAST(NULL AS STRING) AS board", "CAST(NULL AS STRING) AS keyword", "id AS ord",
        "CAST(NULL AS TIMESTAMP) AS fetched_at", "repeat('x', 1000) AS payload")
    calls = spark.createDataFrame([], "api_name STRING, called_at TIMESTAMP")
    found = report.within_quota(landing, calls, [report.Quota("a", ("s",), 10)], "2024-01-31")
    assert "Partial" in plan(found) and len(re.findall("WindowGroupLimit", plan(found))) >= 2
    assert sorted(r.ord for r in found.collect()) == [0, 2, 4]


def test_top_k_is_bounded_per_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in of(spark, sf_dir, "top_matches")


def test_key_scan_reads_one_column(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.create_tables(spark, root)
    schema = re.search(r"ReadSchema: (\S+)", plan(tables.known_ids(spark, root))).group(1)
    assert schema == "struct<job_id:string>"


def test_anti_join_after_first_wins_shares_its_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = spark.range(1000).selectExpr("CAST(id % 50 AS STRING) AS job_id", "id AS ord")
        known = spark.range(100).selectExpr("CAST(id AS STRING) AS job_id")
        text = plan(dedup.fresh_listings(ids, known, ["ord"]))
        assert text.count("Exchange hashpartitioning") == 2  # one per side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_history_is_not_shuffled(spark):
    name = "history_" + uuid.uuid4().hex
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = spark.range(100).selectExpr("CAST(id AS STRING) AS job_id")
        tables.save_key_table(known, name, 4)
        ids = spark.range(1000).selectExpr("CAST(id % 500 AS STRING) AS job_id", "id AS ord")
        fresh = dedup.new_only(ids, spark.table(name))
        assert plan(fresh).count("Exchange hashpartitioning") == 1
        assert fresh.count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_scan_is_pruned(spark, sf_dir):
    text = of(spark, sf_dir, "stats_by_source")
    assert "ReadSchema: struct<source:string>" in text
