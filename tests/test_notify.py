"""Keyed alerts: equal to batch however files land, after a restart, and with state that shrinks."""

import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from boardsift.catalog.fixtures import AS_OF, listings
from boardsift.config import MatchConfig
from boardsift.operators import score
from boardsift.session import settings
from boardsift.streaming import notify, streams

CFG = MatchConfig()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def stream(spark, data, per_batch=1):
    schema = spark.read.parquet(data).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(data)


def states(rows, keep=60, delay="1000 days"):
    return notify.notify_states(rows, AS_OF, CFG, "doc_id", "fetched_at", delay, timedelta(days=keep))


def test_eight_files_and_a_restart_equal_batch(spark, sf_dir, path):
    rows = listings(spark, sf_dir)
    pieces = [rows.filter(F.col("doc_id") % 8 == k) for k in range(8)]
    scored = score.score_listings(rows, AS_OF, CFG).filter(
        (F.col("status") == "detected") & F.col("is_india") & (F.col("combined_score") >= CFG.min_score))
    want = {r.job_id for r in scored.select("job_id").collect()}
    first = {}
    for r in sorted(scored.select("job_id", "doc_id").collect(), key=lambda r: (r.doc_id % 8, r.doc_id)):
        first.setdefault(r.job_id, r.doc_id)
    for k, piece in enumerate(pieces[:5]):
        piece.coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k == 2:  # a run in between, continued from its checkpoint
            notify.run_notify(states(stream(spark, f"{path}/in")), f"{path}/out", f"{path}/check")
    notify.run_notify(states(stream(spark, f"{path}/in")), f"{path}/out", f"{path}/check")
    for piece in pieces[5:]:
        piece.coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = notify.run_notify(states(stream(spark, f"{path}/in", 2)), f"{path}/out", f"{path}/check").collect()
    assert len(out) == len({r.job_id for r in out}) == len(want) > 10 and {r.job_id for r in out} == want
    # within a file the first arrival speaks; files land in turn
    assert sum(first[r.job_id] == r.ord for r in out) >= 0.8 * len(out) and all(r.message for r in out)


def sighting(spark, rows):
    schema = "title string, company string, location string, description string, url string, source string, posted string," \
             " salary string, job_id string, doc_id bigint, fetched_at timestamp"
    base = ("Data Scientist", "C", "Pune", "python sql machine learning pandas tableau power bi statistics " * 2, "u", "s")
    return spark.createDataFrame([(*base[:2], place, *base[3:], "1 hour ago", None, job, k, at) for k, (job, place, at) in
                                  enumerate(rows)], schema.replace("fetched_at timestamp", "at string")).withColumn(
        "fetched_at", F.col("at").cast("timestamp")).drop("at")


def test_detected_becomes_notified_and_is_forgotten(spark, path):
    """Abroad first, then at home: alerted then; seen again after it was forgotten: alerted again."""
    days = [[("a", "Berlin, Germany", "2024-01-01"), ("b", "Pune", "2024-01-01")], [("a", "Pune", "2024-01-02"), ("b", "Pune", "2024-01-02")],
            [("c", "Pune", "2024-03-01")], [("c", "Pune", "2024-03-02")], [("b", "Pune", "2024-03-03"), ("a", "Berlin, Germany", "2024-03-03")]]
    got, sizes = [], []
    for rows in days:
        sighting(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with settings(spark, {"spark.sql.streaming.stateStore.providerClass": notify.STATE_STORE}):
            query = (states(stream(spark, f"{path}/in"), keep=10, delay="1 day").writeStream.format("parquet")
                     .option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
                     .trigger(availableNow=True).start())
            query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["customMetrics"] if query.lastProgress else {})
        got.append(sorted(r.job_id for r in spark.read.schema(notify.ALERT).parquet(f"{path}/out").collect()))
    assert got == [["b"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["a", "b", "b", "c"]]


def test_hot_listing_leaves_a_task_once(spark):
    rows = sighting(spark, [("a", "Pune", "2024-01-01")] * 500).coalesce(2)
    out = notify.sightings(rows, AS_OF, CFG, "doc_id", "fetched_at").collect()
    assert len(out) <= 2 and min(r.ord for r in out) == 0


def test_first_seen_state_falls_after_the_watermark(spark, path):
    df = spark.range(0, 400).selectExpr("id % 100 + 100 * (id div 200) AS k",
                                        "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(id div 100 AS INT) * 10) AS ts")
    for day in range(4):
        df.filter(f"ts = TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, {day * 10})").coalesce(1).write.mode(
            "append").parquet(f"{path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        keys = streams.first_seen_within(source, "k", "ts", "15 days")
        query = (keys.writeStream.format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held == 100  # of 200 keys
    assert spark.read.parquet(f"{path}/out").count() == 200
