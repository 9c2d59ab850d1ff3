import datetime as dt

import pytest
from pyspark.sql import functions as F

from boardsift.config import MatchConfig
from boardsift.operators import dedup, report, state

LISTING = "job_id STRING, status STRING, fetched_at TIMESTAMP, notified_at TIMESTAMP, applied_at TIMESTAMP"
EVENT = "job_id STRING, status STRING, at TIMESTAMP, seq BIGINT"


def day(d, month=1):
    return dt.datetime(2024, month, d)


def test_first_wins_is_idempotent_and_keeps_the_first(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate("abacabba")], "k STRING, i INT")
    one = dedup.first_wins(df, ["k"], ["i"])
    assert sorted(map(tuple, one.collect())) == [("a", 0), ("b", 1), ("c", 3)]
    assert sorted(dedup.first_wins(one, ["k"], ["i"]).collect()) == sorted(one.collect())


def test_cap_keeps_a_hot_group_exact(spark):
    df = spark.range(0, 3000, 1, 8).select((F.col("id") % 3 == 0).alias("hot"), "id")
    got = dedup.cap_per_group(df, ["hot"], ["id"], 5).orderBy("hot", "id").collect()
    assert [r.id for r in got] == [1, 2, 4, 5, 7, 0, 3, 6, 9, 12]


def test_new_and_known_split_the_batch(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id STRING")
    known = spark.createDataFrame([("b",), ("b",), ("x",)], "job_id STRING")
    new = [r[0] for r in dedup.new_only(batch, known).collect()]
    old = [r[0] for r in dedup.known_only(batch, known).collect()]
    assert sorted(new) == ["a", "c"] and old == ["b"]


def test_latest_status_and_overlay(spark):
    events = spark.createDataFrame([
        ("a", "notified", day(2), 1), ("a", "applied", day(3), 1), ("a", "detected", day(3), 2),
        ("b", "notified", day(5), 1)], EVENT)
    last = {r.job_id: r for r in state.latest_status(events).collect()}
    assert last["a"].status == "detected" and last["a"].applied_at == day(3)
    stored = spark.createDataFrame([(k, "filtered", day(1), None, None) for k in "abc"], LISTING)
    got = {r.job_id: (r.status, r.notified_at) for r in state.with_current_status(stored, events).collect()}
    assert got == {"a": ("detected", day(2)), "b": ("notified", day(5)), "c": ("filtered", None)}


def test_status_domain(spark):
    ids = spark.createDataFrame([("a",)], "job_id STRING")
    assert state.status_events(ids, "applied", "2024-01-01").first().status == "applied"
    with pytest.raises(ValueError):
        state.status_events(ids, "lost", "2024-01-01")


NOTED = EVENT + ", extras MAP<STRING,STRING>"


def noted(spark):
    return spark.createDataFrame([
        ("a", "detected", day(1), 1, {"reason": "one", "city": "Pune"}),
        ("a", "notified", day(2), 1, {"reason": "two"}),
        ("a", "applied", day(3), 1, None),
        ("a", "detected", day(3), 2, {"reason": None, "score": "0.5"}),
        ("a", "detected", day(3), 2, {"reason": None, "score": "0.5"}),
        ("b", "notified", day(5), 1, {}),
        ("c", "filtered", None, None, {"score": "no number", "unknown": "x"})], NOTED)


def test_extras_are_merged_field_by_field(spark):
    got = {r.job_id: r.extras for r in state.latest_extras(noted(spark)).collect()}
    assert got == {"a": {"city": "Pune", "reason": None, "score": "0.5"}, "c": {"score": "no number", "unknown": "x"}}
    stored = spark.createDataFrame(
        [(k, "detected", None, None, "old", "Berlin", 0.1) for k in "abcd"],
        "job_id STRING, status STRING, notified_at TIMESTAMP, applied_at TIMESTAMP, reason STRING, city STRING, score DOUBLE")
    rows = {r.job_id: (r.status, r.reason, r.city, r.score)
            for r in state.with_current_status(stored, noted(spark)).collect()}
    assert rows == {"a": ("detected", None, "Pune", 0.5), "b": ("notified", "old", "Berlin", 0.1),
                    "c": ("filtered", "old", "Berlin", None), "d": ("detected", "old", "Berlin", 0.1)}


def test_folding_keeps_every_state(spark):
    """Random logs, cut at random: folded early, folded twice, and mixed with what was folded."""
    random = __import__("random").Random(5)
    rows = [(random.choice("abc"), random.choice(["detected", "notified", "applied", "rejected"]),
             day(random.randint(1, 5)), random.randint(1, 4),
             {random.choice("xy"): random.choice(["1", "2", None])} if random.random() < 0.6 else None) for _ in range(120)]
    events = spark.createDataFrame(rows, NOTED)

    def states(df):
        return sorted(map(str, state.latest_status(df).collect())), sorted(map(str, state.latest_extras(df).collect()))

    want, once = states(events), state.folded(events)
    early, late = spark.createDataFrame(rows[:50], NOTED), spark.createDataFrame(rows[50:], NOTED)
    assert once.count() <= 3 * 5 and states(once) == want
    assert states(state.folded(once)) == want and state.folded(once).count() == once.count()
    assert states(state.folded(early).union(late)) == want == states(once.union(early))
    assert state.folded(events.limit(0)).count() == 0


def test_events_carry_extras(spark):
    ids = spark.createDataFrame([("a", 3)], "job_id STRING, n INT")
    event = state.status_events(ids, "applied", "2024-01-01", {"n": F.col("n"), "reason": F.lit(None)}).first()
    assert event.extras == {"n": "3", "reason": None}


def test_quota_of_a_run(spark):
    landing = spark.createDataFrame(
        [("s1", i, day(20)) for i in range(4)] + [("s2", 10, day(20)), ("t", 11, day(20)), ("free", 12, None), (None, 13, None)],
        "source STRING, ord BIGINT, fetched_at TIMESTAMP").selectExpr("*", "CAST(NULL AS STRING) AS board", "'k' AS keyword")
    calls = spark.createDataFrame([("s", day(3)), ("t", day(4)), ("t", day(5)), ("s", day(30, 12))],
                                  "api_name STRING, called_at TIMESTAMP")
    quotas = [report.Quota("s", ("s1", "s2"), 3, 5), report.Quota("t", ("t",), 2)]
    paid = report.within_quota(landing, calls, quotas, "2024-01-31")
    assert paid.columns == landing.columns and sorted(r.ord for r in paid.collect()) == [0, 1]
    assert sorted(r.ord for r in report.unmetered(landing, quotas).collect()) == [12, 13]
    assert [(r.api_name, r.called_at) for r in report.call_events(paid, quotas, "2024-01-31").collect()] == [("s", day(20))] * 2


def test_retention(spark):
    rows = [("old", "detected", day(1)), ("kept", "notified", day(1)), ("edge", "filtered", day(2)),
            ("new", "filtered", day(30)), ("none", None, day(1)), ("untimed", "filtered", None)]
    df = spark.createDataFrame(rows, "job_id STRING, status STRING, fetched_at TIMESTAMP")
    kept = sorted(r[0] for r in state.survivors(df, "2024-02-01", 30).collect())
    assert kept == ["edge", "kept", "new", "none", "untimed"]
    assert state.expired_count(df, "2024-02-01", 30).first()[0] == 1


def test_verdicts_last_wins_and_default(spark):
    scored = spark.createDataFrame(
        [("a", "detected", None), ("b", "detected", None), ("c", "filtered", "age")],
        "job_id STRING, status STRING, filter_reason STRING")
    verdicts = spark.createDataFrame([
        ("a", True, "x", "first", 0.8, 1), ("a", False, None, "second", 0.8, 2), ("c", True, "y", "z", 0.8, 1)],
        "job_id STRING, suitable BOOLEAN, experience_required STRING, reason STRING, confidence DOUBLE, seq INT")
    got = {r.job_id: (r.status, r.llm_suitable, r.llm_reason, r.filter_reason)
           for r in state.apply_verdicts(scored, state.last_verdicts(verdicts)).collect()}
    assert got == {"a": ("filtered", False, "second", "experience"),
                   "b": ("detected", None, None, None), "c": ("filtered", None, None, "age")}


def test_empty_inputs_give_zero_statistics(spark):
    empty = spark.createDataFrame([], "job_id STRING, status STRING, source STRING, is_india BOOLEAN,"
                                      " combined_score DOUBLE, age_hours DOUBLE, filter_reason STRING")
    row = report.funnel(empty, MatchConfig()).first()
    assert (row.total_new, row.best_score, row.avg_score) == (0, 0.0, 0.0)
    stats = report.stats_object(empty).first()
    assert (stats.total_jobs, stats.avg_score, stats.by_status) == (0, 0.0, {})


def test_usage_and_gate(spark):
    calls = spark.createDataFrame([("s", day(3)), ("s", day(4)), ("s", day(4, 2))],
                                  "api_name STRING, called_at TIMESTAMP")
    apis = spark.createDataFrame([("s",), ("t",)], "api_name STRING")
    got = {r.api_name: (r.call_count, r.remaining, r.allowed, r.open) for r in report.quota_gate(
        report.usage(calls, apis, "2024-01-31"), limit=4).collect()}
    assert got == {"s": (2, 2, 2, True), "t": (0, 4, 3, True)}
    full = report.quota_gate(report.usage(calls, apis, "2024-01-31"), limit=2)
    assert full.filter("api_name = 's'").first().open is False


@pytest.mark.parametrize("at,want", [
    ("2024-01-01 00:00:00", range(0, 15)), ("2024-01-01 01:16:00", range(75, 90)),
    ("2024-01-01 02:00:00", range(120, 129)), ("2024-01-01 03:59:00", range(0, 15))])
def test_rotation(spark, at, want):
    boards = spark.range(129).select(F.col("id").cast("int").alias("pos"))
    got = report.rotation_slice(boards, 129, F.lit(at).cast("timestamp"), report.ROTATIONS["greenhouse"])
    assert sorted(r.pos for r in got.collect()) == list(want)


def test_run_seconds(spark):
    df = spark.createDataFrame([(day(1), day(2)), (day(1), None)], "s TIMESTAMP, e TIMESTAMP")
    got = df.select(report.run_seconds(F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in got] == [86400.0, 0.0]
