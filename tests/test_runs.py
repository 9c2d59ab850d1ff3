"""Tables, whole runs and streams, on files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from boardsift.config import MatchConfig, TaggedConfig
from boardsift.operators import dedup, report, semantic, state
from boardsift.plans import scan
from boardsift.plans.scan import run_scan
from boardsift.plans.tagged import run_tagged_scan
from boardsift.plugins import classify, with_embedding
from boardsift.schemas import LANDING
from boardsift.sources import tables
from boardsift.sources.specs import SPECS
from boardsift.streaming import streams

AS_OF = "2024-01-31 00:00:00"
SPECS_USED = [SPECS["Arbeitnow"], SPECS["Remotive"]]
LONG = "python sql machine learning pandas tableau power bi statistics " * 2


def landing(spark, names, source="Arbeitnow", start=0):
    rows = []
    for i, name in enumerate(names, start):
        job = {"title": name, "company_name": "C", "location": "Pune", "description": LONG,
               "candidate_required_location": "Remote", "created_at": "1 hour ago", "url": f"http://{i}"}
        body = {"data": [job], "jobs": [job]}
        rows.append((source, None, None, i, None, json.dumps(body), None, 3))
    return spark.createDataFrame(rows, LANDING)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_history_versions(spark, root):
    assert tables.read_history(spark, root).count() == 0
    ids = spark.createDataFrame([("a",), ("007",)], "id STRING")
    tables.save_history(ids, root)
    tables.save_history(tables.read_history(spark, root).union(
        spark.createDataFrame([("b",)], "id STRING")), root)
    assert sorted(r.id for r in tables.read_history(spark, root).collect()) == ["007", "a", "b"]


def test_history_additions(spark, root):
    """A version costs its own ids only; one that broke off is not read, its number is not used again."""
    def ids(*x):
        return spark.createDataFrame([(i,) for i in x], "id STRING")

    tables.save_history(ids("a", "007"), root)
    tables.append_history(ids("b"), root)
    tables.append_history(ids("broken"), root)
    tables.files.remove(spark, f"{root}/d00000003/_SUCCESS")
    index = tables.history_index(spark, root)
    new = dedup.new_only(ids("a", "b", "c", "broken"), index, "id")
    tables.append_history(new, root)
    assert sorted(r.id for r in tables.read_history(spark, root).collect()) == ["007", "a", "b", "broken", "c"]
    assert sorted(r.id for r in spark.read.option("header", True).csv(f"{root}/d00000004").collect()) == ["broken", "c"]
    again = tables.history_index(spark, root)
    assert again.known_among(ids("a", "007", "b", "c", "broken", "d"), "id").count() == 5
    tables.save_history(tables.read_history(spark, root), root)
    tables.append_history(ids("e"), root)
    assert tables.read_history(spark, root).count() == 6


def test_history_without_id_is_empty(spark, root):
    spark.createDataFrame([("a",)], "other STRING").write.option("header", True).csv(f"{root}/v00000001")
    assert tables.read_history(spark, root).count() == 0


def test_create_tables_keeps_rows(spark, root):
    tables.create_tables(spark, root)
    ids = spark.createDataFrame([("a",)], "job_id STRING")
    tables.write_part(state.status_events(ids, "notified", AS_OF), root, "status_events", "one")
    tables.create_tables(spark, root)
    assert tables.read_table(spark, root, "status_events").count() == 1
    assert tables.known_ids(spark, root).count() == 0


def test_folded_log_replaces_its_parts(spark, root):
    tables.create_tables(spark, root)
    ids = spark.createDataFrame([("a",), ("b",)], "job_id STRING")
    for k, status in enumerate(["detected", "notified", "applied", "detected"]):
        tables.write_part(state.status_events(ids, status, f"2024-01-0{k + 1}", {"n": F.lit(k)}), root, "status_events", str(k))
    tables.write_part(state.status_events(ids, "rejected", "2024-01-09"), root, "status_events", "broken")
    tables.files.remove(spark, f"{root}/status_events/part=broken/_SUCCESS")
    assert tables.fold_status(spark, root) == 5
    left = tables.files.children(spark, f"{root}/status_events")
    assert len([p for p in left if p.startswith("part=")]) == 2 and "part=broken" in left
    log = tables.read_table(spark, root, "status_events").filter("status <> 'rejected'")
    assert log.count() == 6
    tables.fold_status(spark, root)
    log = tables.read_table(spark, root, "status_events").filter("status <> 'rejected'")
    row = state.latest_status(log).filter("job_id = 'a'").first()
    assert row.status == "detected" and row.notified_at.day == 2 and row.applied_at.day == 3
    assert {r.extras["n"] for r in state.latest_extras(tables.read_table(spark, root, "status_events")).collect()} == {"3"}


def test_run_stops_reading_a_used_up_api(spark, root):
    quota = [report.Quota("api", ("Remotive",), 3, 2)]
    free = landing(spark, ["Data Scientist"])

    def run(name, start):
        paid = landing(spark, [f"Data Analyst {start + i}" for i in range(4)], "Remotive", start)
        found = run_scan(spark, free.union(paid), root, name, AS_OF, SPECS_USED, quotas=quota)
        return found.history.first().total_fetched, tables.read_table(spark, root, "api_calls").count()

    assert run("run1", 10) == (3, 2)
    assert run("run1", 10) == (3, 2)  # a repeated run makes no new calls
    assert run("run2", 20) == (2, 3)
    assert run("run3", 30) == (1, 3)


def test_run_is_incremental_and_restartable(spark, root):
    first = landing(spark, ["Data Scientist", "Chef", "Data Scientist", "Data Analyst"])
    first = first.union(landing(spark, ["Junior Data Analyst"], "Remotive", 4))
    one = run_scan(spark, first, root, "run1", AS_OF, SPECS_USED)
    assert sorted(r.title for r in one.scored.collect()) == [
        "Chef", "Data Analyst", "Data Scientist", "Junior Data Analyst"]
    assert one.outbox.count() == 3
    stats = one.history.first()
    assert (stats.total_fetched, stats.total_new, stats.total_matched, stats.total_notified) == (5, 4, 3, 3)
    assert stats.source_counts == {"Arbeitnow": 4, "Remotive": 1}

    again = run_scan(spark, first, root, "run1", AS_OF, SPECS_USED)
    assert again.scored.count() == 4 and again.outbox.count() == 3
    assert tables.known_ids(spark, root).count() == 4

    two = run_scan(spark, first.union(landing(spark, ["ML Engineer"], start=9)), root, "run2", AS_OF, SPECS_USED)
    assert [r.title for r in two.scored.collect()] == ["ML Engineer"]
    assert two.outbox.count() == 1
    ids = tables.known_ids(spark, root)
    assert ids.count() == ids.distinct().count() == 5
    assert tables.read_table(spark, root, "outbox").count() == 4


def test_no_match_and_no_payload_is_lost(spark, root):
    many = landing(spark, [f"Data Analyst {i}" for i in range(20)])
    broken = many.limit(1).withColumn("payload", F.lit('{"message": "quota exceeded"}')).withColumn(
        "ord", F.lit(999).cast(dict(many.dtypes)["ord"]))
    one = run_scan(spark, many.union(broken), root, "run1", AS_OF, SPECS_USED)
    assert one.outbox.count() == 20 and one.quarantined.count() == 1
    first = scan.sender_batch(spark, root, 15)
    scan.mark_sent(first, root, "sent1", AS_OF)
    assert scan.sender_batch(spark, root, 15).count() == 5


def test_landing_is_pruned_by_board(spark, root):
    tables.write_landing(landing(spark, ["Data"]).union(landing(spark, ["Data"], "Remotive")), root)
    rows = tables.read_landing(spark, root).filter("source = 'Remotive'")
    assert rows.count() == 1 and all("source=Remotive" in f for f in rows.inputFiles() if "Remotive" in f)
    assert "PartitionFilters: [isnotnull(source" in rows._jdf.queryExecution().executedPlan().toString()


def test_tagged_run(spark, root):
    rows = [(t, "C", "Pune", LONG, "S", p, "http://u") for t, p in (
        ("Data Scientist", "1 hour ago"), ("Data Analyst", "2 days ago"), ("Cook", "now"),
        ("BI Developer", "today"))]
    df = spark.createDataFrame(rows, "title STRING, company STRING, location STRING,"
                                     " description STRING, source STRING, posted STRING, url STRING")
    profiles = {tag: "python sql statistics tableau" for tag in TaggedConfig().tags}
    cfg = TaggedConfig(alerts=2)
    first = run_tagged_scan(df, f"{root}/history", f"{root}/one", AS_OF, profiles, cfg)
    stats = first.stats.first()
    # Every fresh text names machine learning and tableau: two tags each.
    assert stats.total_new == stats.total_matched == 6 and first.alerts.count() == 2
    assert first.alerts.first().message.startswith("🎯 <b>")
    told = first.alerts.select("job_id_v1").distinct().count()
    again = run_tagged_scan(df, f"{root}/history", f"{root}/one", AS_OF, profiles, cfg)
    assert again.alerts.count() == 2
    second = run_tagged_scan(df, f"{root}/history", f"{root}/two", AS_OF, profiles, cfg)
    assert second.stats.first().total_new == 6 - 2 * told
    assert tables.read_history(spark, f"{root}/history").count() >= told


def test_run_with_models(spark, root):
    def embedder():
        return lambda texts: [[1.0, 0.0] if "ml" in t else [0.0, 1.0] for t in texts]

    def classifier():
        return lambda prompt: '{"suitable_for_junior": %s}' % str("Analyst" not in prompt).lower()

    rows = landing(spark, ["ML Engineer", "Data Analyst"])
    got = run_scan(spark, rows, root, "r", AS_OF, SPECS_USED, profiles=[[1.0, 0.0]],
                   embedder=embedder, classifier=classifier)
    by = {r.title: r for r in got.scored.collect()}
    assert by["ML Engineer"].semantic_score == 1.0 and by["ML Engineer"].llm_suitable is True
    assert by["Data Analyst"].semantic_score == 0.0


def stored(spark, root, rows, part):
    df = spark.createDataFrame(rows, "job_id STRING, status STRING, at STRING").withColumn(
        "fetched_at", F.col("at").cast("timestamp"))
    tables.insert_new(spark, df, root, ["at"], part)


def test_retirement_touches_only_what_expires(spark, root):
    tables.create_tables(spark, root)
    stored(spark, root, [("a", "detected", "2023-01-01 05:00:00"), ("b", "notified", "2023-01-01 06:00:00"),
                         ("c", "detected", "2024-01-30 00:00:00"), ("d", "filtered", "2023-05-05 00:00:00"),
                         ("e", "detected", "2024-01-01 01:00:00"), ("f", "detected", None),
                         ("g", "detected", "2023-06-01 00:00:00")], "one")
    stored(spark, root, [("h", "applied", "2023-01-01 07:00:00"), ("i", "detected", "2023-12-31 23:00:00")], "two")
    ids = spark.createDataFrame([("g",)], "job_id STRING")
    tables.write_part(state.status_events(ids, "applied", "2023-06-02"), root, "status_events", "one")

    def files():
        rows = tables.read_table(spark, root, "listings").select("job_id", "_metadata.file_path", "_metadata.file_modification_time")
        return {r.job_id: tuple(r) for r in rows.collect()}

    before = files()
    assert tables.retire(spark, root, AS_OF) == 3
    after = files()
    assert sorted(after) == ["b", "c", "e", "f", "g", "h"]
    assert all(before[k] == after[k] for k in "cefgh") and before["b"] != after["b"]
    assert tables.retire(spark, root, AS_OF) == 0 and files() == after
    # what went is new again, what stayed is not
    stored(spark, root, [("a", "detected", "2024-01-30 00:00:00"), ("b", "detected", "2024-01-30 00:00:00")], "three")
    assert len(files()) == 7 and files()["b"] == after["b"]


def test_broken_retirement_is_finished_by_the_next(spark, root, monkeypatch):
    tables.create_tables(spark, root)
    stored(spark, root, [("a", "detected", "2023-01-01 05:00:00"), ("b", "notified", "2023-01-01 06:00:00")], "one")
    monkeypatch.setattr(tables, "_apply_retirement", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.retire(spark, root, AS_OF)
    monkeypatch.undo()
    assert tables.known_ids(spark, root).count() == 2
    assert tables.retire(spark, root, AS_OF) == 0
    assert [r.job_id for r in tables.known_ids(spark, root).collect()] == ["b"]


def test_retirement_and_recent_read_only_their_days(spark, root):
    tables.create_tables(spark, root)
    old = tables.old_listings(spark, root, AS_OF, 30)
    recent = report.recent(tables.read_table(spark, root, "listings"), AS_OF)
    for df, sign in ((old, "<="), (recent, ">=")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert f"(fetched_date#" in text and f" {sign} " in text.split("PartitionFilters: [")[1].split("]")[0]


def test_embedder_failures_stay_alone(spark):
    def load():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("model")
            return [[float(len(t))] for t in texts]
        return embed

    df = spark.createDataFrame([(1, "One"), (2, "bad"), (3, " one "), (4, None)], "i INT, x STRING")
    got = {r.i: r.embedding for r in with_embedding(df, F.col("x"), load).collect()}
    assert got == {1: [3.0], 2: None, 3: [3.0], 4: None}


def test_classifier_answers_every_row(spark):
    def load():
        def reply(prompt):
            if "Broken" in prompt:
                raise RuntimeError("x" * 99)
            return None if "Silent" in prompt else "no json"
        return reply

    df = spark.createDataFrame([(t, t, "C", "d") for t in ("Broken", "Silent", "Other")],
                               "job_id STRING, title STRING, company STRING, description STRING")
    got = {r.job_id: (r.suitable, r.reason, r.confidence) for r in classify(df, load).collect()}
    assert got == {"Broken": (True, "Error: " + "x" * 50, 0.0),
                   "Silent": (True, "LLM call failed, defaulting to suitable", 0.0),
                   "Other": (True, "Failed to parse LLM response", 0.0)}


def test_stream_over_many_files_equals_batch(spark, root):
    names = ["Data A", "Data B", "Data A", "Data C", "Data B", "Data D"]
    data, out, mark = f"{root}/in", f"{root}/out", f"{root}/check"
    for i, n in enumerate(names[:4]):
        landing(spark, [n], start=i).coalesce(1).write.mode("append").parquet(data)
    schema = spark.read.parquet(data).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        return streams.ingest(stream, SPECS["Arbeitnow"], ["data"], out, mark)

    assert sorted(r.title for r in run().collect()) == ["Data A", "Data B", "Data C"]
    for i, n in enumerate(names[4:], 4):
        landing(spark, [n], start=i).coalesce(1).write.mode("append").parquet(data)
    assert sorted(r.title for r in run().collect()) == ["Data A", "Data B", "Data C", "Data D"]


def test_stream_first_seen_with_a_hot_key(spark, root):
    df = spark.range(0, 300, 1, 3).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    df.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    got = streams.to_table(streams.first_seen(stream, "k"), f"{root}/out", f"{root}/check")
    assert got.count() == got.distinct().count() == 201


def test_profiles_from_a_table(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding ARRAY<FLOAT>")
    assert semantic.profile_vectors(df) == [[1.0, 2.0]]


def test_config_is_frozen():
    with pytest.raises(Exception):
        MatchConfig().min_score = 1.0


def test_streams_read_folders_and_files(spark, root, sf_dir):
    """A table of many part files streams like one of a single file; a missing one is an error."""
    one = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(one)
    many = f"{root}/events.parquet"
    table.repartition(8).write.parquet(many)
    for k, path in enumerate((one, many)):
        stream = streams.read_files(spark, path, table.schema)
        assert streams.to_table(stream, f"{root}/out{k}", f"{root}/mark{k}").count() == table.count()
    with pytest.raises(FileNotFoundError):
        streams.read_files(spark, f"{root}/none.parquet", table.schema)


def test_only_inserted_rows_are_finished(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.create_tables(spark, root)
    rows = spark.range(6).selectExpr("CAST(id % 3 AS STRING) AS job_id", "id AS at", "TIMESTAMP '2024-01-01' AS fetched_at")
    seen = []

    def finish(new):
        seen.append(new.count())
        return new.withColumn("status", F.lit("detected"))

    for _ in range(2):
        tables.insert_new(spark, rows, root, ["at"], finish=finish)
    assert seen == [3, 0]
    assert [r.status for r in tables.read_table(spark, root, "listings").collect()] == ["detected"] * 3
