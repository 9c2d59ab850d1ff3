"""The stored id index against plain sets, its plan, and its behaviour after breaks."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from boardsift.operators import dedup
from boardsift.session import settings
from boardsift.sources import files, idindex
from boardsift.sources.specs import SPECS
from boardsift.streaming import streams
from tests.test_runs import landing


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def ids(spark, lo, hi):
    return spark.range(lo, hi).select(F.md5(F.col("id").cast("string")).alias("job_id"), F.col("id").alias("ord"))


def count(df):
    return df.count(), df.distinct().count()


def test_answers_equal_sets(spark, path):
    index = idindex.open_index(spark, path, 100)  # far too small: more asks in vain, same answers
    assert index.add(ids(spark, 0, 2000), "one") and index.add(ids(spark, 1500, 3000), "two")
    assert not index.add(ids(spark, 9000, 9999), "one")
    batch = ids(spark, 2900, 4000).union(ids(spark, 3500, 3600))
    extra = spark.createDataFrame([(None, -1)], "job_id string, ord bigint")
    new = index.new_only(batch.union(extra))
    assert sorted(r.ord for r in new.collect()) == sorted([-1, *range(3000, 4000), *range(3500, 3600)])
    assert count(index.known_among(batch)) == (100, 100)
    assert index.excluding("two").new_only(batch).count() == batch.count()
    assert sorted(r.ord for r in dedup.fresh_listings(batch, index, ["ord"]).collect()) == list(range(3000, 4000))


def test_filter_rules_out_most_unknown_ids(spark, path):
    index = idindex.open_index(spark, path, 20_000)
    index.add(ids(spark, 0, 20_000), "one")
    assert index.may_hold(ids(spark, 0, 20_000)).count() == 20_000
    assert index.may_hold(ids(spark, 50_000, 70_000)).count() < 20_000 * 0.02


def test_stored_ids_are_not_moved(spark, path):
    index = idindex.open_index(spark, path)
    index.add(ids(spark, 0, 10), "one")
    for partitions in ("4", "211"):
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": partitions}):
            text = index.new_only(ids(spark, 5, 20))._jdf.queryExecution().executedPlan().toString()
        for kind in ("ids", "bloom"):
            at = [i for i, line in enumerate(text.splitlines()) if f"FileScan parquet spark_catalog.default.{kind}_" in line]
            lines = text.splitlines()
            assert len(at) == 1 and "Bucketed: true" in lines[at[0]]
            above = next(x for x in reversed(lines[:at[0]]) if "Exchange" in x or "Sort [" in x)
            assert "Sort [" in above  # only sorted, on the way to its join


def test_ties_and_null_orders_keep_one_row(spark, path):
    index = idindex.open_index(spark, path)
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 3, 1), ("b", 3, 2), ("c", 1, 1)],
                                 "job_id string, ord bigint, x int")
    index.add(rows.filter("job_id = 'c'"), "one")
    assert sorted(r.job_id for r in dedup.fresh_listings(rows, index, ["ord"]).collect()) == ["a", "b"]


def test_compaction_keeps_parts_and_drops_ids(spark, path):
    index = idindex.open_index(spark, path, 100)
    index.add(ids(spark, 0, 500), "a/1")
    index.add(ids(spark, 400, 900), "2024-01-31")
    new = index.compacted(without=ids(spark, 0, 100))
    again = idindex.open_index(spark, path)
    assert again.folder == new.folder != index.folder and count(again.ids()) == (800, 800)
    assert sorted(again.parts()) == sorted(index.parts()) and not again.add(ids(spark, 0, 9), "a/1")
    assert again.new_only(ids(spark, 0, 1000)).count() == 200


def test_part_and_generation_that_broke_off(spark, path, monkeypatch):
    index = idindex.open_index(spark, path, 100)
    monkeypatch.setattr(files, "touch", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(ids(spark, 0, 50), "one")
    monkeypatch.undo()
    monkeypatch.setattr(idindex.IdIndex, "_finish", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.compacted()
    monkeypatch.undo()
    again = idindex.open_index(spark, path)
    assert again.folder == index.folder and again.add(ids(spark, 0, 50), "one")
    assert again.new_only(ids(spark, 0, 60)).count() == 10
    assert count(again.compacted().ids()) == (50, 50)


def test_index_is_found_by_another_session(spark, path):
    idindex.open_index(spark, path).add(ids(spark, 0, 50), "one")
    other = spark.newSession()
    assert idindex.open_index(other, path).new_only(ids(other, 40, 60)).count() == 10


def test_replayed_batch_finds_its_own_listings_new(spark, path):
    """A batch whose ids were added but which was not committed gives the same rows again."""
    data = f"{path}/in"
    landing(spark, ["Data A", "Data B"]).coalesce(1).write.parquet(data)
    schema = spark.read.parquet(data).schema

    def run(mark):
        stream = spark.readStream.schema(schema).parquet(data)
        return sorted(r.title for r in streams.ingest(stream, SPECS["Arbeitnow"], ["data"], f"{path}/out", mark).collect())

    assert run(f"{path}/check1") == ["Data A", "Data B"]
    # a lost checkpoint starts again with batch 0
    assert run(f"{path}/check2") == ["Data A", "Data B"]


def test_stream_in_halves_equals_one_run(spark, path):
    names = [f"Data {k % 7}" for k in range(20)]
    out = {}
    for way, cuts in (("one", [20]), ("halves", [10, 20])):
        data, done = f"{path}/{way}/in", 0
        for cut in cuts:
            landing(spark, names[done:cut], start=done).coalesce(2).write.mode("append").parquet(data)
            done = cut
            stream = spark.readStream.schema(spark.read.parquet(data).schema).parquet(data)
            rows = streams.ingest(stream, SPECS["Arbeitnow"], ["data"], f"{path}/{way}/out", f"{path}/{way}/check")
        out[way] = sorted(r.title for r in rows.collect())
    assert out["one"] == out["halves"] == sorted(set(names))


def test_no_batch_reads_earlier_output(spark, path):
    """Only the ids and the new payloads are read, whatever was written before."""
    index = idindex.open_index(spark, f"{path}/ids")
    index.add(ids(spark, 0, 10), "one")
    text = index.new_only(ids(spark, 5, 20))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<id:string>", "struct<block:bigint,bits:binary>"}
