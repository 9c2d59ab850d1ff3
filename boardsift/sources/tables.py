"""Parquet tables, the CSV id history and their readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boardsift.functions.age import timestamp_literal
from boardsift.operators import dedup, state
from boardsift.schemas import HISTORY_CSV, LANDING, TABLES
from boardsift.sources import files
from boardsift.sources.files import children, exists, finished, is_folder  # noqa: F401
from boardsift.sources.idindex import IdIndex, open_index


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that do not exist yet, without rows."""
    for name, schema in TABLES.items():
        if not exists(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}/{_folder(name, 'empty')}")


def _folder(name: str, leaf: str) -> str:
    # Listings are laid out by day, which retention and "recent" queries prune on, and by run.
    return f"fetched_date=1970-01-01/part={leaf}" if name == "listings" else f"part={leaf}"


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared and its layout columns."""
    layout = "fetched_date DATE, part STRING" if name == "listings" else "part STRING"
    schema = StructType(StructType.fromDDL(TABLES[name]).fields + StructType.fromDDL(layout).fields)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared columns; the day is kept for listings."""
    return _stored(spark, root, name).drop("part")


def write_landing(df: DataFrame, path: str) -> None:
    """Append payloads, laid out by board.

    Every board reads only its own folder; rebalancing splits a board that
    holds most payloads over several files.
    """
    (df.hint("rebalance", "source").write.mode("append")
     .partitionBy("source").parquet(path))


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).parquet(path)


def known_ids(spark: SparkSession, root: str) -> DataFrame:
    """All stored ids; the scan reads this one column."""
    return read_table(spark, root, "listings").select("job_id")


def listing_index(spark: SparkSession, root: str, expected: int = 1_000_000) -> IdIndex:
    """The index of all stored ids; built from the listings when there is none yet."""
    index = open_index(spark, f"{root}/listing_ids", expected)
    index.add(known_ids(spark, root), "stored before")
    return index


def put_listings(df: DataFrame, root: str, part: str) -> None:
    """Write the scored listings of a run, laid out by day; writing a run again replaces it.

    Rebalancing gives each day a few files of even size; a day that holds most
    rows is split over several tasks.  Sorting lets readers skip row groups by
    status and score.
    """
    declared = StructType.fromDDL(TABLES["listings"])
    have = set(df.columns)
    rows = df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in declared.fields])
    rows = rows.withColumns({"fetched_date": F.to_date("fetched_at"), "part": F.lit(part)})
    _put_days(rows.hint("rebalance", "fetched_date").sortWithinPartitions(
        "fetched_date", "status", F.desc("combined_score")), root)


def _put_days(rows: DataFrame, root: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fetched_date", "part").parquet(f"{root}/listings"))


def insert_new(spark: SparkSession, df: DataFrame, root: str, order: list[str],
               part: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Insert-or-ignore by ``job_id``; a repeated batch adds nothing.

    ``part`` names the batch, so that one that broke off can be inserted again.  ``finish`` adds what is
    costly, such as scores, to the rows that are inserted; the batch itself is read several times.
    """
    part = part or uuid.uuid4().hex
    index = listing_index(spark, root)
    fresh = dedup.fresh_listings(df, index.excluding(part), order)
    put_listings(finish(fresh) if finish else fresh, root, part)
    index.add(_stored(spark, root, "listings").filter(F.col("part") == part), part)


def write_part(df: DataFrame, root: str, name: str, part: str) -> None:
    """Write one named part of a table; writing it again replaces it."""
    declared = StructType.fromDDL(TABLES[name])
    df.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields]).write.mode(
        "overwrite").parquet(f"{root}/{name}/part={part}")


def read_without(spark: SparkSession, root: str, name: str, part: str) -> DataFrame:
    """A table without the rows of one part, for a step that replaces that part."""
    return _stored(spark, root, name).filter(F.col("part") != part).drop("part")


def fold_status(spark: SparkSession, root: str) -> int:
    """Replace the complete parts of the status log by one with the events that still count.

    Returns the number of parts replaced.  The new part is complete before the first old one goes, and
    folded events beside the originals mean the same (``state.folded``), so a call that broke off
    anywhere leaves a right log.  A query that listed the old parts before has to be started again.
    """
    log = f"{root}/status_events"
    old = sorted(f"{log}/{p}" for p in children(spark, log) if p.startswith("part=") and finished(spark, f"{log}/{p}"))
    events = spark.read.schema(TABLES["status_events"]).parquet(*old) if old else spark.createDataFrame(
        [], TABLES["status_events"])
    write_part(state.folded(events), root, "status_events", f"folded-{uuid.uuid4().hex}")
    for path in old:
        files.remove(spark, path)
    return len(old)


def save_key_table(ids: DataFrame, table: str, buckets: int) -> None:
    """Store ids bucketed, so that a later anti join shuffles only the batch."""
    (ids.select("job_id").write.mode("overwrite").bucketBy(buckets, "job_id")
     .sortBy("job_id").saveAsTable(table))


# ------------------------------------------------------------ retention


def retire(spark: SparkSession, root: str, as_of: str, days: int = 30) -> int:
    """Delete expired listings and return how many went.

    Only days up to the cutoff are read.  A run's share of a day goes as a folder when nothing of it
    survives, and is replaced by its survivors otherwise; all others stay untouched.  What is
    going to happen is written down first, and a call that broke off is finished by the next one.
    """
    for pending in sorted(children(spark, f"{root}/retirements")):
        if not exists(spark, f"{root}/retirements/{pending}/done"):
            _apply_retirement(spark, root, pending)
    step = f"{len(children(spark, f'{root}/retirements')):08d}-{uuid.uuid4().hex}"
    place = f"{root}/retirements/{step}"
    gone = _flagged(spark, root, as_of, days)
    gone.write.parquet(f"{place}/flags")
    flags = spark.read.schema(gone.schema).parquet(f"{place}/flags")
    survivors = old_listings(spark, root, as_of, days).join(
        flags.filter("_mixed AND NOT _gone").select("job_id", "fetched_date", "part"),
        ["job_id", "fetched_date", "part"], "left_semi")
    survivors.write.parquet(f"{place}/survivors")
    _apply_retirement(spark, root, step)
    return flags.filter("_gone").count()


def old_listings(spark: SparkSession, root: str, as_of: str, days: int) -> DataFrame:
    """Listings of the days in which some may have expired; other days are not read."""
    last = F.to_date(timestamp_literal(as_of) - F.make_interval(days=F.lit(days)))
    return _stored(spark, root, "listings").filter(F.col("fetched_date") <= last)


def _flagged(spark: SparkSession, root: str, as_of: str, days: int) -> DataFrame:
    """(job_id, fetched_date, part, _gone, _mixed) of all rows of folders with an expired row."""
    old = old_listings(spark, root, as_of, days).select(
        "job_id", "fetched_date", "part", "status", "fetched_at", "notified_at", "applied_at")
    events = dedup.known_only(read_table(spark, root, "status_events"), old)
    rows = state.with_current_status(old, events).select(
        "job_id", "fetched_date", "part", state.expired(as_of, days).alias("_gone"))
    folders = rows.groupBy("fetched_date", "part").agg(F.bool_or("_gone").alias("_any"), (~F.bool_and(
        "_gone")).alias("_mixed")).filter("_any").drop("_any")
    return rows.join(folders, ["fetched_date", "part"])


def _apply_retirement(spark: SparkSession, root: str, step: str) -> None:
    """Swaps folders as written down; doing it twice does no more than once."""
    place = f"{root}/retirements/{step}"
    if finished(spark, f"{place}/survivors"):
        flags = spark.read.parquet(f"{place}/flags")
        _put_days(spark.read.schema(_stored(spark, root, "listings").schema).parquet(f"{place}/survivors"), root)
        # a row for each run's share of an expired day
        for r in flags.filter("NOT _mixed").select("fetched_date", "part").distinct().collect():
            files.remove(spark, f"{root}/listings/fetched_date={r.fetched_date}/part={r.part}")
        index = listing_index(spark, root)
        index.compacted(without=flags.filter("_gone").select("job_id"))
    files.touch(spark, f"{place}/done")


# ------------------------------------------------------------ CSV id history


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The newest complete full version and the complete additions after it, oldest first."""
    done = sorted((v for v in children(spark, folder) if v[1:].isdigit() and finished(spark, f"{folder}/{v}")),
                  key=lambda v: int(v[1:]))
    full = [k for k, v in enumerate(done) if v[0] == "v"]
    return done[full[-1] if full else 0:]


def _read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = spark.createDataFrame([], HISTORY_CSV)
    good = [p for p in paths if "id" in spark.read.option("header", True).csv(p).columns]
    if good:
        # columns are found by name in each file's own header
        out = spark.read.option("header", True).option("enforceSchema", False).csv(good)
    return out.select(F.col("id").cast("string").alias("id"))


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All ids of the history; anything unreadable counts as empty."""
    return _read_csv(spark, [f"{folder}/{v}" for v in _versions(spark, folder)])


def _next_version(spark: SparkSession, folder: str, kind: str) -> str:
    last = max((int(v[1:]) for v in children(spark, folder) if v[1:].isdigit()), default=0)
    return f"{folder}/{kind}{last + 1:08d}"


def save_history(ids: DataFrame, folder: str) -> None:
    """Write the next full version beside the one being read; readers switch once it
    is complete, so a failed write loses nothing."""
    ids.select("id").write.option("header", True).csv(_next_version(ids.sparkSession, folder, "v"))


def append_history(ids: DataFrame, folder: str) -> None:
    """Write new ids only; readers add them to what came before once they are complete."""
    ids.select("id").write.option("header", True).csv(_next_version(ids.sparkSession, folder, "d"))


def history_index(spark: SparkSession, folder: str) -> IdIndex:
    """The index of a CSV history, brought up to date with the versions it has not seen."""
    index = open_index(spark, f"{folder}/_index")
    for v in _versions(spark, folder):
        index.add(_read_csv(spark, [f"{folder}/{v}"]), v, key="id")
    return index
