"""The same work as incremental streams.

Streams run with ``availableNow``: they take what has landed, finish and keep
their position in a checkpoint of the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.config import MatchConfig
from boardsift.operators import dedup, report, score, state
from boardsift.sources import tables
from boardsift.sources.idindex import IdIndex, open_index
from boardsift.sources.normalizer import SourceSpec, normalize

BatchFn = Callable[[DataFrame, int], DataFrame]


def read_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet file, or a folder of part files, as a stream; nothing is inferred.

    A path that matches nothing is an error, since such a stream would just be empty.
    """
    if not tables.exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(schema)
    if tables.is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream needs a folder
    return reader.option("pathGlobFilter", name).parquet(folder)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append a stream to a parquet folder, exactly once, and read it back."""
    spark = stream.sparkSession
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def by_batch(stream: DataFrame, path: str, checkpoint: str, fn: BatchFn,
             mode: str = "append", after: BatchFn | None = None) -> None:
    """Write ``fn(micro_batch, id)`` to its own folder; a replayed batch replaces it.

    ``after`` gets what was written, and the id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = fn(batch, batch_id)
        place = f"{path}/batch_id={batch_id}"
        out.write.mode("overwrite").parquet(place)
        if after is not None:
            after(batch.sparkSession.read.schema(out.schema).parquet(place), batch_id)

    query = (stream.writeStream.foreachBatch(write).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def ingest(landing: DataFrame, spec: SourceSpec, keywords: list[str], path: str,
           checkpoint: str, index: IdIndex | None = None) -> DataFrame:
    """Normalise landed payloads with the batch normaliser; each listing once.

    First-wins within the micro-batch keeps one row per id and task before the shuffle; the id index
    (by default one beside ``path``) tells which ids earlier batches had, so nothing written before is read again.
    A batch that broke off is repeated against the index without its own ids.
    """
    spark = landing.sparkSession
    ids = index or open_index(spark, f"{path}_ids")

    parsed: list[DataFrame] = []

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        listings = normalize(batch, spec, keywords, keep_order=True)
        # read twice: for the ids that are looked up, and for the rows
        parsed.append(dedup.first_wins(listings, ["job_id"], ["ord", "pos"]).persist())
        return dedup.new_only(parsed[-1], ids.excluding(f"{path} {batch_id}"))

    def after(out: DataFrame, batch_id: int) -> None:
        parsed.pop().unpersist()
        ids.add(out, f"{path} {batch_id}")

    by_batch(landing, path, checkpoint, fn, after=after)
    if index is None:
        ids.maintained()
    return spark.read.parquet(path)


def combined(rows: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """One row for each key, with its latest time, of each Arrow batch of a task.

    So a key that makes up most of the stream reaches the state as a few rows.
    """
    columns = [key] if time is None else [key, time]
    rows = rows.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by(key).aggregate([] if time is None else [(time, "max")])
            yield from once.select([key] if time is None else [key, f"{time}_max"]).rename_columns(columns).to_batches()

    return rows.mapInArrow(run, rows.schema)


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Each key once over the whole stream; the state holds each key once, for ever."""
    return combined(stream, key).dropDuplicates([key])


def first_seen_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once per watermark delay; keys older than the watermark leave the state."""
    rows = combined(stream.withColumn(time, F.col(time).cast("timestamp")), key, time)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).select(key)


def new_only(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """A stream without the rows of a static table."""
    return stream.join(known.select(key), key, "left_anti")


def scored_stream(listings: DataFrame, as_of: str, cfg: MatchConfig) -> DataFrame:
    """Stale or irrelevant listings stay in the stream as ``filtered``."""
    return score.score_listings(listings, as_of, cfg)


def windowed_counts(stream: DataFrame, time: str, key: str, delay: str, width: str,
                    slide: str | None = None) -> DataFrame:
    """Counts per window and key; counts combine per task before the shuffle."""
    at = F.col(time).cast("timestamp")
    return (stream.select(at.alias(time), key).withWatermark(time, delay)
            .groupBy(F.window(time, width, slide or width).alias("w"), key)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), key, "n"))


def session_counts(stream: DataFrame, time: str, key: str, delay: str, gap: str) -> DataFrame:
    """Activity sessions, emitted once the watermark has passed their end.

    Rows are merged into sessions per task before the shuffle, so a busy key
    sends sessions and not rows.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    at = F.col(time).cast("timestamp")
    return (stream.select(at.alias(time), key).withWatermark(time, delay)
            .groupBy(F.session_window(time, gap).alias("w"), key)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"))


def latest_update(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The newest value per key of an update-mode stream written by batch."""
    return spark.read.parquet(path).groupBy(*keys).agg(
        F.max_by(value, "batch_id").alias(value))


def notify_once(listings: DataFrame, as_of: str, cfg: MatchConfig, path: str,
                checkpoint: str) -> DataFrame:
    """Queue an alert the first time a listing is eligible, never again.

    The first row of a micro-batch speaks for its listing; an id index beside ``path`` knows what was
    queued before.  See :mod:`boardsift.streaming.notify` for state that forgets.
    """
    spark = listings.sparkSession
    queued = open_index(spark, f"{path}_queued")

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        one = dedup.first_wins(batch, ["job_id"], ["doc_id"])
        hits = score.score_listings(one, as_of, cfg).filter(
            (F.col("status") == "detected") & F.col("is_india"))
        return state.alerts_for(hits).select("job_id", "combined_score", "message")

    def after(out: DataFrame, batch_id: int) -> None:
        queued.add(out, str(batch_id))

    def new(batch: DataFrame, batch_id: int) -> DataFrame:
        hits = fn(batch, batch_id)
        return dedup.new_only(hits, queued.excluding(str(batch_id)))

    by_batch(listings, path, checkpoint, new, after=after)
    return spark.read.parquet(path)


def running_funnel(listings: DataFrame, as_of: str, cfg: MatchConfig, path: str,
                   checkpoint: str) -> DataFrame:
    """One funnel row per micro-batch; totals are their sums."""
    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        return report.funnel(score.score_listings(batch, as_of, cfg), cfg)

    by_batch(listings, path, checkpoint, fn)
    return listings.sparkSession.read.parquet(path)


def total(column: str) -> Column:
    return F.sum(column).alias(column)
