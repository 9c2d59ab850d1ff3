"""A whole run over landed payloads.

Each step writes under the run's own folder and is skipped when its result is
already complete, so a run that lost its driver or executors can be started
again with the same ``run_id`` and finishes what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.config import MatchConfig, all_search_keywords
from boardsift.functions.age import timestamp_literal
from boardsift.operators import dedup, report, score, semantic, state
from boardsift.plugins import classify, eligible, with_embedding
from boardsift.sources import tables
from boardsift.sources.normalizer import (
    SourceSpec, ingest_errors, normalize, quarantine, quarantine_entries)


@dataclass(frozen=True)
class ScanResult:
    scored: DataFrame
    outbox: DataFrame
    history: DataFrame
    quarantined: DataFrame
    quarantined_entries: DataFrame


def read_batch(landing: DataFrame, specs: Sequence[SourceSpec],
               keywords: Sequence[str]) -> DataFrame:
    """Listings of all boards, numbered by the order of ``specs``."""
    return dedup.union_batches([
        normalize(landing, spec, keywords, keep_order=True).withColumn("board_rank", F.lit(i))
        for i, spec in enumerate(specs)])


ORDER = ["board_rank", "ord", "pos"]


def _once(spark: SparkSession, path: str, df: Callable[[], DataFrame]) -> DataFrame:
    if not tables.finished(spark, path):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def score_batch(batch: DataFrame, known, as_of: str, cfg: MatchConfig,
                profiles: Sequence[Sequence[float]] = (), embedder: Callable | None = None,
                classifier: Callable | None = None) -> DataFrame:
    """New listings of a batch with scores, status and experience verdict.

    ``known`` is a frame of job_ids or an id index.
    """
    fresh = dedup.fresh_listings(batch, known, ORDER)
    similarity = None
    if embedder is not None:
        text = F.concat_ws(" ", "title", "description")
        fresh = with_embedding(fresh, text, embedder).withColumn(
            "similarity", semantic.best_similarity(F.col("embedding"), profiles)).drop("embedding")
        similarity = "similarity"
    scored = score.score_listings(fresh, as_of, cfg, similarity=similarity)
    scored = score.with_experience(scored, cfg)
    if classifier is not None:
        verdicts = classify(eligible(scored, cfg.min_score), classifier)
        scored = state.apply_verdicts(scored, verdicts)
    return scored


def run_scan(spark: SparkSession, landing: DataFrame, root: str, run_id: str, as_of: str,
             specs: Sequence[SourceSpec], keywords: Sequence[str] | None = None,
             cfg: MatchConfig = MatchConfig(), quotas: Sequence[report.Quota] = (), **models) -> ScanResult:
    """Normalise, deduplicate, score, store, and queue an alert for every match.

    Of the answers of metered APIs (``quotas``) a run reads those that its quota pays for, and logs them as calls.

    What does not parse is kept in the run's ``quarantine`` and ``quarantined_entries`` folders.  How many alerts go out at a
    time is the sender's choice, see :func:`sender_batch` and :func:`mark_sent`.
    """
    tables.create_tables(spark, root)
    keywords = all_search_keywords() if keywords is None else keywords
    run = f"{root}/runs/{run_id}"
    if quotas:
        landing = paid_landing(spark, landing, root, run_id, as_of, quotas)
    batch = _once(spark, f"{run}/batch", lambda: read_batch(landing, specs, keywords))
    quarantined = _once(spark, f"{run}/quarantine", lambda: reduce(DataFrame.unionByName, [
        quarantine(landing, spec, keywords) for spec in specs]))
    odd = _once(spark, f"{run}/quarantined_entries", lambda: reduce(DataFrame.unionByName, [
        quarantine_entries(landing, spec, keywords) for spec in specs]))
    index = tables.listing_index(spark, root).maintained()
    scored = _once(spark, f"{run}/scored", lambda: score_batch(
        batch, index.excluding(run_id), as_of, cfg, **models))
    # The rows are new and their run replaces itself, so nothing is looked up again.
    tables.put_listings(scored, root, run_id)
    index.add(scored, run_id)

    queued = tables.read_table(spark, root, "outbox")
    notified = state.latest_status(tables.read_table(spark, root, "status_events")).filter(
        F.col("notified_at").isNotNull())
    done = queued.select("job_id").union(notified.select("job_id"))
    outbox = _once(spark, f"{run}/outbox", lambda: state.pending_alerts(
        report.matches(scored, cfg), done).select(
        "job_id", "combined_score", "message", timestamp_literal(as_of).alias("queued_at")))
    tables.write_part(outbox, root, "outbox", run_id)

    errors = ingest_errors(landing, run_id)
    history = scan_history(batch, scored, outbox, errors, run_id, as_of, cfg)
    tables.write_part(history, root, "scan_history", run_id)
    return ScanResult(scored, outbox, tables.read_table(spark, root, "scan_history").filter(
        F.col("run_id") == run_id), quarantined, odd)


def paid_landing(spark: SparkSession, landing: DataFrame, root: str, run_id: str, as_of: str,
                 quotas: Sequence[report.Quota]) -> DataFrame:
    """The landing without the answers beyond the quota; a repeated run gets the same ones and counts them once."""
    before = tables.read_without(spark, root, "api_calls", run_id)
    paid = _once(spark, f"{root}/runs/{run_id}/paid", lambda: report.within_quota(landing, before, quotas, as_of))
    tables.write_part(report.call_events(paid, quotas, as_of), root, "api_calls", run_id)
    return report.unmetered(landing, quotas).unionByName(paid)


def sender_batch(spark: SparkSession, root: str, k: int) -> DataFrame:
    """The ``k`` best queued alerts that nobody was sent yet."""
    sent = state.latest_status(tables.read_table(spark, root, "status_events")).filter(
        F.col("notified_at").isNotNull())
    return dedup.new_only(tables.read_table(spark, root, "outbox"), sent.select("job_id")).orderBy(
        F.desc("combined_score"), "job_id").limit(k)


def mark_sent(ids: DataFrame, root: str, part: str, as_of: str) -> None:
    """Records that the alerts of ``ids`` (job_id) went out; ``part`` names the delivery."""
    tables.write_part(state.status_events(ids.select("job_id"), "notified", as_of), root, "status_events", part)


def scan_history(batch: DataFrame, scored: DataFrame, outbox: DataFrame, errors: DataFrame,
                 run_id: str, as_of: str, cfg: MatchConfig) -> DataFrame:
    """The statistics row of a run, joined from one-row frames by ``run_id``.

    ``errors`` holds (run_id, source, error), each error of a board.
    """
    def of_run(df: DataFrame) -> DataFrame:
        return df.withColumn("run_id", F.lit(run_id))

    counts = of_run(batch).groupBy("run_id", "source").agg(F.count("*").alias("n"))
    fetched = counts.groupBy("run_id").agg(
        F.sum("n").alias("total_fetched"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
        .alias("source_counts"))
    funnel = of_run(report.funnel(scored, cfg))
    sent = of_run(outbox.agg(F.count("*").alias("total_notified")))
    errors = report.joined_errors(errors)
    return (funnel.join(sent, "run_id").join(fetched, "run_id", "left")
            .join(errors, "run_id", "left").select(
        "run_id", timestamp_literal(as_of).alias("started_at"),
        F.current_timestamp().alias("completed_at"),
        F.coalesce("total_fetched", F.lit(0)).alias("total_fetched"), "total_new",
        "total_matched", F.col("filtered_location").alias("total_filtered_location"),
        (F.col("filtered_age") + F.col("filtered_score")).alias("total_filtered_relevance"),
        F.col("filtered_experience").alias("total_filtered_llm"), "total_notified",
        "best_score", "avg_score", "source_counts", F.coalesce("errors", F.lit("")).alias("errors")))
