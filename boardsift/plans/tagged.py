"""The run of the 0-100 scorer: search tags, CSV history, fixed number of alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.config import TaggedConfig
from boardsift.functions import alerts, text
from boardsift.operators import dedup, report, score
from boardsift.sources import tables


@dataclass(frozen=True)
class TaggedResult:
    alerts: DataFrame
    stats: DataFrame


def with_id(listings: DataFrame) -> DataFrame:
    return listings.withColumn(
        "job_id_v1", text.job_id_v1(F.col("title"), F.col("company"), F.col("source")))


def new_matches(listings: DataFrame, history, as_of: str, profiles: dict[str, str],
                cfg: TaggedConfig = TaggedConfig(),
                stop_words: list[str] | None = None) -> DataFrame:
    """Fresh listings outside the history, once per search tag, with scores.

    ``history`` is a frame of ids or an id index.
    Freshness and history come first, so only new rows are scored.  Repeats
    within a run are kept, one per tag and copy; see ``dedup.first_wins`` for
    the stricter policy.
    """
    fresh = score.fresh_by_age(with_id(listings), as_of, cfg.max_age_hours)
    if isinstance(history, DataFrame):
        history = history.select(F.col("id").alias("job_id_v1"))
    new = dedup.new_only(fresh, history, "job_id_v1")
    return score.score_by_tag(new, cfg.tags, profiles, cfg, stop_words)


def run_tagged_scan(listings: DataFrame, history_folder: str, out: str, as_of: str,
                    profiles: dict[str, str], cfg: TaggedConfig = TaggedConfig(),
                    stop_words: list[str] | None = None) -> TaggedResult:
    """Score, write the alerts of the best matches, and remember those.

    A listing below the alert limit is not remembered and competes again in
    the next run.  The history gets the new ids only after the alerts are
    complete; a run repeated after a failure in between reuses them.
    """
    spark = listings.sparkSession
    history = tables.history_index(spark, history_folder).maintained()
    if not tables.finished(spark, f"{out}/alerts"):
        scored = new_matches(listings, history, as_of, profiles, cfg, stop_words)
        scored.select("job_id_v1", "tag", "title", "company", "location", "source", "url",
                      "score").write.mode("overwrite").parquet(f"{out}/scored")
        scored = spark.read.parquet(f"{out}/scored")
        top = report.top_tagged(scored, cfg.min_score, cfg.alerts)
        row = {c: F.col(c) for c in scored.columns}
        top.withColumn("message", alerts.tagged_alert(row)).write.mode("overwrite").parquet(
            f"{out}/alerts")
    sent = spark.read.parquet(f"{out}/alerts")
    tables.append_history(
        dedup.new_only(sent.select(F.col("job_id_v1").alias("id")).distinct(), history, "id"), history_folder)
    return TaggedResult(
        sent, report.tagged_funnel(spark.read.parquet(f"{out}/scored"), cfg.min_score))
