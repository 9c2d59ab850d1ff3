"""Alerts as a keyed state machine: unknown -> detected -> notified, forgotten after a while.

Each listing id is a key.  Sightings that are not worth an alert make it ``detected``, the first
one that is emits the alert and makes it ``notified``; later ones only prolong its stay.  A key
that has not been seen for ``keep`` is dropped by an event-time timer, so that the state holds the live
listings and not all that ever were.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boardsift.config import MatchConfig
from boardsift.functions import alerts
from boardsift.operators import score
from boardsift.session import settings

#: Keyed state with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGHTING = "job_id string, ord bigint, seen_at timestamp, combined_score double, message string"
ALERT = "job_id string, ord bigint, combined_score double, message string"


def first_alerts(rows: pd.DataFrame) -> pd.DataFrame:
    """One sighting for each id: its first one with a message, or else its first; seen when last seen."""
    rows = rows.assign(_silent=rows["message"].isna()).sort_values(["job_id", "_silent", "ord"], kind="stable")
    last = rows.groupby("job_id")["seen_at"].transform("max")
    return rows.assign(seen_at=last).drop_duplicates("job_id").drop(columns="_silent")


def sightings(listings: DataFrame, as_of: str, cfg: MatchConfig, order: str, time: str) -> DataFrame:
    """What the state needs of scored listings, combined within tasks.

    A listing that makes up a third of a batch leaves each task as one row for each Arrow batch.
    """
    scored = score.score_listings(listings, as_of, cfg)
    row: dict[str, Column] = {c: F.col(c) for c in scored.columns}
    row.setdefault("llm_experience_required", F.lit(None).cast("string"))
    worth = (F.col("status") == "detected") & F.col("is_india") & (F.col("combined_score") >= cfg.min_score)
    narrow = scored.select(
        "job_id", F.col(order).cast("bigint").alias("ord"), F.col(time).cast("timestamp").alias("seen_at"),
        "combined_score", F.when(worth, alerts.alert_message(row)).alias("message"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield first_alerts(batch)

    return narrow.mapInPandas(combine, SIGHTING)


class NotifyOnce(StatefulProcessor):
    """The state of one listing id."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = first_alerts(pd.concat([first_alerts(r) for r in rows]))
        until = int(seen["seen_at"].iloc[0].timestamp() * 1000) + self.keep
        status, before = self.status.get() if self.status.exists() else ("unknown", None)
        alert = status != "notified" and seen["message"].notna().iloc[0]
        if before is None or until > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        else:
            until = before
        self.status.update(("notified" if alert or status == "notified" else "detected", until))
        if alert:
            yield seen[["job_id", "ord", "combined_score", "message"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.status.clear()
        yield from ()

    def close(self) -> None:
        pass


def notify_states(listings: DataFrame, as_of: str, cfg: MatchConfig, order: str, time: str, delay: str,
                  keep: timedelta) -> DataFrame:
    """(job_id, ord, combined_score, message): an alert the first time a listing is worth one.

    ``order`` numbers the arrivals and ``time`` says when a listing was seen.
    """
    seen = sightings(listings, as_of, cfg, order, time).withWatermark("seen_at", delay)
    return seen.groupBy("job_id").transformWithStateInPandas(
        NotifyOnce(keep), ALERT, "Append", "EventTime")


def run_notify(alerts_stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Take what has landed, append the alerts and keep the state in ``checkpoint``."""
    from boardsift.streaming.streams import to_table

    with settings(alerts_stream.sparkSession, {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}):
        return to_table(alerts_stream, path, checkpoint)
