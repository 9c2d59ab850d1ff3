"""Listing state without updates in place.

Status changes are appended as events; the current state is the latest event
of each listing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift import vocab
from boardsift.functions import alerts
from boardsift.functions.age import timestamp_literal
from boardsift.operators.dedup import new_only


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per listing, with the last time it was notified or applied.

    All aggregates combine per task before the shuffle, so a listing with very
    many events sends one row per task.  Events of equal time and number are ordered by
    their status.
    """
    order = F.struct("at", "seq", "status")

    def last_time(status: str) -> Column:
        return F.max(F.when(F.col("status") == status, F.col("at")))

    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max("at").alias("updated_at"),
        last_time("notified").alias("notified_at"),
        last_time("applied").alias("applied_at"),
    )


def latest_extras(events: DataFrame) -> DataFrame:
    """(job_id, extras): the value written last for each extra field of a listing.

    A field that was set to NULL last is in the map with NULL; listings without extra fields have
    no row.  Values are merged per field and task before the shuffle, so a map holds one entry
    for each field and never for each event.
    """
    entries = events.select("job_id", "at", "seq", "status", F.explode("extras").alias("field", "value"))
    last = entries.groupBy("job_id", "field").agg(
        F.max_by("value", F.struct("at", "seq", "status", "value")).alias("value"))
    return last.groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("field", "value")))).alias("extras"))


def folded(events: DataFrame) -> DataFrame:
    """The events that still decide something, with the extras that nothing overwrote.

    Kept are, for each listing, its last event, the last one that notified and the last one that
    applied, and for each extra field the event that wrote it last.  The state of a listing is the same
    from these as from all events, also when older events arrive afterwards, and
    folding events twice, or folded ones beside the originals, changes nothing.
    """
    none = F.array().cast("array<struct<slot:string,value:string>>")
    nothing = F.lit(None).cast("string")
    slots = F.concat(
        F.array(F.struct(F.lit("last").alias("slot"), nothing.alias("value"))),
        F.when(F.col("status").isin("notified", "applied"), F.array(F.struct(
            F.concat(F.lit("last "), "status").alias("slot"), nothing.alias("value")))).otherwise(none),
        F.coalesce(F.transform(F.map_entries("extras"), lambda e: F.struct(
            F.concat(F.lit("="), e["key"]).alias("slot"), e["value"].alias("value"))), none))
    winners = events.select("job_id", "at", "seq", "status", F.inline(slots)).groupBy("job_id", "slot").agg(
        F.max(F.struct("at", "seq", "status", "value")).alias("w")).select("job_id", "slot", "w.*")
    entry = F.when(F.col("slot").startswith("="), F.struct(
        F.substring("slot", 2, 2147483647).alias("key"), "value"))
    extras = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return winners.groupBy("job_id", "at", "seq", "status").agg(extras.alias("_extras")).select(
        "job_id", "status", "at", "seq", F.when(F.size("_extras") > 0, F.col("_extras")).alias("extras"))


def status_events(ids: DataFrame, status: str, at: datetime | str | Column,
                  extras: dict[str, Column] | None = None) -> DataFrame:
    """One event per listing id, ready to append.

    ``extras`` are further fields that the event sets, as columns of ``ids``; NULL clears a field.
    """
    if status not in vocab.STATUSES:
        raise ValueError(f"unknown status {status!r}")
    pairs = [x for name, value in (extras or {}).items() for x in (F.lit(name), value.cast("string"))]
    return ids.select(
        "job_id", F.lit(status).alias("status"), timestamp_literal(at).alias("at"),
        F.lit(0).cast("bigint").alias("seq"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("extras"))


# Columns that an event sets by itself or that say where a row is stored.
NO_EXTRAS = {"job_id", "status", "notified_at", "applied_at", "fetched_date", "part"}


def with_current_status(table: DataFrame, events: DataFrame) -> DataFrame:
    """Overlay the event log, and the extra fields it sets, on the stored listings.

    A value that its column's type cannot hold becomes NULL; fields that the table lacks stay in the log.
    """
    last = latest_status(events).select(
        "job_id", F.col("status").alias("_status"),
        F.col("notified_at").alias("_notified"), F.col("applied_at").alias("_applied"))
    new = {
        "status": F.coalesce("_status", "status"),
        "notified_at": F.coalesce("_notified", "notified_at"),
        "applied_at": F.coalesce("_applied", "applied_at"),
    }
    if "extras" in events.columns:
        last = last.join(latest_extras(events).withColumnRenamed("extras", "_extras"), "job_id", "left")
        for f in table.schema.fields:
            if f.name not in NO_EXTRAS:
                x = F.col("_extras")
                new[f.name] = F.when(F.coalesce(F.map_contains_key(x, f.name), F.lit(False)), x[f.name].try_cast(
                    f.dataType)).otherwise(F.col(f.name))
    return table.join(last, "job_id", "left").withColumns(new).drop(
        "_status", "_notified", "_applied", "_extras")


def expired(as_of: datetime | str, days: int = 30) -> Column:
    """Old listings that led to nothing; a missing time or status never expires."""
    cutoff = timestamp_literal(as_of) - F.make_interval(days=F.lit(days))
    gone = (F.col("fetched_at") < cutoff) & F.col("status").isin("detected", "filtered")
    return F.coalesce(gone, F.lit(False))


def survivors(table: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    return table.filter(~expired(as_of, days))


def expired_count(table: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    return table.agg(F.count_if(expired(as_of, days)).alias("deleted"))


def last_verdicts(verdicts: DataFrame, order: str = "seq") -> DataFrame:
    """One verdict per listing, the last one written."""
    fields = [c for c in verdicts.columns if c not in ("job_id", order)]
    return verdicts.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), F.col(order)).alias("v")).select("job_id", "v.*")


def apply_verdicts(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach classifier verdicts to detected listings; a negative one filters.

    ``verdicts`` holds one row per listing (see :func:`last_verdicts`).
    Listings without a verdict stay as they are.
    """
    v = verdicts.select(
        "job_id", F.col("suitable").alias("_suitable"),
        F.col("experience_required").alias("_experience"), F.col("reason").alias("_reason"))
    asked = (F.col("status") == "detected") & F.col("_suitable").isNotNull()
    rejected = asked & ~F.col("_suitable")
    out = scored.join(v, "job_id", "left")
    return out.withColumns({
        "llm_suitable": F.when(asked, F.col("_suitable")),
        "llm_experience_required": F.when(asked, F.col("_experience")),
        "llm_reason": F.when(asked, F.col("_reason")).otherwise(
            F.col("llm_reason") if "llm_reason" in scored.columns else F.lit(None).cast("string")),
        "filter_reason": F.when(rejected, "experience").otherwise(F.col("filter_reason")),
        "status": F.when(rejected, "filtered").otherwise(F.col("status")),
    }).drop("_suitable", "_experience", "_reason")


def pending_alerts(top: DataFrame, notified) -> DataFrame:
    """Top matches nobody was told about, with the rendered message.

    ``notified`` is a frame of ids or an id index.
    """
    return alerts_for(new_only(top, notified))


def alerts_for(todo: DataFrame) -> DataFrame:
    row = {c: F.col(c) for c in todo.columns}
    row.setdefault("llm_experience_required", F.lit(None).cast("string"))
    return todo.withColumn("message", alerts.alert_message(row))
