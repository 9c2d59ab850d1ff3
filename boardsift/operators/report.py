"""Counts, funnel, usage, top lists and rotation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsift.config import MatchConfig
from boardsift.functions.age import timestamp_literal
from boardsift.functions.text import month_key

# ---------------------------------------------------------------- counts


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def count_by_source(df: DataFrame) -> DataFrame:
    return count_by(df, "source").orderBy(F.desc("n"), "source")


def average_score(places: int = 3) -> Column:
    """Mean of the positive scores, 0 when there is none."""
    positive = F.when(F.col("combined_score") > 0, F.col("combined_score"))
    return F.round(F.coalesce(F.avg(positive), F.lit(0.0)), places)


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_jobs"), average_score().alias("avg_score"))


def stats_object(df: DataFrame) -> DataFrame:
    """Totals, mean score and the count maps by status and by source in one row.

    One pass counts by (status, source); everything after works on that small
    table, so a map holds one entry per status or board and never per listing.
    """
    positive = F.when(F.col("combined_score") > 0, F.col("combined_score"))
    cells = df.groupBy("status", "source").agg(
        F.count("*").alias("n"), F.sum(positive).alias("s"), F.count(positive).alias("c"))

    def side(kind: str, s: Column, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key"), F.col("n"),
                        s.alias("s"), c.alias("c"))

    sides = cells.select(F.inline(F.array(
        side("status", F.col("s"), F.col("c")),
        side("source", F.lit(0.0), F.lit(0).cast("bigint")))))
    keys = sides.groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))

    def count_map(kind: str) -> Column:
        entry = F.when((F.col("kind") == kind) & F.col("key").isNotNull(), F.struct("key", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return keys.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "status", F.col("n"))), F.lit(0))
        .alias("total_jobs"),
        F.round(F.coalesce(F.try_divide(F.sum("s"), F.sum("c")), F.lit(0.0)), 3).alias("avg_score"),
        count_map("status").alias("by_status"),
        count_map("source").alias("by_source"),
    )


def funnel(scored: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Every funnel counter in one pass.

    ``filtered_score`` includes title rejects, and the age and score counters
    look at accessible listings only.
    """
    home, old = F.col("is_india"), F.col("age_hours") > cfg.max_age_hours
    by_experience = F.coalesce(F.col("filter_reason") == "experience", F.lit(False))
    dropped = (F.col("status") == "filtered") & ~by_experience
    matched = (F.col("status") == "detected") & home & (F.col("combined_score") >= cfg.min_score)
    score = F.when(matched, F.col("combined_score"))
    return scored.agg(
        F.count("*").alias("total_new"),
        F.count_if(~home).alias("filtered_location"),
        F.count_if(home & old).alias("filtered_age"),
        F.count_if(home & ~old & dropped).alias("filtered_score"),
        F.count_if(by_experience).alias("filtered_experience"),
        F.count_if(matched).alias("total_matched"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("best_score"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"),
    )


def tagged_funnel(scored: DataFrame, min_score: float) -> DataFrame:
    """Counters of the 0-100 scorer; the best score is over all new rows."""
    return scored.agg(
        F.count("*").alias("total_new"),
        F.count_if(F.col("score") >= min_score).alias("total_matched"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"),
    )


def joined_errors(log: DataFrame) -> DataFrame:
    """Errors of a run as one text, one line per board and message.

    Rows are reduced to distinct (run, source, error) first, so the list is
    bounded by the boards of a run.
    """
    lines = log.filter(F.col("error").isNotNull()).select(
        "run_id", F.concat_ws(": ", "source", "error").alias("line")).distinct()
    return lines.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("errors"))


def run_seconds(started: Column, completed: Column) -> Column:
    """Duration of a run, 0 while it is unfinished."""
    micros = F.unix_micros(completed) - F.unix_micros(started)
    return F.coalesce(micros / F.lit(1e6), F.lit(0.0))


# ---------------------------------------------------------------- metered calls


def calls_by_month(calls: DataFrame) -> DataFrame:
    return calls.groupBy("api_name", month_key(F.col("called_at")).alias("month")).agg(
        F.count("*").alias("call_count"), F.max("called_at").alias("last_call_at"))


def usage(calls: DataFrame, apis: DataFrame, as_of: datetime | str) -> DataFrame:
    """Calls of the month of ``as_of`` per API of ``apis``, 0 for an unused one."""
    month = month_key(timestamp_literal(as_of))
    used = calls_by_month(calls).filter(F.col("month") == month).select("api_name", "call_count")
    return apis.join(used, "api_name", "left").withColumn(
        "call_count", F.coalesce("call_count", F.lit(0)))


def quota_gate(used: DataFrame, limit: int | Column, per_run: int | Column = 3) -> DataFrame:
    """Calls each API may still make in this run."""
    left = F.greatest(F.lit(limit) - F.col("call_count"), F.lit(0))
    return used.withColumns({
        "remaining": left,
        "allowed": F.least(F.lit(per_run), left),
        "open": left > 0,
    })


@dataclass(frozen=True)
class Quota:
    """Calls a month and a run that the boards ``sources`` share, as answers of one metered API."""

    api: str
    sources: tuple[str, ...]
    limit: int
    per_run: int = 3


def api_of(source: Column, quotas: Sequence[Quota]) -> Column:
    """The metered API of a board, NULL for a free one."""
    named = F.lit(None).cast("string")
    for quota in quotas:
        named = F.when(source.isin(list(quota.sources)), quota.api).otherwise(named)
    return named


def unmetered(landing: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """The answers of boards without a quota; nothing is moved."""
    return landing.filter(api_of(F.col("source"), quotas).isNull())


def within_quota(landing: DataFrame, calls: DataFrame, quotas: Sequence[Quota], as_of: datetime | str,
                 order: Sequence[str] = ("ord", "source", "board", "keyword")) -> DataFrame:
    """The answers of metered APIs that the month's and the run's quota pay for, first ones first.

    ``calls`` holds the calls made before this run.  An API whose month is used up gives no row.
    The cut by ``per_run`` comes before the shuffle, so each task sends a few payloads per API.
    """
    apis = landing.sparkSession.createDataFrame(
        [(q.api, q.limit, q.per_run) for q in quotas], "api_name string, monthly bigint, per_run bigint")
    gate = quota_gate(usage(calls, apis, as_of), F.col("monthly"), F.col("per_run")).select("api_name", "allowed")
    w = Window.partitionBy("api_name").orderBy(*order)
    first = landing.withColumn("api_name", api_of(F.col("source"), quotas)).filter(
        F.col("api_name").isNotNull()).withColumn("_nth", F.row_number().over(w)).filter(
        F.col("_nth") <= max(q.per_run for q in quotas))
    return first.join(gate, "api_name").filter(F.col("_nth") <= F.col("allowed")).select(*landing.columns)


def call_events(answers: DataFrame, quotas: Sequence[Quota], as_of: datetime | str) -> DataFrame:
    """A call for each answer, ready to append to the log of calls."""
    return answers.select(
        api_of(F.col("source"), quotas).alias("api_name"),
        F.coalesce(F.col("fetched_at"), timestamp_literal(as_of)).alias("called_at"))


# ---------------------------------------------------------------- top lists


def matches(scored: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """All detected listings that are worth an alert."""
    return scored.filter((F.col("status") == "detected") & F.col("is_india")
                         & (F.col("combined_score") >= cfg.min_score))


def top_matches(scored: DataFrame, k: int = 20, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Best detected listings; equal scores are ordered by id, so runs agree."""
    return matches(scored, cfg).orderBy(F.desc("combined_score"), "job_id").limit(k)


def table_top_matches(table: DataFrame, k: int = 20, min_score: float = 0.3, *ties: str) -> DataFrame:
    return (table.filter((F.col("combined_score") >= min_score) & F.col("is_india"))
            .orderBy(F.desc("combined_score"), F.desc("fetched_at"), "job_id", *ties).limit(k))


def with_rows(top: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the wide columns of ``rows`` to a top list, fetched by id after the cut.

    ``by`` names the columns that tell rows apart.  A top list has at most as many rows as its limit, which
    Spark knows, so the list goes to the rows and no text is sorted or shuffled.
    """
    return top.join(rows.select(*by, *[c for c in rows.columns if c not in top.columns]), list(by))


def by_status(table: DataFrame, status: str, k: int = 100) -> DataFrame:
    return (table.filter(F.col("status") == status)
            .orderBy(F.desc("combined_score"), "job_id").limit(k))


def recent(table: DataFrame, as_of: datetime | str, hours: int = 24, k: int = 100) -> DataFrame:
    """The newest listings; of a table laid out by day only the last days are read."""
    cutoff = timestamp_literal(as_of) - F.make_interval(hours=F.lit(hours))
    if "fetched_date" in table.columns:
        table = table.filter(F.col("fetched_date") >= F.to_date(cutoff))
    return (table.filter(F.col("fetched_at") >= cutoff)
            .orderBy(F.desc("fetched_at"), "job_id").limit(k))


def top_tagged(scored: DataFrame, min_score: float, k: int = 15, *ties: str) -> DataFrame:
    return (scored.filter(F.col("score") >= min_score)
            .orderBy(F.desc("score"), "job_id_v1", "tag", *ties).limit(k))


def exists(table: DataFrame, job_id: str) -> DataFrame:
    """One row when the id is stored, none otherwise; reads the id column only."""
    return table.select("job_id").filter(F.col("job_id") == job_id).limit(1)


# ---------------------------------------------------------------- rotation


@dataclass(frozen=True)
class Rotation:
    """Which slice of a board list a run visits: ``width`` boards from
    ``width * slot``, where the slot follows the clock."""

    width: int
    hours: int
    quarters: bool = False

    def start(self, at: Column) -> Column:
        slot = F.hour(at) % self.hours
        if self.quarters:
            slot = slot * 4 + F.floor(F.minute(at) / 15).cast("int")
        return slot * self.width


# Slice widths and cycles of the board lists.
ROTATIONS = {
    "greenhouse": Rotation(width=15, hours=4, quarters=True),
    "greenhouse_short": Rotation(width=5, hours=4),
    "lever": Rotation(width=12, hours=4),
    "ashby": Rotation(width=5, hours=5),
}


def rotation_slice(boards: DataFrame, size: int, at: Column, rotation: Rotation,
                   pos: str = "pos") -> DataFrame:
    """Boards visited at time ``at`` (a literal or a column of ``boards``).

    A slice past the end of the list starts over with the first boards.
    """
    start = rotation.start(at)
    start = F.when(start >= size, F.lit(0)).otherwise(start)
    p = F.col(pos)
    return boards.filter((p >= start) & (p < start + rotation.width))


def rotating_group(groups: Sequence[Sequence[str]], day: Column) -> Column:
    """The keyword group of a day of the month."""
    return F.get(F.array(*[F.array(*[F.lit(w) for w in g]) for g in groups]), day % len(groups))


def run_hour_open(at: Column, hours: Sequence[int]) -> Column:
    return F.hour(at).isin(list(hours))
