"""First-wins deduplication, per-group caps, anti joins and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsift.session import stored

Key = str | Column

#: Keys of leading rows are sent to all tasks up to this many.
SENT_KEYS = 500_000


def cap_per_group(df: DataFrame, keys: Sequence[Key], order: Sequence[Key], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Spark keeps only ``n`` rows per group and task before the shuffle
    (WindowGroupLimit), so a group holding a third of all rows still sends at
    most ``n`` rows per task to its reducer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def first_wins(df: DataFrame, keys: Sequence[Key], order: Sequence[Key]) -> DataFrame:
    """One row per key: the first in ``order``, never an arbitrary one."""
    return cap_per_group(df, keys, order, 1)


def leading(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that :func:`first_wins` chooses from, without the columns of others being computed.

    Keys and order are grouped on their own and sent to the rows, which stay where they are, so costly columns
    that follow are made for leading rows only.  Rows that agree in both all stay.  With more than
    ``SENT_KEYS`` different keys nothing is left out, as the rows would have to move.
    """
    at = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    # as text files of ids are narrow, writing them costs less than making them twice
    first = stored(df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.min(at).alias("_at")), "leading")
    if first.limit(SENT_KEYS + 1).count() > SENT_KEYS:
        return df
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_at._{i}"))
    return df.join(F.broadcast(first), same, "left_semi")


def by_title_company(sep: str = "_", fold_case: bool = False) -> list[Column]:
    title, company = F.col("title"), F.col("company")
    if fold_case:
        title, company = F.lower(title), F.lower(company)
    return [F.concat_ws(sep, title, company)]


def new_only(batch: DataFrame, known, key: str = "job_id") -> DataFrame:
    """Rows of ``batch`` whose key is not in ``known``, a frame or an id index.

    No broadcast hint: adaptive execution broadcasts ``known`` when its
    measured size allows and shuffles otherwise.  A batch that went through
    :func:`first_wins` on the same key is already partitioned for the join.  An
    index answers without moving what it stores.
    """
    if not isinstance(known, DataFrame):
        return known.new_only(batch, key)
    return batch.join(known.select(key), key, "left_anti")


def known_only(batch: DataFrame, known: DataFrame, key: str = "job_id") -> DataFrame:
    return batch.join(known.select(key), key, "left_semi")


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def union_keys(history: DataFrame, sent: DataFrame, key: str = "id") -> DataFrame:
    return history.select(key).union(sent.select(key)).distinct()


def fresh_listings(batch: DataFrame, known, order: Sequence[Key]) -> DataFrame:
    """First row per ``job_id`` of a batch, without the listings already stored.

    With an id index only ids and order are grouped and looked up; whole rows move for the
    ids that turn out to be new.
    """
    if isinstance(known, DataFrame):
        return new_only(first_wins(batch, ["job_id"], order), known)
    places = [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.struct(*[p.alias(f"_{i}") for i, p in enumerate(places)])
    new = known.new_only(batch.groupBy("job_id").agg(F.min(at).alias("_at")))
    new = new.select(F.col("job_id").alias("_id"), "_at")
    rows = batch.withColumn("_here", at).join(
        new, (F.col("job_id") == F.col("_id")) & F.col("_here").eqNullSafe(F.col("_at")), "left_semi")
    return first_wins(rows.drop("_here"), ["job_id"], order)


def insertable(batch: DataFrame, table, order: Sequence[Key]) -> DataFrame:
    """The rows an insert-or-ignore would add; their count is the true insert count."""
    return fresh_listings(batch, table, order)
