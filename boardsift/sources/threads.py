"""Choosing the hiring thread whose comments are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions.text import quoted

# Titles of hiring threads.
HIRING_TITLES = ("Who is hiring", "Who's hiring")


def pick_thread(searches: DataFrame, as_of: str, dated: bool = True) -> DataFrame:
    """The thread of each search response: the first hiring hit of this month,
    last month or this year, else the first hiring hit.

    Months are read as names, last month as the month 30 days ago.  The choice
    is made inside the row of a response, so nothing is shuffled.
    """
    hiring = "(" + " OR ".join(f"contains(h.title, {quoted(t)})" for t in HIRING_TITLES) + ")"
    now = f"TIMESTAMP {quoted(as_of)}"
    months = [f"date_format({now}, 'MMMM')", f"date_format({now} - INTERVAL 30 DAYS, 'MMMM')",
              f"date_format({now}, 'yyyy')"]
    recent = "(" + " OR ".join(f"contains(h.title, {m})" for m in months) + ")"
    hits = "from_json(payload, 'struct<hits:array<struct<objectID:string,title:string>>>').hits"
    first = f"get(filter({hits}, h -> {hiring}), 0)"
    if dated:
        first = f"coalesce(get(filter({hits}, h -> {hiring} AND {recent}), 0), {first})"
    return (searches.select("ord", F.expr(first).alias("hit")).filter(F.col("hit").isNotNull())
            .select("ord", F.col("hit.objectID").alias("thread_id"), F.col("hit.title").alias("title")))
