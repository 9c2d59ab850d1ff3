"""Spans of patterns inside a text as arrays, without leaving the row."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.llm.common import running_sum_of

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: leftmost non-overlapping matches of ``pattern`` that pass ``keep``.

    ``probe`` is a cheap necessary test of the whole text; ``group`` is what ``keep`` sees.
    """

    name: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    probe: Callable[[Column], Column] | None = None
    group: int = 0


def with_spans(df: DataFrame, text: str, kinds: list[Kind], prefix: str = "spans_") -> DataFrame:
    """Adds ``<prefix><kind>``: start and end (code points, end exclusive) and value of each match.

    ``split`` gives the gaps and ``regexp_extract_all`` the matches of the same search, so a
    match starts where all gaps and matches before it end.
    """
    x = F.col(text)
    none = F.array().cast("array<string>")
    for kind in kinds:
        found = kind.probe(x) if kind.probe else x.rlike(kind.pattern)
        p = F.lit(kind.pattern)
        df = (
            df.withColumn("_hit", found)
            .withColumn("_m", F.when(F.col("_hit"), F.regexp_extract_all(x, p, F.lit(0))).otherwise(none))
            .withColumn("_g", F.when(F.size("_m") > 0, F.split(x, kind.pattern, -1)).otherwise(none))
        )
        if kind.group:
            df = df.withColumn("_k", F.when(F.size("_m") > 0, F.regexp_extract_all(
                x, p, F.lit(kind.group))).otherwise(none))
        m, g = F.col("_m"), F.col("_g")
        # arrays are arguments here, not captured by lambdas, so none is computed for each element
        before = F.concat(F.array(F.lit(0)), F.transform(m, F.char_length))
        ends = running_sum_of(F.zip_with(g, before, lambda a, b: F.char_length(a) + b))
        df = df.withColumn("_s", F.when(F.size(m) > 0, ends).otherwise(F.array().cast("array<bigint>")))
        zipped = F.arrays_zip(m.alias("v"), F.slice(F.col("_s"), F.lit(1), F.size(m)).alias("s"),
                              F.col("_k" if kind.group else "_m").alias("k"))
        spans = F.transform(zipped, lambda z: F.struct(
            z["s"].alias("start"), (z["s"] + F.char_length(z["v"])).alias("end"), z["v"].alias("value"),
            z["k"].alias("key")))
        if kind.keep:
            spans = F.filter(spans, lambda z: kind.keep(z["key"]))
        spans = F.when(F.size(m) > 0, spans.cast(
            "array<struct<start:bigint,end:bigint,value:string,key:string>>")).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint,value:string,key:string>>"))
        df = df.withColumn(prefix + kind.name, F.transform(spans, lambda z: F.struct(
            z["start"].alias("start"), z["end"].alias("end"), z["value"].alias("value"))))
    return df.drop("_hit", "_m", "_g", "_k", "_s")


def _ranked(spans: Column, name: str, rank: int) -> Column:
    return F.transform(spans, lambda z: F.struct(
        z["start"].alias("start"), F.lit(rank).alias("rank"), z["end"].alias("end"), F.lit(name).alias("kind")))


def merged(columns: list[tuple[str, Column]]) -> Column:
    """The spans of all kinds by start, then by the order of the kinds."""
    return F.sort_array(F.concat(*(_ranked(c, name, k) for k, (name, c) in enumerate(columns))))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda z: z["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of merged spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(
        ":", z["kind"], z["start"].cast("string"), z["end"].cast("string"))), ",")


def replaced(text: Column, gaps: Column, matches: Column, new: Callable[[Column], Column]) -> Column:
    """The text with each match exchanged for ``new(match)``."""
    return F.when(F.size(matches) > 0, F.array_join(F.zip_with(
        gaps, F.transform(matches, new), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")).otherwise(text)
