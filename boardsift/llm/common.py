"""Reading the tables, shared folders, and small array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.session import small_batches, stored  # noqa: F401

#: Anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def running_sum_of(values: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array of ints, in linear time.

    Sums run inside chunks first and the chunks' totals are summed after that, so that no long
    array is copied for each element.  ``values`` is used once, as a lambda's argument.
    """
    return F.element_at(F.transform(F.array(values), lambda v: _chunked(v, chunk)), 1)


def _chunked(values: Column, chunk: int) -> Column:
    starts = F.when(F.size(values) > 0, F.sequence(
        F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda c: _scan(F.slice(values, c * chunk + 1, F.lit(chunk))))
    return F.element_at(F.transform(F.array(sums), lambda s: F.flatten(F.zip_with(
        s, _offsets(s), lambda part, o: F.transform(part, lambda x: x + o)))), 1)


def _scan(values: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(values, empty, lambda acc, x: F.concat(acc, F.array(
        F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))


def _offsets(sums: Column) -> Column:
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(sums, zero, lambda acc, s: F.concat(acc, F.array(
        F.element_at(acc, -1) + F.element_at(s, -1))), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))
