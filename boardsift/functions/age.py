"""Posting time text to age in hours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsift.config import AGE_V2, AgePolicy
from boardsift.functions.text import SPACE_CHARS, quoted

INFINITE = float("inf")
LAST_EPOCH_SECOND = 253402300799.0  # end of year 9999
DATE = r"^[0-9]{4}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9])$"
STAMP_FORMAT = "y-M-d'T'H:m:s"
DATE_TIME = DATE[:-1] + r"T(2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]$"


def timestamp_literal(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6) / F.lit(3600.0)


# The rule is written as SQL text: one parsed expression is much cheaper to
# build than hundreds of column calls.  ``t.raw`` is the text, ``t.low`` its
# lower-cased form and ``t.now`` the time of the run.


def _hours(x: float | None) -> str:
    return "DOUBLE('Infinity')" if x is None else f"{float(x)!r}D"


def _says(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t.low, {quoted(w)})" for w in words) + ")"


def _number_before(unit: str, empty: float = 0.0) -> str:
    """All digits left of the unit, read as one number."""
    digits = f"regexp_replace(substring_index(t.low, '{unit}', 1), '[^0-9]', '')"
    return f"coalesce(CAST(nullif({digits}, '') AS DOUBLE), {_hours(empty)})"


def _age(moment: str, shift: float = 0.0) -> str:
    """NULL when the moment did not parse; never negative."""
    hours = f"(unix_micros(t.now) - unix_micros({moment})) / 1e6D / 3600D"
    # greatest() skips NULL, so the test for an unparsed moment comes first.
    return f"IF({moment} IS NULL, NULL, greatest(0D, {hours} - {_hours(shift)}))"


def _date(text: str) -> str:
    return f"IF({text} RLIKE {quoted(DATE)}, try_to_timestamp({text}, 'y-M-d'), NULL)"


def _iso_age(policy: AgePolicy) -> str:
    has_t, has_dash = "contains(t.raw, 'T')", "contains(t.raw, '-')"
    if policy.iso_min_length:
        has_dash = f"({has_dash} AND length(t.raw) >= {policy.iso_min_length})"
    day = f"IF({has_t}, substring_index(t.raw, 'T', 1), substring(t.raw, 1, 10))"
    if not policy.iso_time:
        age = _age(_date(f"substring_index({day}, '+', 1)"))
        return f"IF({has_t} OR {has_dash}, {age}, NULL)"
    zoned = f"{has_t} AND (contains(t.raw, '+') OR contains(t.raw, 'Z'))"
    stamp = "substring_index(substring_index(substring_index(t.raw, '+', 1), 'Z', 1), '.', 1)"
    moment = (f"IF({zoned} AND {stamp} RLIKE {quoted(DATE_TIME)}, "
              f"try_to_timestamp({stamp}, {quoted(STAMP_FORMAT)}), NULL)")
    dated = f"IF({has_dash}, {_age(_date(day), policy.date_shift)}, NULL)"
    return f"coalesce({_age(moment)}, {dated})"


def _epoch_age(policy: AgePolicy) -> str:
    value = "IF(t.raw RLIKE '^[0-9]{10,}$', CAST(t.raw AS DOUBLE), NULL)"
    if policy.epoch == "auto":
        value = f"IF({value} > 1e12D, {value} / 1000D, {value})"
    moment = f"IF({value} <= {_hours(LAST_EPOCH_SECOND)}, CAST({value} AS TIMESTAMP), NULL)"
    return _age(moment)


def _rule(policy: AgePolicy) -> str:
    """The order of the tests is part of the meaning."""
    day = _says("day") + (f" AND {_says('ago')}" if policy.day_needs_ago else "")
    weeks = _hours(None)
    if policy.week_hours is not None:
        weeks = f"{_number_before('week', 1.0)} * {_hours(policy.week_hours)}"
    parsed = [_iso_age(policy)] + ([_epoch_age(policy)] if policy.epoch else [])
    tests = [
        ("t.raw IS NULL OR t.raw = ''", _hours(policy.empty)),
        (_says(*policy.now_words), "0D"),
        (_says("minute"), f"{_number_before('minute')} / 60D"),
        (_says("hour"), _number_before("hour")),
        (_says("today"), _hours(policy.today)),
        (_says("yesterday"), "30D"),
        (day, f"{_number_before('day')} * 24D"),
        (_says("week"), weeks),
        (_says(*policy.old_words), _hours(None)),
    ]
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in tests)
    return f"CASE {whens} ELSE coalesce({', '.join(parsed)}, {_hours(policy.unparsed)}) END"


def age_hours(posted: str, as_of: datetime | str, policy: AgePolicy = AGE_V2) -> Column:
    """Age in hours of a listing; ``posted`` is a column name or SQL.

    The texts are bound once as the fields of a one-element array: the tests
    refer to them dozens of times, and unfolding them would multiply whatever
    expression ``posted`` stands for.
    """
    blank = quoted(SPACE_CHARS)
    text = f"CAST({posted} AS STRING)"
    raw = f"btrim({text}, {blank})" if policy.strip_first else text
    bound = (f"struct({raw} AS raw, lower(btrim({text}, {blank})) AS low, "
             f"TIMESTAMP {quoted(str(as_of))} AS now)")
    return F.expr(f"get(transform(array({bound}), t -> {_rule(policy)}), 0)")


def epoch_age_hours(seconds: Column, as_of: datetime | str | Column) -> Column:
    """Age of a numeric posting time; NULL counts as too old."""
    moment = F.when(seconds <= F.lit(LAST_EPOCH_SECOND), seconds.cast("double").cast("timestamp"))
    age = F.greatest(F.lit(0.0), hours_between(timestamp_literal(as_of), moment))
    return F.when(moment.isNull(), F.lit(INFINITE)).otherwise(age)
