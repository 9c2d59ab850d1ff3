import math

import pytest
from pyspark.sql import functions as F

from boardsift.config import AGE_BASE, AGE_V1, AGE_V2
from boardsift.functions.age import age_hours, epoch_age_hours

AS_OF = "2024-01-31 00:00:00"
INF = math.inf
# text, v2, base, v1
CASES = [
    (None, 24, INF, INF),
    ("", 24, INF, INF),
    ("   ", 24, 12, INF),
    ("Just posted", 0, 0, 0),
    ("30 seconds ago", 0, 0, 0),
    ("a few hours ago", 0, 0, 0),  # v2 knows "few", the others read no number
    ("5 minutes ago", 5 / 60, 5 / 60, 5 / 60),
    ("1 hour 5 minutes ago", 0.25, 0.25, 0.25),  # digits before the unit run together
    ("3 hours ago", 3, 3, 3),
    ("an hour ago", 0, 0, 0),
    ("Today", 6, 6, 3),
    ("Yesterday", 30, 30, 30),
    ("2 days ago", 48, 48, 48),
    ("2 days", 48, 48, 3),  # v1 needs "ago"
    ("30+ days ago", 720, 720, 720),
    ("1 week 3 days", 13 * 24, 13 * 24, INF),
    ("2 weeks ago", 336, INF, INF),
    ("a week ago", 168, INF, INF),
    ("3 months ago", INF, INF, INF),
    ("1 year ago", INF, 12, 3),
    ("2024-01-30", 24, 24, 12),
    ("2024-01-30T12:00:00Z", 24, 24, 12),
    ("2024-01-30T12:00:00.123+00:00", 24, 24, 12),
    ("2024-01-30T12:00:00", 24, 24, 12),  # without a zone v1 reads the date only
    ("2024-1-5", 24, 624, 612),  # v2 wants ten characters
    ("2025-06-01", 0, 0, 0),
    ("2024-02-30", 24, 12, 3),
    ("Tue, 30 Jan 2024 10:00:00 GMT", 24, 12, 3),
    ("1706616000", 12, 12, 12),
    ("1706616000000", 12, 12, 3),
    ("Recent", 24, 12, 3),
    ("whenever", 24, 12, 3),
]


@pytest.mark.parametrize("policy,column", [(AGE_V2, 1), (AGE_BASE, 2), (AGE_V1, 3)])
def test_every_branch(value, policy, column):
    got = value(lambda c: age_hours("x", AS_OF, policy), [c[0] for c in CASES])
    want = [c[column] for c in CASES]
    bad = [(c[0], g, w) for c, g, w in zip(CASES, got, want) if g != pytest.approx(w)]
    assert not bad


def test_huge_numbers_do_not_fail(value):
    got = value(lambda c: age_hours("x", AS_OF), ["9" * 40 + " hours ago", "9" * 30])
    assert got == [pytest.approx(1e40), 24.0]


def test_numeric_epoch(spark):
    df = spark.sql("SELECT 1706616000L AS a, CAST(NULL AS BIGINT) AS b, 99999999999999L AS c")
    row = df.select(*[epoch_age_hours(F.col(c), AS_OF) for c in "abc"]).first()
    assert list(row) == [12.0, INF, INF]
