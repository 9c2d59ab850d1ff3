import pytest
from pyspark.sql import functions as F

from boardsift.config import MatchConfig
from boardsift.functions import alerts, rules
from boardsift.operators import score

CFG = MatchConfig()


def place(spark, rows, cfg=CFG):
    df = spark.createDataFrame([(i, "t", *r) for i, r in enumerate(rows)],
                               "i INT, title STRING, location STRING, description STRING")
    df = score.with_location(score.with_match_texts(df), cfg)
    return [tuple(r) for r in df.orderBy("i").select("is_india", "is_remote", "city").collect()]


def test_location_branches(spark):
    got = place(spark, [
        ("Pune, India", ""), ("Remote", ""), ("Unknown", "in london"), ("London", ""),
        ("Mars", ""), ("Remote - US only", ""), ("Gurugram", ""), ("London", "bengaluru office"),
        ("Berlin, Germany", "work from home"), (" N/A ", "usa"), ("Kolkata, USA", "")])
    assert got == [
        (True, False, "Pune"), (True, True, None), (True, False, None), (False, False, None),
        (True, False, None), (True, True, None), (True, False, "Gurgaon"),
        (True, False, "Bangalore"), (True, True, None), (True, False, None),
        (False, False, "Kolkata")]


def test_substring_reading_of_places(spark):
    # "ncr" sits in "increase", "uk" in "ukraine", "apac" in "capacity"
    got = place(spark, [("London", "increase"), ("Ukraine", ""), ("London", "capacity")])
    assert [g[0] for g in got] == [True, False, True]


def test_strict_exclusion(spark):
    cfg = MatchConfig(strict_exclusion=True)
    got = place(spark, [("Remote - US only", ""), ("Remote", ""), ("Pune", "us only"), ("Mars", "")], cfg)
    assert [g[0] for g in got] == [False, True, True, True]


def test_title_penalty(value):
    got = value(lambda c: rules.title_penalty("x", CFG), [
        "data scientist", "sales data lead", "office clerk", "healthcare data", "contractor data"])
    assert got == [0.0, -0.5, -0.3, -0.5, -0.5]  # "ca" and "cto" hit inside words


def test_category_order(value):
    got = value(lambda c: rules.category("x", CFG), [
        "data scientist with deep learning", "data scientist, spark", "analytics with spark",
        "analytics in tableau", "business analyst", "cook"])
    assert got == ["ML Engineering", "Data Science", "Data Engineering", "BI Developer",
                   "Data Analytics", "Other"]


def experience(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, t STRING, b STRING")
    reason = rules.experience_reason("t", "b", 8)
    df = df.select("i", reason.alias("r")).withColumn("ok", rules.experience_suitable(F.col("r")))
    return [tuple(r) for r in df.orderBy("i").select("ok", "r").collect()]


def test_experience_rules(spark):
    none = "No clear senior requirement found"
    got = experience(spark, [
        ("staff  engineer", "junior"), ("lead", "a junior, 10 years"), ("lead", "jr. analyst"),
        ("lead", "jr.analyst"), ("lead", "1 to 3 years"), ("lead", "5+ years"),
        ("lead", "5 years or 08 yrs or 12 years"), ("lead", "7 years"), ("15+ years lead", ""),
        ("lead", "freshers welcome"), ("lead", "no experience required"), ("lead", "early career"),
        ("architecture", ""), ("lead", "entry-level"), ("lead", "18years"), ("lead", "99999999999999999999 years")])
    assert got == [
        (False, "Senior role: 'staff  engineer'"), (True, "Junior-friendly: 'junior'"),
        (True, "Junior-friendly: 'jr'"), (True, "Junior-friendly: 'jr.'"),
        (True, "Junior-friendly: '1 to 3 years'"), (True, none),
        (False, "Requires 8+ years experience"), (True, none),
        (False, "Senior role: '15+ years'"), (True, "Junior-friendly: 'freshers welcome'"),
        (True, "Junior-friendly: 'no experience required'"), (True, "Junior-friendly: 'early career'"),
        (True, none), (True, "Junior-friendly: 'entry-level'"),
        (False, "Requires 18+ years experience"),
        (False, "Requires 99999999999999999999+ years experience")]


@pytest.mark.parametrize("n", [1, 5, 8, 9, 10, 42, 99])
def test_number_pattern(value, n):
    numbers = [str(x) for x in range(0, 1200, 7)]
    got = value(lambda c: F.col("x").rlike(f"^({rules.number_at_least(n)})$"), numbers)
    assert got == [int(x) >= n for x in numbers]


def test_reply_parsing(value):
    replies = ['x {"suitable_for_junior": false, "reason": "r"} y', "nope", "{broken", "", None, "{}",
               '{"a": {"b": 1}, "experience_required": "2 years"}']
    got = value(lambda c: F.struct(*[v.alias(k) for k, v in alerts.verdict_fields(c).items()]), replies)
    assert [tuple(g) for g in got] == [
        (False, "Not specified", "r", 0.8),
        (True, None, alerts.BAD_REPLY, 0.0), (True, None, alerts.BAD_REPLY, 0.0),
        (True, None, alerts.NO_REPLY, 0.0), (True, None, alerts.NO_REPLY, 0.0),
        (True, None, alerts.BAD_REPLY, 0.0), (True, "2 years", "", 0.8)]


def test_alert_escapes_and_skips_empty_lines(spark):
    df = spark.sql("""SELECT 0.719D AS combined_score, 'Data Science' AS category, 'A<b>' AS title, 'C' AS company,
      '' AS city, 'Pune' AS location, true AS is_remote, 'S' AS source, '' AS posted, CAST(NULL AS STRING) AS salary,
      '2 years' AS llm_experience_required, 'http://x?a=1&b="2"' AS url""")
    got = df.select(alerts.alert_message({c: F.col(c) for c in df.columns})).first()[0]
    assert got == ('🔥 <b>🧪 DS - 71% Match</b>\n\n💼 <b>A&lt;b&gt;</b>\n🏢 C\n📍 🏠 Remote / Pune\n🌐 S\n'
                   '📋 Exp: 2 years\n\n<a href="http://x?a=1&amp;b=&quot;2&quot;">🔗 Apply Now</a>')
