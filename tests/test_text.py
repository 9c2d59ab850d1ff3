import hashlib

import pytest
from pyspark.sql import functions as F

from boardsift.functions import text


def test_clean_string(value):
    got = value(text.clean_string, [None, "  a b\t", " x　", "", "é" * 300])
    assert got == ["Unknown", "a b", "x", "", "é" * 300]


def test_clean_description(value):
    got = value(text.clean_description, [
        None, "<p class='a'>One</p>  two\n\n three ", "1 < 2 and 3 > 2", "x" * 6000, "a\x1cb\x0bc"])
    assert got == ["", "One two three", "1 2", "x" * 6000, "a b c"]


def test_clean_url(value):
    assert value(text.clean_url, [None, " http://x ", ""]) == ["", "http://x", ""]


def test_match_text_keeps_unicode_words(value):
    got = value(text.match_text, ["C++ & C#, Node.js – Élan_1 (R-D)!", "<b>Hi</b>there", None])
    assert got == ["c++ c# node.js élan_1 r-d", "hi there", ""]


def test_ids(spark):
    df = spark.createDataFrame([("Data Scientist", "ACME", "Src")], "title STRING, company STRING, source STRING")
    cols = F.col("title"), F.col("company"), F.col("source")
    v2, v1 = df.select(text.job_id(*cols), text.job_id_v1(*cols)).first()
    plain = "Data Scientist_ACME_Src"
    assert v2 == hashlib.md5(plain.lower().encode()).hexdigest()[:16]
    assert v1 == hashlib.md5(plain.encode()).hexdigest()[:16]


def test_display_name(value):
    got = value(text.display_name, ["orca-security", "1password", "dbt-labs", "o'neil"])
    assert got == ["Orca Security", "1Password", "Dbt Labs", "O'Neil"]


@pytest.mark.parametrize("terms", [["bi", "ai"], ["bi", "ai"] + [f"zz{i}" for i in range(20)]])
def test_any_term_short_and_long_lists_agree(value, terms):
    got = value(lambda c: text.any_term("x", terms), ["mobile", "training", "none", None])
    assert got == [True, True, False, None]


def test_whole_words(value):
    got = value(lambda c: text.any_term("x", ["ai", "ml engineer"], "word"),
                ["training", "ai lead", "ml engineers", "an ml engineer.", "éai"])
    assert got == [False, True, False, True, False]


def test_weights_count_each_term_once(value):
    got = value(lambda c: text.weighted_terms("x", {"sql": 0.05, "sql server": 0.1}),
                ["sql sql", "sql server", "nothing"])
    assert got == pytest.approx([0.05, 0.15, 0.0])


def test_matched_terms_keep_order(value):
    assert value(lambda c: text.matched_terms("x", ["b", "a", "z"]), ["a b"]) == [["b", "a"]]


def test_job_type_list(spark):
    df = spark.sql("SELECT array('full', 'part') AS a, CAST(NULL AS ARRAY<STRING>) AS b")
    row = df.select(text.clean_job_type(F.col("a")), text.clean_job_type(F.col("b"))).first()
    assert list(row) == ["full, part", None]


def test_terms_with_quotes_and_backslashes(value):
    got = value(lambda c: text.any_term("x", ["it's", "a\\b"]), ["it's", "a\\b", "ab"])
    assert got == [True, True, False]


def test_terms_that_hold_another_are_not_looked_for():
    assert text.shortest(["remote", "fully remote", "apac", "remote", "remote-first"]) == ["remote", "apac"]
    assert text.shortest([]) == [] and text.shortest(["", "a"]) == [""]
