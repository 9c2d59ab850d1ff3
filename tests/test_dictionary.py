"""Terms found in one scan against a plain substring test of each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from boardsift.functions import dictionary, text

ALPHABET = "aab. +#(é😀|\\x[]^-'B"


def random_case(rng):
    def word(n):
        return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(n)))

    terms = [word(5) for _ in range(rng.randrange(1, 25))]
    return terms, word(60)


def test_thousand_random_lists(spark):
    """Overlapping terms, terms within terms, the empty term and characters that patterns use."""
    import re

    rng = random.Random(4)
    for _ in range(1000):
        terms, body = random_case(rng)
        if "😀" not in body and "\\" not in "".join(terms):  # the same pattern in another engine
            pattern = re.compile(f"(?=({dictionary.pattern(terms)}))")
            longest = {m[1] for m in pattern.finditer(body)}
            also = dictionary.shorter_terms(terms)
            assert {p for t in longest for p in also.get(t, [t])} == {t for t in terms if t in body}


def test_random_lists_in_spark(spark):
    rng = random.Random(5)
    cases = [random_case(rng) for _ in range(25)]
    df = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(cases)] + [(99, None), (98, "")], "i int, body string")
    texts = {i: b for i, b in df.collect()}
    got = df.select("i", *(dictionary.present(F.col("body"), t).alias(f"p{k}") for k, (t, _) in enumerate(cases)),
                    *(dictionary.any_present(F.col("body"), t).alias(f"a{k}") for k, (t, _) in enumerate(cases))).collect()
    for row in got:
        body = texts[row.i]
        for k, (terms, _) in enumerate(cases):
            if body is None:
                assert row[f"p{k}"] is None and row[f"a{k}"] is None
            else:
                want = {t for t in terms if t in body}
                assert set(row[f"p{k}"]) == want and len(row[f"p{k}"]) == len(want), (terms, body)
                assert row[f"a{k}"] == bool(want)


def test_no_terms(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = df.select(dictionary.present(F.col("t"), []), dictionary.any_present(F.col("t"), [])).collect()
    assert [tuple(r) for r in got][0] == ([], False)


def test_long_lists_take_one_scan_with_the_same_result(spark, monkeypatch):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randrange(2, 6))) for _ in range(300)})
    rng.shuffle(terms)
    weights = {t: round(rng.random(), 3) for t in terms}
    points = {t: rng.randrange(9) for t in terms}
    df = spark.createDataFrame([("".join(rng.choice("abcd ") for _ in range(n)),) for n in range(60)] + [(None,)], "x string")

    def run():
        return df.select("x", text.any_term("x", terms[:250]).alias("a"), text.weighted_terms("x", weights).alias("w"),
                         text.weighted_terms("x", points).alias("p"), text.matched_terms("x", terms).alias("m"),
                         text.first_label("x", [("one", terms[:210]), ("two", terms[210:])], "none").alias("l"))

    one = run()
    assert "RLIKE" in one._jdf.queryExecution().toString() and "regexp_extract_all" in one._jdf.queryExecution().toString()
    fast = one.collect()
    monkeypatch.setattr(text, "ONE_SCAN", 10**9)
    assert fast == run().collect()


def test_chunks_of_a_long_dictionary(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "CHUNK", 3)
    df = spark.createDataFrame([("abcde",)], "t string")
    terms = ["a", "ab", "abc", "abcd", "bc", "bcd", "cde", "x"]
    assert sorted(df.select(dictionary.present(F.col("t"), terms)).first()[0]) == terms[:-1]


def test_time_hardly_grows_with_the_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").cache()
    docs.count()
    rng = random.Random(7)
    many = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(6)) for _ in range(4000)]

    def seconds(terms):
        df = docs.select(dictionary.present(F.col("text"), terms))
        best = 9e9
        for _ in range(3):
            begin = time.time()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - begin)
        return best

    few, all_ = seconds(many[:100]), seconds(many)
    docs.unpersist()
    assert all_ < 8 * few + 1.0  # forty times the terms


@pytest.mark.parametrize("terms", [["a", "b"], ["ab", "abc", "b"]])
def test_occurrences_join_the_entries(spark, terms):
    df = spark.createDataFrame([(1, "xabcx"), (2, None), (3, "b")], "i int, t string")
    entries = spark.createDataFrame([(t, k) for k, t in enumerate(terms)] + [(None, 9), (terms[0], 7)], "term string, w int")
    got = sorted(tuple(r) for r in dictionary.occurrences(df, "t", entries, "term", "i").collect())
    want = [(i, t, w) for i, b in [(1, "xabcx"), (3, "b")] for t, w in [*((t, k) for k, t in enumerate(terms)), (terms[0], 7)] if t in b]
    assert got == sorted(want)
