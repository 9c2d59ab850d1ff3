import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boardsift.config import MatchConfig, TaggedConfig
from boardsift.operators import score, semantic
from boardsift.operators.tfidf import default_stop_words, with_tfidf

CFG = MatchConfig()
FIELDS = "title STRING, location STRING, description STRING, posted STRING, sim DOUBLE"
LONG = " filler words to make the text long enough for a score"


def scored(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + FIELDS)
    return score.score_listings(df, "2024-01-31 00:00:00", CFG, "sim").orderBy("i").collect()


def test_reasons_follow_their_order(spark):
    got = scored(
        spark, ("Sales", "London", "x", "2 weeks ago", None), ("Sales", "Pune", "x", "2 weeks ago", None),
        ("Data", "Pune", "x", "2 weeks ago", None), ("Data", "Pune", "x", "today", None),
        ("Data Scientist", "Pune", "python sql" + LONG, "today", 0.9))
    assert [r.filter_reason for r in got] == ["location", "title", "age", "score", None]
    assert [r.status for r in got] == ["filtered"] * 4 + ["detected"]


def test_score_arithmetic(spark):
    text = "python sql" + LONG
    got = scored(
        spark, ("Data", "Pune", text, None, None), ("Data", "Pune", text, None, 0.5),
        ("Data", "London", text, None, 0.5), ("Sales", "Pune", text, None, 0.5),
        ("Clerk", "London", text, None, 0.9), ("Data", "Pune", "sql", None, 0.9))
    kw = 0.1
    assert [r.semantic_score for r in got] == pytest.approx([0.08, 0.5, 0.5, 0.5, 0.9, 0.0])
    assert [r.combined_score for r in got] == pytest.approx([
        0.88 * kw, 0.34, 0.34 * 0.3, 0.0, (0.58 - 0.3) * 0.3, 0.4 * 0.05], abs=1e-4)


def test_keyword_score_is_capped(spark):
    everything = " ".join(CFG.skill_weights)
    assert scored(spark, ("Data", "Pune", everything, None, None))[0].keyword_score == 1.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None)], "i INT, v ARRAY<FLOAT>")
    best = df.orderBy("i").select(semantic.best_similarity(F.col("v"), [[1.0, 0.0], [0.0, 1.0]])).collect()
    assert [r[0] for r in best][:2] == pytest.approx([1.0, 0.8])
    assert best[2][0] is None
    none = df.orderBy("i").select(semantic.best_similarity(F.col("v"), [])).collect()
    assert [r[0] for r in none] == [0.0, 0.0, None]


def brute_tfidf(profile, text, stop, limit=3000):
    def terms(x):
        words = [w for w in re.findall(r"\w\w+", x.lower()) if w not in stop]
        return Counter(words + [" ".join(p) for p in zip(words, words[1:])])

    a, b = terms(profile), terms(text)
    every = sorted(set(a) | set(b), key=lambda t: (-(a[t] + b[t]), t))[:limit]
    idf = {t: 1.0 if a[t] and b[t] else 1 + math.log(1.5) for t in every}
    va, vb = ([c[t] * idf[t] for t in every] for c in (a, b))
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (va, vb))
    return 50 * sum(x * y for x, y in zip(va, vb)) / (na * nb) if na and nb else 0.0


@pytest.mark.parametrize("limit", [3000, 40])
def test_tfidf_equals_brute_force(spark, limit):
    rng = random.Random(7)
    words = ["sql", "the", "data", "été", "x", "of", "python_3", "ml"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(60)]
    profiles = {"a": "SQL data data python_3, the ML of w1 w2", "b": "été w3 w4 w5"}
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(99, "sql", "none")]
    df = spark.createDataFrame(rows, "i INT, x STRING, tag STRING")
    got = with_tfidf(df, "x", profiles, "tag", ["the", "of"], TaggedConfig(max_features=limit))
    got = {r.i: r.tfidf for r in got.collect()}
    for i, t, tag in rows[:-1]:
        assert got[i] == pytest.approx(brute_tfidf(profiles[tag], t, {"the", "of"}, limit)), (i, t)
    assert got[99] == 0.0


def test_default_stop_words(spark):
    assert {"the", "and", "of"} <= set(default_stop_words())


def test_tags_repeat_a_listing(spark):
    df = spark.createDataFrame([("Data Scientist in Tableau", ""), ("Cook", "")],
                               "title STRING, description STRING")
    got = score.tag_listings(df, TaggedConfig().tags).select("tag").collect()
    assert sorted(r[0] for r in got) == ["BI Developer", "Data Science"]


def test_similarity_to_a_table_of_profiles(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, -2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0]), (6, [3.0, 4.0]), (7, [])]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<FLOAT>")
    profiles = spark.createDataFrame(
        [([2.0, 1.0],), ([-1.0, 3.0],), ([-1.0, 3.0],), (None,), ([9.0, None],), ([1.0, 2.0, 3.0],)], "embedding ARRAY<FLOAT>")

    def run(p, **more):
        return {r.id: r.similarity for r in semantic.with_similarity(df, "v", p, **more).collect()}

    want = {0: 2.0, 1: -2.0, 2: None, 3: None, 4: None, 5: None, 6: 10.0, 7: None}
    assert run(profiles) == want
    assert run(profiles, max_bytes=20) == want  # in several passes
    assert run(profiles.limit(0)) == {**dict.fromkeys(range(8), 0.0), 2: None}
    with pytest.raises(ValueError):
        semantic.profile_vectors(profiles, limit=3)


def test_plan_does_not_grow_with_the_profiles(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    def plan(n):
        return semantic.with_similarity(vectors, "embedding", vectors.limit(n))._jdf.queryExecution().toString()

    assert abs(len(plan(400)) - len(plan(4))) < 50


def test_terms_are_counted_before_the_tags(spark):
    df = spark.createDataFrame([("Python data", "c", "python sql tableau " * 5), ("Cook", "c", "soup")],
                               "title STRING, company STRING, description STRING")
    tags, profiles = {"a": ["python"], "b": ["sql"], "c": ["tableau"]}, {"a": "python sql", "b": "sql", "c": "tableau python"}
    one = score.score_by_tag(df, tags, profiles, TaggedConfig(), [])
    two = score.score_tagged(score.tag_listings(df, tags), profiles, TaggedConfig(), [])
    assert one.count() == 3 and sorted(one.select(*two.columns).collect()) == sorted(two.collect())
    text = one._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1
    assert text.index("Generate explode") < text.index("regexp_extract_all")
