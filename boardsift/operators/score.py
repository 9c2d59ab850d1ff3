"""Listing scores and the status decision, as one chain of column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.config import AGE_V1, AGE_V2, AgePolicy, MatchConfig, TaggedConfig
from boardsift.functions import rules
from boardsift.functions.age import age_hours
from boardsift.functions.text import (
    any_keyword, match_text, round_score, weighted_terms)
from boardsift.operators.tfidf import with_term_vector, with_tfidf


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters must not unfold.

    Catalyst pushes a filter below a projection by copying the projected
    expressions into it; a score built from dozens of term tests would be
    copied many times over.  A one-row ``inline`` computes them once and lets
    no filter on them through.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))


def keyword_score(text: str, cfg: MatchConfig) -> Column:
    return F.least(weighted_terms(text, cfg.skill_weights, cfg.term_mode), F.lit(1.0))


def keyword_points(text: str, cfg: TaggedConfig) -> Column:
    return F.least(weighted_terms(text, cfg.skill_points), F.lit(cfg.keyword_cap))


def with_match_texts(df: DataFrame) -> DataFrame:
    """The texts that the rules read, each computed once per listing."""
    body = F.lower("description")
    return df.withColumns({
        "_skill_text": F.concat_ws(" ", match_text(F.col("title")), match_text(F.col("description"))),
        "_title": F.lower("title"),
        "_place": F.concat_ws(" ", F.lower("location"), body),
        "_body": F.concat_ws(" ", F.lower("title"), body),
    })


def with_location(df: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Add ``is_india``, ``is_remote`` and ``city``; needs :func:`with_match_texts`."""
    df = df.withColumns({
        "is_remote": rules.is_remote("_place", cfg), "city": rules.city("_place", cfg)})
    return df.withColumn("is_india", rules.is_accessible("location", "_place", "is_remote", cfg))


def semantic_score(text: Column, similarity: Column, keyword: Column, cfg: MatchConfig) -> Column:
    """Best similarity to a profile; without a vector the keyword score stands in."""
    stand_in = keyword * F.lit(cfg.keyword_as_semantic)
    return F.when(F.length(text) > cfg.min_text_length,
                  F.coalesce(similarity, stand_in)).otherwise(F.lit(0.0))


def combined_score(semantic: Column, keyword: Column, penalty: Column, home: Column,
                   cfg: MatchConfig) -> Column:
    score = semantic * F.lit(cfg.semantic_weight) + keyword * F.lit(cfg.keyword_weight)
    score = F.when(penalty < 0, F.greatest(F.lit(0.0), score + penalty)).otherwise(score)
    return F.when(home, score).otherwise(score * F.lit(cfg.foreign_factor))


def filter_reason(home: Column, penalty: Column, age: Column, score: Column,
                  cfg: MatchConfig) -> Column:
    """The first rule that rejects a listing, NULL when none does."""
    return (
        F.when(~home, "location")
        .when(penalty < 0, "title")
        .when(age > cfg.max_age_hours, "age")
        .when(score < cfg.min_score, "score")
    )


def score_listings(df: DataFrame, as_of: datetime | str, cfg: MatchConfig = MatchConfig(),
                   similarity: str | None = None, policy: AgePolicy = AGE_V2) -> DataFrame:
    """Score, classify and decide every listing; columns of ``df`` are kept.

    ``similarity`` names a nullable column with the best profile similarity.
    """
    sim = F.col(similarity) if similarity else F.lit(None).cast("double")
    df = with_location(with_match_texts(df), cfg).withColumns({
        "_penalty": rules.title_penalty("_title", cfg),
        "_keyword": keyword_score("_skill_text", cfg),
        "category": rules.category("_body", cfg),
        "age_hours": age_hours("posted", as_of, policy),
    })
    df = df.withColumn(
        "_semantic", semantic_score(F.col("_skill_text"), sim, F.col("_keyword"), cfg))
    df = df.withColumn("_score", combined_score(
        F.col("_semantic"), F.col("_keyword"), F.col("_penalty"), F.col("is_india"), cfg))
    df = df.withColumn("filter_reason", filter_reason(
        F.col("is_india"), F.col("_penalty"), F.col("age_hours"), F.col("_score"), cfg))
    df = settle(df.drop("_title", "_place", "_body"), {
        "status": F.when(F.col("filter_reason").isNull(), "detected").otherwise("filtered"),
        "filter_reason": F.col("filter_reason"),
        "category": F.col("category"),
        "is_india": F.col("is_india"),
        "is_remote": F.col("is_remote"),
        "city": F.col("city"),
        "age_hours": F.col("age_hours"),
        "semantic_score": round_score(F.col("_semantic")),
        "keyword_score": round_score(F.col("_keyword")),
        "combined_score": round_score(F.col("_score")),
    })
    return df.drop("_skill_text", "_penalty", "_keyword", "_semantic", "_score")


def tag_hits(tags: dict[str, list[str]], hay: str) -> Column:
    """The search configurations with a keyword in column ``hay``, in their order."""
    return F.array_compact(F.array(*[F.when(any_keyword(hay, words), F.lit(tag)) for tag, words in tags.items()]))


def tag_listings(df: DataFrame, tags: dict[str, list[str]],
                 columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """One row per listing and search configuration with a keyword hit.

    The configurations are a short literal list, so this is one map-side
    explode and neither a join nor a union of scans.
    """
    hay = df.withColumn("_hay", F.concat_ws(" ", *columns))
    return hay.withColumn("tag", F.explode(tag_hits(tags, "_hay"))).drop("_hay")


def _with_tagged_text(df: DataFrame) -> DataFrame:
    return df.withColumn("_text", F.lower(F.concat_ws(" ", "title", "company", "description")))


def _with_points(df: DataFrame, cfg: TaggedConfig) -> DataFrame:
    return settle(df, {**{c: F.col(c) for c in ("_own", "_near", "_vector")}, "points": keyword_points("_text", cfg),
                       "_short": F.length(F.trim("_text")) < cfg.min_text_length})


def _with_total(df: DataFrame, profiles: dict[str, str], cfg: TaggedConfig,
                stop_words: list[str] | None) -> DataFrame:
    df = with_tfidf(df, "_text", profiles, "tag", stop_words, cfg)
    total = F.least(F.col("points") + F.col("tfidf"), F.lit(100.0))
    df = df.withColumn("score", F.when(F.col("_short"), F.lit(0.0)).otherwise(F.round(total, 2)))
    return settle(df.drop("_text", "_short"), {c: F.col(c) for c in ("points", "tfidf", "score")})


def score_tagged(df: DataFrame, profiles: dict[str, str], cfg: TaggedConfig = TaggedConfig(),
                 stop_words: list[str] | None = None) -> DataFrame:
    """The 0-100 score of tagged listings: keyword points plus TF-IDF similarity.

    ``profiles`` maps a tag to its profile text.  Adds ``points``, ``tfidf``
    and ``score``.
    """
    df = with_term_vector(_with_tagged_text(df), "_text", profiles, stop_words, cfg)
    return _with_total(_with_points(df, cfg), profiles, cfg, stop_words)


def score_by_tag(df: DataFrame, tags: dict[str, list[str]], profiles: dict[str, str],
                 cfg: TaggedConfig = TaggedConfig(), stop_words: list[str] | None = None) -> DataFrame:
    """:func:`score_tagged` of :func:`tag_listings`, with each text read once.

    Points and terms do not depend on the tag; they are computed before a listing is split by its tags, and
    only for listings with one.
    """
    df = settle(df.withColumn("_hay", F.concat_ws(" ", "title", "description")), {
        "_tags": tag_hits(tags, "_hay")}).drop("_hay").filter(F.size("_tags") > 0)
    df = _with_points(with_term_vector(_with_tagged_text(df), "_text", profiles, stop_words, cfg), cfg)
    return _with_total(df.withColumn("tag", F.explode("_tags")).drop("_tags"), profiles, cfg, stop_words)


def fresh_by_age(df: DataFrame, as_of: datetime | str, max_hours: float,
                 policy: AgePolicy = AGE_V1) -> DataFrame:
    return settle(df, {"age_hours": age_hours("posted", as_of, policy)}).filter(
        F.col("age_hours") <= max_hours)


def with_experience(df: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Turn detected listings that demand too much experience into filtered ones."""
    df = df.withColumns({
        "_title": F.lower("title"), "_body": F.lower(F.concat_ws(" ", "title", "description"))})
    reason = rules.experience_reason("_title", "_body", cfg.max_years)
    df = settle(df, {"_reason": F.when(F.col("status") == "detected", reason)})
    rejected = ~rules.experience_suitable(F.col("_reason"))
    rejected = F.coalesce(rejected, F.lit(False))
    return df.withColumns({
        "llm_reason": F.when(rejected, F.col("_reason")).otherwise(F.lit(None).cast("string")),
        "filter_reason": F.when(rejected, "experience").otherwise(F.col("filter_reason")),
        "status": F.when(rejected, "filtered").otherwise(F.col("status")),
    }).drop("_reason", "_title", "_body")
