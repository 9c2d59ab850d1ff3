"""TF-IDF cosine of a listing with one profile text, both alone in the corpus.

With two documents the inverse document frequency has two values only: 1 for a
term of both texts and ``1 + ln 1.5`` for a term of one.  The cosine is then a
closed form over term counts of the row at hand, so the whole score is a
map-side expression: no term is shuffled and no group of terms is collected.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.config import TaggedConfig
from boardsift.functions.text import WORD

SINGLE_IDF = (1.0 + math.log(1.5)) ** 2
TOKEN = rf"[{WORD}]{{2,}}"


def default_stop_words() -> list[str]:
    """English stop words shipped with Spark; pass another list to change them."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def words_of(text: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def terms_of(words: Column) -> Column:
    """Single words and pairs of neighbours, sorted."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.sort_array(F.concat(words, pairs))


def profile_counts(text: str, stop: list[str]) -> Counter:
    """Term counts of a profile: a short configuration text, counted on the driver."""
    skip = set(stop)
    words = [w for w in re.findall(r"[^\W]{2,}", text.lower()) if w not in skip]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def _per_tag(tag: str, profiles: dict[str, Counter], build, other) -> Column:
    chain = None
    for name, counts in profiles.items():
        hit, value = F.col(tag) == name, build(counts)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(other) if chain is not None else other


def _strings(counts: Counter) -> Column:
    return F.array(*[F.lit(t) for t in sorted(counts)]).cast("array<string>")


def _map(counts: Counter) -> Column:
    return F.map_from_arrays(_strings(counts), F.array(
        *[F.lit(counts[t]) for t in sorted(counts)]).cast("array<int>"))


def _sums(entries: Column) -> Column:
    """Fold term entries into the five sums of the cosine."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("dot", "jj", "pp", "j1", "p1")])

    def step(s: Column, e: Column) -> Column:
        j, p = e["n"].cast("double"), e["p"].cast("double")
        both = (e["n"] > 0) & (e["p"] > 0)

        def add(name: str, value: Column, when: Column) -> Column:
            return (s[name] + F.when(when, value).otherwise(F.lit(0.0))).alias(name)

        return F.struct(add("dot", j * p, both), add("jj", j * j, both), add("pp", p * p, both),
                        add("j1", j * j, ~both), add("p1", p * p, ~both))

    return F.aggregate(entries, zero, step)


def _most_frequent(vector: Column, counts: Column, shared: Column, limit: int) -> Column:
    """Entries of the ``limit`` most frequent terms of both texts, ties by term."""
    def entry(n: Column, term: Column, p: Column) -> Column:
        return F.struct((-(n + p)).alias("k"), term.alias("term"), n.alias("n"), p.alias("p"))

    own = F.transform(vector, lambda e: entry(
        e["n"], e["term"], F.coalesce(F.element_at(counts, e["term"]), F.lit(0))))
    rest = F.transform(F.array_except(F.map_keys(counts), shared),
                       lambda t: entry(F.lit(0), t, F.element_at(counts, t)))
    return F.slice(F.sort_array(F.concat(own, rest)), 1, limit)


def with_term_vector(df: DataFrame, text: str, profiles: dict[str, str], stop_words: list[str] | None = None,
                     cfg: TaggedConfig = TaggedConfig()) -> DataFrame:
    """Count the terms of column ``text`` (lower-cased) once, whatever the number of profiles.

    Adds ``_near``, the sorted (term, n) of terms that some profile has, ``_own``, number and
    squared length of all terms, and ``_vector``, all (term, n), for texts with so many terms that only the most
    frequent ones count; it is NULL for others, so little moves on.
    """
    stop = default_stop_words() if stop_words is None else stop_words
    counts = [profile_counts(p, stop) for p in profiles.values()]
    df = df.withColumn("_words", words_of(F.col(text), stop))
    df = df.withColumn("_terms", terms_of(F.col("_words")))
    # every column that a lambda looks into is used more than once, so it is computed once
    t = F.col("_terms")
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    df = df.withColumn("_starts", F.when(F.size(t) > 0, starts).otherwise(F.array().cast("array<int>")))
    at = F.col("_starts")
    df = df.withColumn("_all", F.transform(at, lambda i, k: F.struct(
        F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).alias("n"))))
    every, most = sorted(set().union(*counts)), max(map(len, counts), default=0)
    v = F.col("_all")
    square = F.aggregate(v, F.lit(0.0), lambda total, e: total + (e["n"] * e["n"]).cast("double"))
    return df.withColumns({
        "_own": F.struct(F.size(v).alias("n"), square.alias("sq")),
        "_near": F.filter(v, lambda e: e["term"].isin(every)) if every else F.slice(v, 1, 0),
        "_vector": F.when(F.size(v) + most > cfg.max_features, v),
    }).drop("_words", "_terms", "_starts", "_all")


def with_tfidf(df: DataFrame, text: str, profiles: dict[str, str], tag: str,
               stop_words: list[str] | None = None,
               cfg: TaggedConfig = TaggedConfig()) -> DataFrame:
    """Add ``tfidf``: the scaled cosine of column ``text`` (lower-cased) and the
    profile of the row's ``tag``.

    Beyond ``max_features`` distinct terms, the most frequent terms of the two
    texts are kept; ties are broken by term.  A frame that went through :func:`with_term_vector` with the
    same arguments before it was split by tag is not tokenised again.
    """
    stop = default_stop_words() if stop_words is None else stop_words
    counts = {name: profile_counts(text, stop) for name, text in profiles.items()}
    if "_near" not in df.columns:
        df = with_term_vector(df, text, profiles, stop, cfg)
    none = F.slice("_near", 1, 0)
    df = df.withColumns({
        # Membership in a literal set is one hash lookup per term.
        "_hits": _per_tag(tag, counts, lambda c: F.filter(
            F.col("_near"), lambda e: e["term"].isin(sorted(c))) if c else none, none),
        "_counts": _per_tag(tag, counts, _map, F.lit(None).cast("map<string,int>")),
    })
    size = F.coalesce(F.size("_counts"), F.lit(0))
    limited = F.col("_own.n") + size - F.size("_hits") > cfg.max_features
    pairs = F.transform("_hits", lambda e: F.struct(
        e["n"].alias("n"), F.element_at(F.col("_counts"), e["term"]).alias("p")))
    kept = F.transform(
        _most_frequent(F.col("_vector"), F.col("_counts"), F.col("_hits.term"), cfg.max_features),
        lambda e: F.struct(e["n"], e["p"]))
    df = df.withColumn("_limited", limited).withColumn(
        "_sums", _sums(F.when(F.col("_limited"), kept).otherwise(pairs)))
    total = _per_tag(tag, counts,
                     lambda c: F.lit(float(sum(v * v for v in c.values()))), F.lit(0.0))
    s = F.col("_sums")
    j1 = F.when(F.col("_limited"), s["j1"]).otherwise(F.col("_own.sq") - s["jj"])
    p1 = F.when(F.col("_limited"), s["p1"]).otherwise(total - s["pp"])
    norm = (F.sqrt(s["jj"] + j1 * F.lit(SINGLE_IDF)) * F.sqrt(s["pp"] + p1 * F.lit(SINGLE_IDF)))
    cosine = F.when(s["dot"] > 0, s["dot"] / norm).otherwise(F.lit(0.0))
    return df.withColumn("tfidf", cosine * F.lit(cfg.tfidf_scale)).drop(
        "_own", "_near", "_vector", "_hits", "_counts", "_limited", "_sums")
