"""User-supplied models: embedders and classifiers.

A model runs in Python workers on Arrow batches, over rows that the plan has
already reduced: distinct texts for the embedder, eligible listings for the
classifier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import alerts
from boardsift.functions.text import strip

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]
Classifier = Callable[[str], str | None]


def embedding_text(c: Column) -> Column:
    return F.lower(strip(c))


def _embed_batch(embedder: Embedder, texts: list[str]) -> list:
    try:
        return [None if v is None else [float(x) for x in v] for v in embedder(texts)]
    except Exception:  # a failed text must not fail its neighbours
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in _embed_batch(embedder, [t])]


def with_embedding(df: DataFrame, text: Column, load: Callable[[], Embedder],
                   name: str = "embedding") -> DataFrame:
    """Add the vector of ``text``, NULL where the model fails.

    ``load`` builds the model once per Python worker.  Each distinct text is
    embedded once and joined back by its hash; grouping combines per task, so
    a text shared by many listings is one row per task before the shuffle, and
    adaptive execution splits its partition in the join back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = load()
        for pdf in batches:
            yield pd.DataFrame({
                "_text_key": pdf["_text_key"],
                name: _embed_batch(embedder, pdf["_text"].tolist())})

    keyed = df.withColumn("_text", embedding_text(text))
    keyed = keyed.withColumn("_text_key", F.sha2("_text", 256))
    distinct = keyed.groupBy("_text_key").agg(F.first("_text").alias("_text"))
    vectors = distinct.mapInPandas(run, f"_text_key STRING, {name} ARRAY<FLOAT>")
    return keyed.drop("_text").join(vectors, "_text_key", "left").drop("_text_key")


def eligible(scored: DataFrame, min_score: float) -> DataFrame:
    return scored.filter((F.col("status") == "detected") & (F.col("combined_score") >= min_score))


def classify(rows: DataFrame, load: Callable[[], Classifier]) -> DataFrame:
    """One verdict per row of ``rows``, whatever the model does.

    A reply that is missing or does not parse, and an error of the model,
    leave the listing suitable with confidence 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            replies, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    replies.append(model(prompt))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(f"Error: {str(e)[:50]}")
            yield pd.DataFrame({"job_id": pdf["job_id"], "reply": replies, "error": errors})

    asked = rows.select("job_id", alerts.prompt(
        F.col("title"), F.col("company"), F.col("description")).alias("prompt"))
    replies = asked.mapInPandas(run, "job_id STRING, reply STRING, error STRING")
    fields = alerts.verdict_fields(F.col("reply"))
    fields["reason"] = F.coalesce(F.col("error"), fields["reason"])
    return replies.select("job_id", *[c.alias(n) for n, c in fields.items()])
