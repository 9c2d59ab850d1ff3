"""A pipeline from raw documents to encoded training text.

Quality rules drop documents, one document of each group of near copies stays, documents with
benchmark passages go, personal data is masked, and what is left becomes token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import bpe, decontam, jaccard, pii, rules
from boardsift.llm.common import small_batches, stored, table
from boardsift.session import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filtered(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles that agree to 80 % or more."""
    return jaccard.one_of_each(docs, jaccard.Settings(words=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids)."""
    out = bpe.Codec(spark, bpe.default_path()).encoded(docs.select("doc_id", "lang", "source", "text"))
    with small_batches(spark):
        out = stored(out.select("doc_id", "lang", "source", "n_tokens", "ids"), "encoded")
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(
        F.array().cast("array<int>"))
    return out.select("doc_id", "lang", "source", "n_tokens", ids.alias("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("PII", masked),
    ("byte-level BPE", encoded),
]

#: Several stages fit models or walk graphs, which SQL does not express; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
