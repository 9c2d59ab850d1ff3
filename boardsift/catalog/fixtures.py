"""A listings view over the ``documents`` table.

The documents are prose without listing attributes, so these are derived from
``doc_id``.  The expressions are written in the SQL that Spark and other
engines share, and double as the view of the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import text

AS_OF = "2024-01-31 00:00:00"

SKILLS = """CASE doc_id % 11
 WHEN 1 THEN 'python sql pandas'
 WHEN 2 THEN 'machine learning deep learning pytorch tensorflow nlp python'
 WHEN 3 THEN 'power bi tableau sql excel dashboard'
 WHEN 4 THEN 'airflow spark etl aws docker'
 WHEN 5 THEN 'python sql statistics regression xgboost numpy'
 WHEN 7 THEN 'machine learning llm rag transformer bert'
 WHEN 8 THEN 'azure data pipeline etl'
 WHEN 9 THEN 'tableau visualization statistics sql python pandas'
 WHEN 10 THEN 'excel' ELSE '' END"""
EXPERIENCE = """CASE doc_id % 6
 WHEN 1 THEN '0-2 years' WHEN 2 THEN '5+ years'
 WHEN 3 THEN '8+ years of experience' WHEN 4 THEN 'freshers welcome' ELSE '' END"""
BASE_TITLE = """CASE doc_id % 10
 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Senior Data Analyst'
 WHEN 2 THEN 'ML Engineer' WHEN 3 THEN 'Sales Manager'
 WHEN 4 THEN 'Power BI Developer' WHEN 5 THEN 'Director of Analytics'
 WHEN 6 THEN 'Data Engineer - Spark' WHEN 7 THEN 'Staff Engineer'
 WHEN 8 THEN 'Office Clerk' ELSE 'Junior Python Developer' END"""

# Column name -> expression over ``documents``, before cleaning.
RAW_COLUMNS = {
    "title": f"""CASE WHEN doc_id % 131 = 0 THEN NULL
 WHEN doc_id % 53 = 0 THEN concat('  ', {BASE_TITLE}, chr(9))
 WHEN doc_id % 89 = 0 THEN concat({BASE_TITLE}, repeat(' and more', 30))
 ELSE {BASE_TITLE} END""",
    "company": "CASE WHEN doc_id % 101 = 0 THEN NULL ELSE concat('Company ', doc_id % 37) END",
    "location": """CASE doc_id % 7
 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Remote' WHEN 2 THEN 'London, UK'
 WHEN 3 THEN 'Bengaluru, India' WHEN 4 THEN 'Unknown'
 WHEN 5 THEN 'Remote - US only' ELSE 'Berlin, Germany' END""",
    "posted": """CASE doc_id % 27
 WHEN 0 THEN 'just now' WHEN 1 THEN concat(doc_id % 50, ' hours ago')
 WHEN 2 THEN 'yesterday' WHEN 3 THEN concat(doc_id % 12, ' days ago')
 WHEN 4 THEN '2 weeks ago' WHEN 5 THEN concat('2024-01-2', doc_id % 10)
 WHEN 6 THEN CAST(1706000000000 + doc_id * 1000 AS STRING)
 WHEN 7 THEN 'Tue, 30 Jan 2024 10:00:00 GMT' WHEN 8 THEN NULL
 WHEN 9 THEN concat(doc_id % 60, ' minutes ago') WHEN 10 THEN 'Today'
 WHEN 11 THEN '3 months ago' WHEN 12 THEN '1 hour 5 minutes ago'
 WHEN 13 THEN concat('2024-01-2', doc_id % 10, 'T10:30:00Z')
 WHEN 14 THEN '2024-01-30T05:00:00+05:30' WHEN 15 THEN CAST(1706600000 + doc_id AS STRING)
 WHEN 16 THEN 'Recent' WHEN 17 THEN '' WHEN 18 THEN concat('  ', doc_id % 5, ' Days Ago ')
 WHEN 19 THEN 'a few moments ago' WHEN 20 THEN '1 year ago' WHEN 21 THEN '2025-01-01'
 WHEN 22 THEN 'a week ago' WHEN 23 THEN '30/01/2024' WHEN 24 THEN '1 week 3 days'
 WHEN 25 THEN '2024-1-5' ELSE '2024-01-29T08:15:30.250Z' END""",
    "description": f"""CASE WHEN doc_id % 4 = 0
 THEN concat('<p class="lead">', {SKILLS}, '</p><br/> ', {EXPERIENCE}, ' <div>', text, '</div>')
 ELSE concat({SKILLS}, ' ', {EXPERIENCE}, ' ', text) END""",
    "url": "concat(' https://jobs.example/', doc_id, ' ')",
    "salary": "CASE WHEN doc_id % 3 = 0 THEN concat(doc_id % 40, ' LPA') END",
    "job_type": "CASE WHEN doc_id % 2 = 0 THEN 'full-time' END",
    "fetched_hours": "doc_id * 7 % 1000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame, files: int, key: str) -> DataFrame:
    """At least as many partitions as there are cores.

    A file of one row group is one task however large its texts; a table of
    many files already has enough tasks and is read as it is.
    """
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if files < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(spark, docs, len(docs.inputFiles()), "doc_id")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "source", *[F.expr(e).alias(c) for c, e in RAW_COLUMNS.items()])


def fetched_at(hours: str = "fetched_hours"):
    return F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=F.col(hours).cast("int"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned listings with ids; ``doc_id`` is the order of arrival."""
    df = raw_listings(spark, sf_dir).withColumns({
        "title": text.clean_string(F.col("title")),
        "company": text.clean_string(F.col("company")),
        "description": text.clean_description(F.col("description")),
        "url": text.clean_url(F.col("url")),
        "fetched_at": fetched_at(),
    }).drop("fetched_hours")
    return df.withColumn("job_id", text.job_id(F.col("title"), F.col("company"), F.col("source")))
