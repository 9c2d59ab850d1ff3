"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the hash of its bytes.  A ledger table keeps which
pairs of blob and rule version have been scanned and what was found, so a run reads only the
texts of pairs it has not seen, however many paths share a blob, and joins the findings back
to all paths.

Nulls: a null text is the empty blob.  Repeated rows give repeated results.  Very long texts are
scanned whole.  An empty table gives an empty result.  Further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import spans as sp
from boardsift.llm.common import table
from boardsift.session import fresh_path

# The kinds of secrets and their forms.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
KINDS = [
    sp.Kind("assign", ASSIGN, keep=lambda v: F.char_length(v) >= 8, group=2),
    sp.Kind("access", "AKIA[A-Z0-9]{12,}", probe=lambda x: x.contains("AKIA")),
    sp.Kind("hex", "[0-9a-f]{32,}+"),
]


@dataclass(frozen=True)
class RuleSet:
    """Kinds under a version; a changed rule needs a new version, which is scanned anew."""

    version: str = "1"
    kinds: list[sp.Kind] = field(default_factory=lambda: KINDS)


def addressed(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text): the blob is the SHA-256 of the text's bytes."""
    x = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(x, 256)).alias("blob"), x.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: RuleSet) -> DataFrame:
    """One row (blob, text) for each blob that the ledger lacks under this rule version.

    Only blob and path are grouped; the texts move once, for the chosen paths.
    """
    chosen = versions.groupBy("blob").agg(F.min(F.struct("path")).getField("path").alias("path"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rules.version).select("blob")
        chosen = chosen.join(known, "blob", "left_anti")
    chosen = chosen.withColumnsRenamed({"blob": "_blob", "path": "_path"})
    return versions.join(chosen, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(
        F.col("_path")), "left_semi").select("blob", "text")


def scan(blobs: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of each blob as rows of the ledger."""
    found = sp.with_spans(blobs, "text", rules.kinds)
    findings = sp.merged([(k.name, F.col(f"spans_{k.name}")) for k in rules.kinds])
    rows = found.select("blob", F.lit(rules.version).alias("rule_version"), findings.alias("findings"))
    # a path listed twice with one text would give its blob twice
    return rows.groupBy("blob", "rule_version").agg(F.first("findings").alias("findings"))


def update_ledger(versions: DataFrame, ledger_path: str, rules: RuleSet, first: bool = False) -> DataFrame:
    """Scans what is unseen, appends it to the ledger and returns the ledger."""
    spark = versions.sparkSession
    old = None if first else spark.read.parquet(ledger_path)
    scan(unseen(versions, old, rules), rules).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def by_path(versions: DataFrame, ledger: DataFrame, rules: RuleSet) -> DataFrame:
    """(path, blob, findings) of every version of every path."""
    found = ledger.filter((F.col("rule_version") == rules.version) & (F.size("findings") > 0)).select(
        "blob", "findings").dropDuplicates(["blob"])
    return versions.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet()
    versions = addressed(table(spark, sf_dir, "documents"), "doc_id")
    ledger = update_ledger(versions, fresh_path(spark, "secret-ledger"), rules, first=True)
    found = by_path(versions, ledger, rules)
    count = [sp.counted(F.col("findings"), k.name).alias(f"n_{k.name}") for k in rules.kinds]
    text = sp.listed(F.col("findings"))
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(text, 256).alias("base_sha256"),
                        text.alias("spans"))
