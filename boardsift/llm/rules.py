"""Quality rules: statistics of each text and a learned decision list over them.

Sequential covering learns rules for the rejected class one by one.  A rule grows as a conjunction
of threshold tests by information gain on one part of the labelled rows, is pruned on the other
part, and is accepted while it is precise there; the rows it covers leave the set.  The list is
emitted as an ordered conditional expression, so that applying it is one projection.

All counts of the learner are grouped aggregations over all labelled rows; the driver sees one
count for each feature, bin and class.

Nulls and empty texts have no words and fail the base rule.  Repeated rows are judged alike.
Labels that are null are left out; several labels of a document all count.  Without labels, or
with an empty table, the list is empty and only the base rule holds.  Texts are read whole.
Working columns start with an underscore; ``filtered`` keeps all columns of its input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import SPACE, stored, table
from boardsift.operators.score import settle

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share"]


def _dropped(x: Column, pattern: str) -> Column:
    return F.when(x.rlike(pattern), F.char_length(x) - F.char_length(F.regexp_replace(x, pattern, ""))).otherwise(0)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and the shares that rules test; all in the text's own row."""
    x, raw = F.col("_x"), F.col("_raw")
    df = docs.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    # only words are split from the trimmed text: blanks at its ends belong to its first and last line
    df = df.withColumn("_x", F.btrim("_raw", F.lit(" \t\n\x0b\f\r")))
    df = df.withColumn("_w", F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, SPACE, -1)))
    w = F.col("_w")
    df = df.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": _dropped(raw, r"[#*$%&|<>]").cast("bigint"),
        "_upper": _dropped(raw, "[A-Z]"),
        "_distinct": F.size(F.array_distinct(w)),
        "_lines": F.filter(F.split(raw, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        # a window's hash and its place share one number: low bits for the place
        "_mask": F.expr(
            "shiftleft(CAST(1 AS BIGINT), length(bin(size(_w)))) - 1"),
    })
    mask = F.col("_mask")
    df = df.withColumn("_s", F.when(F.size(w) > 3, F.sort_array(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.size(w).cast("bigint") - 3), lambda i: F.xxhash64(
            F.get(w, i.cast("int")), F.get(w, i.cast("int") + 1), F.get(w, i.cast("int") + 2)).bitwiseAND(
            F.bitwise_not(mask)).bitwiseOR(i)))).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_s")

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        return (a.bitwiseOR(mask) == b.bitwiseOR(mask)) & (F.get(w, i) == F.get(w, j)) & (
            F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    df = df.withColumn("_r", F.sort_array(F.transform(F.filter(s, lambda a, k: F.coalesce(
        same(a, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(a, F.get(s, k + 1)), F.lit(False))),
        lambda a: a.bitwiseAND(mask))))
    covered = F.aggregate(F.zip_with(F.col("_r"), F.slice(F.col("_r"), F.lit(2), F.greatest(
        F.size("_r"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": covered,
    })
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "distinct_share": F.col("_distinct") / n,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("_raw", "_x", "_w", "_upper", "_distinct", "_lines", "_mask", "_s", "_r")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Learner:
    """``precision`` is what a rule needs on the pruning part; ``coverage`` how many rejected rows."""

    bins: int = 32
    tests: int = 3
    rules: int = 8
    precision: float = 0.95
    coverage: int = 5


def matches(rule: list[Test]) -> Column:
    return reduce(lambda a, b: a & b, [t.column() for t in rule], F.lit(True))


def expression(rules: list[list[Test]]) -> Column:
    """The decision list: the first rule that matches rejects, otherwise the text is kept."""
    out = None
    for rule in rules:
        out = (out or F).when(matches(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> Test | None:
    """The test with the highest FOIL gain over ``rows`` (bad, growing part only)."""
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), reduce(
        lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias("bin")) for f in cuts))
    counted = rows.select("bad", F.explode(bins).alias("z")).groupBy("z.feature", "z.bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    total_p = sum(r.p for r in counted) / max(len(cuts), 1)
    total_n = sum(r.n for r in counted) / max(len(cuts), 1)
    if not total_p or not total_n:
        return None
    before = math.log2(total_p / (total_p + total_n))
    best = None
    for f in cuts:
        p = n = 0
        by_bin = {r.bin: r for r in counted if r.feature == f}
        for k, cut in enumerate(cuts[f]):
            if k in by_bin:
                p, n = p + by_bin[k].p, n + by_bin[k].n
            for above, pp, nn in ((False, p, n), (True, total_p - p, total_n - n)):
                if pp:
                    gain = pp * (math.log2(pp / (pp + nn)) - before)
                    if gain > 1e-9 and (best is None or (gain, f) > best[:2]):
                        best = (gain, f, Test(f, above, cut))
    return best and best[2]


def learn(rows: DataFrame, cfg: Learner = Learner()) -> list[list[Test]]:
    """The decision list for rows (key, bad 0/1, features)."""
    rows = stored(rows.select("bad", (F.pmod(F.xxhash64("key"), F.lit(3)) > 0).alias("grow"), *FEATURES), "rule-rows")
    # cuts lie between bins of both classes, since a rejected few would vanish among all
    quantiles = [k / cfg.bins for k in range(cfg.bins + 1)]
    ends = rows.groupBy("bad").agg(*(F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES)).collect()
    cuts = {f: sorted({float(v) for r in ends for v in (r[f] or [])}) for f in FEATURES}
    found: list[list[Test]] = []
    left = rows
    while len(found) < cfg.rules:
        grow, prune = left.filter("grow"), left.filter("NOT grow")
        rule: list[Test] = []
        while len(rule) < cfg.tests:
            test = _best(grow.filter(matches(rule)), cuts)
            if test is None:
                break
            rule.append(test)
        if not rule:
            break
        heads = [matches(rule[:k + 1]) for k in range(len(rule))]
        counted = prune.agg(*(F.coalesce(F.sum(F.when(h, v)), F.lit(0)).alias(f"{c}{k}") for k, h in enumerate(
            heads) for c, v in (("p", F.col("bad")), ("n", 1 - F.col("bad"))))).first()
        worth = [(counted[f"p{k}"] - counted[f"n{k}"]) / max(counted[f"p{k}"] + counted[f"n{k}"], 1)
                 for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = counted[f"p{k}"], counted[f"n{k}"]
        if p < cfg.coverage or p < cfg.precision * (p + n):
            break
        found.append(rule[:k + 1])
        left = left.filter(~matches(rule[:k + 1]))
    return found


def learned(stats: DataFrame, labels: DataFrame, cfg: Learner = Learner()) -> list[list[Test]]:
    """Learns from documents with a quality label that pass the base rule."""
    marked = labels.filter(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("key"), (F.col("quality") == 0).cast("int").alias("bad"))
    rows = stats.filter(~F.col("base_failed")).join(marked, F.col("doc_id") == F.col("key"))
    return learn(rows, cfg)


def filtered(docs: DataFrame, labels: DataFrame, cfg: Learner = Learner()) -> DataFrame:
    """The documents that pass, with their own columns."""
    stats = stored(statistics(docs.select("doc_id", "text")).drop("text"), "rule-stats")
    verdict = expression(learned(stats, labels, cfg))
    judged = statistics(docs.select(F.struct("*").alias("_row"), "text"))
    # settled, so that the filter does not unfold the statistics below it
    judged = settle(judged.select("_row", *FEATURES, "base_failed"), {"_kept": ~F.col("base_failed") & verdict})
    return judged.filter("_kept").select("_row.*")


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(statistics(docs).drop("text"), "rule-stats")
    verdict = expression(learned(stats, table(spark, sf_dir, "labels")))
    return stats.select("doc_id", *BASE, "base_failed", F.when(F.col("base_failed"), False).otherwise(
        verdict).alias("kept"))
