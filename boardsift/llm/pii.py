"""Personal data: fixed kinds, and identifiers found by bootstrapped contexts.

The fixed kinds are the seeds.  The two words left of a seed form a lexical pattern; patterns and
the identifier-like tokens they precede form a bipartite graph.  Each round scores a pattern by the
share of all its occurrences whose token is believed to be personal data, and a token by its
patterns (noisy or).  Tokens of high-confidence patterns that are no seed become ``context`` spans.

Nulls: a null text is empty, a null doc_id stays null.  Repeated rows give repeated results.  Texts
are read whole.  An empty table gives an empty result.  Further columns of the input are ignored by
``find`` and kept by ``mask``; working columns start with an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import spans as sp
from boardsift.llm.common import stored, table, words


def _bytes_of_ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (
        F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if over 9; the sum ends in 0."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        d * 2 - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _is_card(v: Column) -> Column:
    # the length test spares long runs of digits the sum
    return F.when(F.char_length(v) <= 37, F.char_length(_digits(v)).between(12, 19) & _luhn(_digits(v))
                  ).otherwise(False)


def _is_phone(v: Column) -> Column:
    return F.char_length(_digits(v)).between(9, 15)


# The kinds of personal data and their forms.  Starts inside a run are excluded where
# they can't match (\G allows the place where the last match ended), so that long runs stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = [
    sp.Kind("email", EMAIL, probe=lambda x: x.contains("@") & x.rlike(EMAIL)),
    sp.Kind("ip", IP, keep=_bytes_of_ip, probe=lambda x: x.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    sp.Kind("card", CARD, keep=_is_card, probe=lambda x: x.rlike(r"[0-9][0-9\x20-]{10}")),
    sp.Kind("phone", PHONE, keep=_is_phone, probe=lambda x: x.contains("+") & x.rlike(r"\+[0-9]")),
]
#: Phones and cards are one token, whatever spaces they hold.
TOKEN = sp.Kind("token", r"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])|[^\x20\x09-\x0D]+")


#: Texts with new identifiers are sent to all tasks up to this many.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Bootstrap:
    """``support``: different believed tokens a pattern needs; ``confidence``: of a pattern;
    ``accept``: score a new token needs."""

    rounds: int = 3
    support: int = 3
    confidence: float = 0.5
    accept: float = 0.8


def base_spans(df: DataFrame, text: str = "_text") -> DataFrame:
    return sp.with_spans(df, text, KINDS)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_text": text, "_id": F.col("doc_id"), "_hash": F.xxhash64(text)})


def mentions(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identifier-like tokens with their left context, the left context of every token of the texts that
    hold a digit or an at sign, and of all other texts)."""
    keyed, marked = _keyed(docs), F.col("_text").rlike("[0-9@]")
    found = sp.with_spans(keyed.filter(marked).select(
        "_id", "_hash", "_text"), "_text", [TOKEN]).drop("_text")
    t = F.col("spans_token")

    def left(i: Column) -> Column:
        return F.translate(F.lower(F.concat(F.get(t, i - 2)["value"], F.lit(" "), F.get(t, i - 1)["value"])),
                           "123456789", "000000000")

    def mention(i: Column) -> Column:
        z = F.get(t, i)
        lead = F.char_length(F.regexp_extract(z["value"], r"""^[("'<\[{]*+""", 0))
        value = F.regexp_replace(z["value"], r"""^[("'<\[{]++|[.,;:!?)"'>\]}#*$%&|]++$""", "")
        return F.struct((z["start"] + lead).alias("start"), value.alias("value"), left(i).alias("pattern"))

    # no filter on the tokens: it would be unfolded below their computation
    third = F.when(F.size(t) > 2, F.sequence(F.lit(2), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    at = F.filter(third, lambda i: F.get(t, i)["value"].rlike("[0-9@]"))
    rows = found.select("_id", "_hash", F.explode(F.transform(at, mention)).alias("m")).select(
        "_id", "_hash", "m.*").filter(F.char_length("value") >= 4)
    v = F.col("value")
    seed = v.rlike(EMAIL) | (v.rlike(f"^{IP}$") & _bytes_of_ip(v)) | (v.rlike(f"^{CARD}$") & _is_card(v)) | (
        v.rlike(f"^{PHONE}$") & _is_phone(v))
    rows = rows.withColumns({"seed": seed, "instance": F.lower("value"),
                             "end": F.col("start") + F.char_length("value")})
    # without digits a token is what stands between white space
    w = F.col("_w")
    plain = keyed.filter(~marked).select(words(F.lower("_text")).alias("_w")).filter(F.size(w) > 2)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 2), F.slice(w, F.lit(2), F.size(w) - 2),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return rows, found.select(F.explode(F.transform(third, left)).alias("pattern")), plain.select(
        F.explode(pairs).alias("pattern"))


def graph(rows: DataFrame) -> DataFrame:
    """Edges (pattern, instance, n, seed): how often a token follows a pattern."""
    return rows.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))


def occurrences(contexts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns`` occurs before any token."""
    few = F.broadcast(patterns) if patterns.count() <= BROADCAST_ROWS else patterns
    return contexts.join(few, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def bootstrap(edges: DataFrame, near: DataFrame, far: DataFrame, cfg: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """(confident patterns, scored instances) after the rounds.

    A pattern's occurrences are counted in the texts that can hold identifiers (``near``) first.  Where these alone
    make it too common, the others (``far``) would do so all the more and are not asked; so no text is gone
    through for a pattern that cannot become confident in the running round, nor twice for one.
    """
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    counted: dict[str, DataFrame | None] = {"near": None, "far": None}
    patterns = None
    for k in range(cfg.rounds):
        scored = edges.join(scores, "instance").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("score")).alias("weight"),
            F.sum((F.col("score") >= 0.5).cast("int")).alias("support")).filter(F.col("support") >= cfg.support)
        open_ones = stored(scored.withColumn("total", F.lit(0).cast("bigint")), f"pii-supported-{k}")
        for side, contexts in (("near", near), ("far", far)):
            before = counted[side]
            unseen = open_ones.select("pattern") if before is None else open_ones.select("pattern").join(
                before, "pattern", "left_anti")
            unseen = stored(unseen, f"pii-unseen-{side}-{k}")
            if before is None or not unseen.isEmpty():
                found = unseen.join(occurrences(contexts, unseen), "pattern", "left").select(
                    "pattern", F.coalesce("total", F.lit(0)).alias("more"))
                counted[side] = stored(found if before is None else before.union(found), f"pii-{side}-{k}")
            open_ones = stored(open_ones.join(counted[side], "pattern").select(
                "pattern", "weight", "support", (F.col("total") + F.col("more")).alias("total")).filter(
                F.col("weight") >= cfg.confidence * F.col("total")), f"pii-open-{side}-{k}")
        patterns = open_ones.select("pattern", (F.col("weight") / F.col("total")).alias("confidence"), "support")
        scores = stored(edges.join(patterns, "pattern", "left").groupBy("instance").agg(F.greatest(
            F.max(F.col("seed").cast("double")),
            1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1 - 1e-9)))))
        ).alias("score")), f"pii-scores-{k}")
    return patterns, scores


def discovered(docs: DataFrame, cfg: Bootstrap = Bootstrap()) -> DataFrame:
    """(_id, _hash, context): spans of new identifiers, at most one row for each text."""
    rows, near, far = mentions(docs)
    rows = stored(rows, "pii-mentions")
    patterns, scores = bootstrap(stored(graph(rows), "pii-edges"), near, far, cfg)
    new = rows.filter(~F.col("seed")).join(patterns.select("pattern"), "pattern", "left_semi").join(
        scores.filter(F.col("score") >= cfg.accept).select("instance"), "instance", "left_semi")
    span = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "value")
    return new.filter(F.col("value").rlike("[0-9]")).groupBy("_id", "_hash").agg(
        F.sort_array(F.collect_set(span)).alias("context"))


def _sent(rows: DataFrame) -> DataFrame:
    """Stored, and sent to all tasks if they are few; else joined by a shuffle."""
    rows = stored(rows, "pii-discovered")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def find(docs: DataFrame, cfg: Bootstrap = Bootstrap()) -> DataFrame:
    """Adds ``spans_<kind>`` of the fixed kinds and ``spans_context`` to (doc_id, text)."""
    new = discovered(docs, cfg).withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"})
    base = base_spans(_keyed(docs.select("doc_id", "text"))).drop("text", "_text")
    return base.join(_sent(new), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left").select(
        "doc_id", *(f"spans_{k.name}" for k in KINDS), F.coalesce(
            "context", F.array().cast(sp.SPAN)).alias("spans_context"))


def mask(docs: DataFrame, cfg: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every personal span of ``text`` replaced by its kind in brackets.

    The fixed kinds are replaced first, so that an identifier learned from its context cannot break one of them;
    a learned identifier is then replaced wherever the same text says it again.
    """
    new = discovered(docs, cfg).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), F.transform(
        "context", lambda z: z["value"]).alias("_values"))
    rows = _keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    out = rows.join(_sent(new), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    for kind in KINDS:
        x = F.col("_text")
        out = out.withColumn("_m", F.when(kind.probe(x), F.regexp_extract_all(x, F.lit(kind.pattern), F.lit(
            0))).otherwise(F.array().cast("array<string>")))
        out = out.withColumn("_g", F.when(F.size("_m") > 0, F.split(x, kind.pattern, -1)))
        out = out.withColumn("_text", sp.replaced(x, F.col("_g"), F.col("_m"), _mark(kind)))
    x, new_values = F.col("_text"), F.col("_values")
    # the quoted values, longest first; only texts with a discovery are searched for them
    quoted = F.array_join(F.transform(F.array_sort(F.array_distinct(new_values), lambda a, b: F.char_length(
        b) - F.char_length(a)), lambda v: F.regexp_replace(v, r"([^A-Za-z0-9])", r"\\$1")), "|")
    out = out.withColumn("_text", F.when(new_values.isNull(), x).otherwise(
        F.regexp_replace(x, F.concat(F.lit("(?<![A-Za-z0-9])(?:"), quoted, F.lit(")(?![A-Za-z0-9])")), F.lit("[CONTEXT]"))))
    new_text = F.when(F.col("text").isNotNull(), F.col("_text"))
    return out.select(*(new_text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def _mark(kind: sp.Kind):
    label = F.lit(f"[{kind.name.upper()}]")
    return lambda v: F.when(kind.keep(v), label).otherwise(v) if kind.keep else F.when(v.isNotNull(), label)


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = sp.merged([(k.name, F.col(f"spans_{k.name}")) for k in KINDS])
    every = sp.merged([(k.name, F.col(f"spans_{k.name}")) for k in KINDS] + [("context", F.col("spans_context"))])
    counts = [F.size(f"spans_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(sp.listed(base), 256).alias("base_sha256"),
                        sp.listed(every).alias("spans"))
