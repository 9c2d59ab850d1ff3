"""Preference formatting: one prompt, two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt; the turns after it become two completions, each with the spans that training may use, the
assistant's turns.

Turns compare by role and text.  A null role is ``user``, a null text is empty.  Turns with equal
numbers are ordered by role, then text; repeated turns stay.  Conversations without an assistant
turn give no pair.  An empty table gives an empty result.  Texts are whole.  Further columns of
the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardsift.llm.common import running_sum_of, stored, table

CLOSE = "<|end|>\n"
#: Conversation numbers within which branches of an opening are paired first.
BLOCK = 4096


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """How many leading turns both share."""
    differs = F.array_position(F.zip_with(chosen, rejected, lambda a, b: F.coalesce(_same(a, b), F.lit(False))), False)
    longest = F.greatest(F.size(chosen), F.size(rejected))
    return F.when(differs > 0, differs - 1).otherwise(longest).cast("int")


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def trainable(turns: Column) -> Column:
    """``start:end`` (code points) of what the assistant says, with its end mark, comma-joined."""
    sizes = F.transform(turns, lambda t: F.char_length(_render(t)))
    spans = F.zip_with(turns, running_sum_of(sizes), lambda t, end: F.when(t["role"] == "assistant", F.concat_ws(
        ":", (end - F.char_length(t["text"]) - len(CLOSE)).cast("string"), end.cast("string"))))
    return F.array_join(F.filter(spans, lambda s: s.isNotNull()), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """(…, chosen, rejected) as arrays of turns to prompt, completions and their masks."""
    df = pairs.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
            for c in ("chosen", "rejected")}
    keys = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    df = df.select(*keys, "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("_prompt"),
                   rest["chosen"].alias("_chosen"), rest["rejected"].alias("_rejected"))
    return df.select(
        *keys, "n_common", rendered(F.col("_prompt")).alias("prompt"),
        *(e for c in ("chosen", "rejected") for e in (rendered(F.col(f"_{c}")).alias(c),
                                                      trainable(F.col(f"_{c}")).alias(f"{c}_mask"))))


def echo_pairs(convs: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn against one that repeats the turn before it."""
    t = F.col("turns")
    last = F.size(t) - F.array_position(F.reverse(F.transform(t, lambda x: x["role"])), "assistant").cast("int") + 1
    df = convs.filter(F.exists(t, lambda x: x["role"] == "assistant")).withColumn("_n", last)
    head = F.slice(t, F.lit(1), F.col("_n") - 1)
    echo = F.struct(F.element_at(t, F.col("_n"))["turn"].alias("turn"), F.lit("assistant").alias("role"),
                    F.coalesce(F.get(t, F.col("_n") - 2)["text"], F.lit("")).alias("text"))
    return df.select("conv_id", F.lit("echo").alias("kind"), F.slice(t, F.lit(1), F.col("_n")).alias("chosen"),
                     F.concat(head, F.array(echo)).alias("rejected"))


def branch_pairs(convs: DataFrame) -> DataFrame:
    """Conversations that open with the same turn, each against the next different one.

    Neighbours by number are paired within ``BLOCK`` numbers, so that a common opening is spread over many groups; the
    last of each block meets those of other blocks, first of ``BLOCK`` neighbouring blocks, then all.  Equal
    conversations count as one, the one with the smallest number.  Only hashes and numbers are sorted.
    """
    t = F.col("turns")
    bare = F.transform(t, lambda x: F.struct(x["role"].alias("r"), x["text"].alias("t")))
    df = convs.filter(F.col("conv_id").isNotNull() & F.exists(t, lambda x: x["role"] == "assistant"))
    rows = df.select("conv_id", F.sha2(F.to_json(F.slice(bare, 1, 1)), 256).alias("opening"),
                     F.sha2(F.to_json(bare), 256).alias("body"))
    shared = rows.groupBy("opening").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b")
    left = stored(rows.join(shared, "opening", "left_semi"), "chat-branches")
    pairs = []
    for block in (F.lit(BLOCK), F.lit(BLOCK * BLOCK), None):
        group = F.lit(0) if block is None else F.floor(F.col("conv_id") / block)
        once = left.groupBy("opening", group.alias("block"), "body").agg(F.min("conv_id").alias("conv_id"))
        w = Window.partitionBy("opening", "block").orderBy("conv_id")
        met = stored(once.select("opening", "body", "conv_id", F.lead("conv_id").over(w).alias("other")),
                     "chat-neighbours")
        pairs.append(met.filter("other IS NOT NULL").select("conv_id", "other"))
        left = met.filter("other IS NULL").select("opening", "body", "conv_id")
    both = reduce(DataFrame.unionByName, pairs)
    return both.join(df.select("conv_id", t.alias("chosen")), "conv_id").join(
        df.select(F.col("conv_id").alias("other"), t.alias("rejected")), "other").select(
        "conv_id", F.lit("branch").alias("kind"), "chosen", "rejected")


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = conversations(table(spark, sf_dir, "conversations"))
    out = formatted(echo_pairs(convs).unionByName(branch_pairs(convs)))
    return out.withColumn("n_common", F.col("n_common").cast("bigint"))


def _neighbours(k: int, rows: str, block: int | None) -> str:
    group = "0" if block is None else f"conv_id // {block}"
    return f"""
r{k} AS (SELECT opening, {group} AS g, body, min(conv_id) AS conv_id FROM {rows} GROUP BY ALL),
l{k} AS (
  SELECT *, lead(conv_id) OVER (PARTITION BY opening, g ORDER BY conv_id) AS other FROM r{k}),"""


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS i
  FROM conversations),
a AS (SELECT conv_id, max(i) AS n FROM t WHERE role = 'assistant' GROUP BY 1),
b AS (
  SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY i) AS body,
         min(role || chr(1) || text) FILTER (i = 1) AS opening
  FROM t JOIN a USING (conv_id) GROUP BY 1),
o AS (SELECT * FROM b WHERE opening IN (SELECT opening FROM b GROUP BY 1 HAVING count(DISTINCT body) > 1)),
{_neighbours(0, "o", BLOCK)}{_neighbours(1, "l0 WHERE other IS NULL", BLOCK * BLOCK)}{_neighbours(2, "l1 WHERE other IS NULL", None)}
pairs AS (
  SELECT conv_id, other FROM l0 WHERE other IS NOT NULL UNION ALL SELECT conv_id, other FROM l1 WHERE other IS NOT NULL
  UNION ALL SELECT conv_id, other FROM l2 WHERE other IS NOT NULL),
sides AS (
  SELECT t.conv_id, 'echo' AS kind, 'chosen' AS side, i, role, text FROM t JOIN a USING (conv_id) WHERE i <= n
  UNION ALL
  SELECT t.conv_id, 'echo', 'rejected', i, role, text FROM t JOIN a USING (conv_id) WHERE i < n
  UNION ALL
  SELECT a.conv_id, 'echo', 'rejected', n, 'assistant', coalesce(t.text, '')
  FROM a LEFT JOIN t ON t.conv_id = a.conv_id AND t.i = a.n - 1
  UNION ALL
  SELECT t.conv_id, 'branch', 'chosen', i, role, text FROM t JOIN pairs USING (conv_id)
  UNION ALL
  SELECT p.conv_id, 'branch', 'rejected', i, role, text FROM t JOIN pairs p ON t.conv_id = p.other),
cmp AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.kind, r.kind) AS kind, coalesce(c.i, r.i) AS i,
         coalesce(c.role = r.role AND c.text = r.text, FALSE) AS same
  FROM (SELECT * FROM sides WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM sides WHERE side = 'rejected') r
    ON c.conv_id = r.conv_id AND c.kind = r.kind AND c.i = r.i),
pre AS (
  SELECT conv_id, kind, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n_common, bool_and(same) AS equal
  FROM cmp GROUP BY 1, 2),
both_sides AS (
  SELECT conv_id, kind FROM sides GROUP BY 1, 2 HAVING count(DISTINCT side) = 2),
p AS (
  SELECT * FROM pre JOIN both_sides USING (conv_id, kind)
  WHERE kind = 'echo' OR (n_common > 0 AND NOT equal)),
out AS (
  SELECT p.conv_id, p.kind, n_common, side, i, role, text,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM p JOIN sides s ON s.conv_id = p.conv_id AND s.kind = p.kind),
ends AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, kind, side ORDER BY i) AS e
  FROM out WHERE i > n_common),
done AS (
  SELECT conv_id, kind, side, string_agg(line, '' ORDER BY i) AS body,
         string_agg((e - length(text) - 8)::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY i)
           FILTER (role = 'assistant') AS mask
  FROM ends GROUP BY 1, 2, 3),
prompts AS (
  SELECT conv_id, kind, string_agg(line, '' ORDER BY i) AS prompt FROM out
  WHERE side = 'chosen' AND i <= n_common GROUP BY 1, 2)
SELECT p.conv_id, p.kind, p.n_common::BIGINT AS n_common, coalesce(prompt, '') AS prompt,
       coalesce(c.body, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.body, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM p
LEFT JOIN prompts q ON q.conv_id = p.conv_id AND q.kind = p.kind
LEFT JOIN done c ON c.conv_id = p.conv_id AND c.kind = p.kind AND c.side = 'chosen'
LEFT JOIN done r ON r.conv_id = p.conv_id AND r.kind = p.kind AND r.side = 'rejected'
"""
