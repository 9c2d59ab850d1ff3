"""Byte-level BPE: ranked merges folded once for frequent words, beside its text for any other word.

The ranked merges of a word are a fold over its bytes: each step joins the leftmost pair of
neighbours of the lowest rank, and only the ranks of the two pairs beside it are looked up anew.

1. Words are counted over all texts.  The ``words`` most frequent ones of at most ``LONGEST`` bytes
   are folded once, in Spark expressions; their ids are a dictionary of bounded size, broadcast to Python workers.
2. Arrow tasks cut each text by the tokenizer's pattern; words of the dictionary get their ids, and the text's
   other words, each once, are folded there.  Such words recur in few other texts
   (1.5 texts each on 0.1 GB), and no text is shuffled for them.
3. The same tasks decode: the binary pieces of the ids are concatenated.

So a task of step 2 needs one Python worker, and its plan holds no literal.  In step 1 bytes become ids, and the ids of a
pair are looked up in a literal rank map: an array of small maps that the two ids address, since a map is searched
entry by entry.  It enters the plan as a session variable that is dropped once the plan holds it.

Nulls: a null text is empty and has no ids.  Repeated rows give repeated results.  Texts are read
whole; a word of n bytes takes time in the order of n squared.  An empty table gives an empty
result.  Further columns of the input are kept by ``encoded``.
"""

from __future__ import annotations

import base64
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import stored, table
from boardsift.operators.score import settle

# The pattern of the public tokenizers, its white space spelt out.
_S = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def _pattern(space: str, letter: str, number: str) -> str:
    return (rf"'(?:[stmd]|re|ve|ll)| ?(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


def _spelt_out(kind: str) -> str:
    """The characters of a kind up to U+FFFF as ranges, for patterns that know no kinds."""
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    return "".join(rf"\u{ord(m[0][0]):04x}-\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{kind}+", every))


PATTERN = _pattern(_S, r"\p{L}", r"\p{N}")
#: What the pattern comes to in a text of characters up to U+007F and U+FFFF; these are faster to search for.
ASCII = _pattern(r"\t-\r\x20", "A-Za-z", "0-9")
PLANE = _pattern(_S, _spelt_out(r"\p{L}"), _spelt_out(r"\p{N}"))

BUCKETS = 65521
#: The dictionary holds at most so many words, of at most so many bytes each.
WORDS = 1 << 18
LONGEST = 64
#: Texts of an output batch.
TEXTS = 256


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(bytes, rank) of a rank file: base64 and a number in each line.  A piece's rank is its id."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


def _pair(a: str, b: str) -> str:
    return f"({a} * 16777216L + {b})"


def _rank(pair: str) -> str:
    return f"try_element_at(get(c.ranks, cast({pair} % {BUCKETS} AS int)), {pair})"


#: The fold of one word (``w`` binary) to ids, with the literals ``c`` in scope.  ``r`` holds for each
#: id of ``t`` the rank of the pair it begins, null if there is none.
FOLD = f"""
aggregate(
  sequence(1, octet_length(w)),
  element_at(transform(array(transform(split(decode(w, 'ISO-8859-1'), ''), x -> get(c.bytes, ascii(x)))), t ->
    named_struct('t', t, 'r', zip_with(t, slice(t, 2, size(t)), (x, y) -> {_rank(_pair('x', 'y'))}))), 1),
  (a, k) -> CASE WHEN array_min(a.r) IS NULL THEN a ELSE
    element_at(transform(array(cast(array_position(a.r, array_min(a.r)) AS int)), i ->
      element_at(transform(array(transform(slice(a.t, 2, size(a.t)), (x, j) ->
          IF(j >= i, x, IF(j = i - 1, get(a.r, j), get(a.t, j))))), t -> named_struct(
        't', t,
        'r', transform(t, (x, j) -> IF(j >= i, get(a.r, j + 1), IF(j < i - 2, get(a.r, j),
          {_rank(_pair('x', 'get(t, j + 1)'))}))))), 1)), 1) END,
  a -> a.t)
"""

#: The ids of a word as text, one space between.
IDS = f"""
element_at(transform(array(cast(WORD AS binary)), w -> array_join(cast({FOLD} AS array<string>), ' ')), 1)
"""


def splitter() -> Callable[[str], list[str]]:
    """The words of a text."""
    ascii_words, words, all_words = re.compile(ASCII).findall, re.compile(PLANE).findall, regex.compile(PATTERN).findall
    beyond = re.compile(r"[^\0-\uffff]").search
    return lambda text: ascii_words(text) if text.isascii() else all_words(text) if beyond(text) else words(text)


class Words:
    """A table (word, ids) that arrives in a worker as a dictionary, so that the driver makes no object for each word."""

    def __init__(self, entries: pa.Table) -> None:
        self.entries = entries

    def __reduce__(self):
        return _as_dictionary, (self.entries,)


def _as_dictionary(entries: pa.Table) -> dict[str, str]:
    return dict(zip(entries["word"].to_pylist(), entries["ids"].to_pylist()))


class Codec:
    """The literals of one rank file; ``words`` bounds the dictionary of frequent words."""

    def __init__(self, spark: SparkSession, path: str, words: int = WORDS) -> None:
        self.spark, self.words = spark, words
        rank = dict(read_ranks(path))
        self.rank = rank
        self.bytes = f"array({', '.join(str(rank[bytes([b])]) for b in range(256))})"
        # every way to make a piece of two pieces
        pairs, made = array("q"), array("i")
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in rank and piece[k:] in rank:
                    pairs.append((rank[piece[:k]] << 24) + rank[piece[k:]])
                    made.append(r)
        frame = spark.createDataFrame(pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(made, pa.int32())}))
        # one row: an array of maps; a pair is in the map it addresses
        maps = frame.groupBy((F.col("pair") % BUCKETS).alias("b")).agg(
            F.map_from_entries(F.collect_list(F.struct("pair", "rank"))).alias("m"))
        rows = spark.range(BUCKETS).withColumnRenamed("id", "b").join(maps, "b", "left").select(
            "b", F.coalesce("m", F.expr("cast(map() AS map<bigint, int>)")).alias("m"))
        self.ranks = stored(rows.coalesce(1).sortWithinPartitions("b").agg(F.collect_list("m").alias("v")), "bpe-ranks")

    def _bind(self, df: DataFrame, name: str, expression: str) -> DataFrame:
        """Adds a column that reads the rank map, which becomes a literal of the plan."""
        own = f"bpe_{uuid.uuid4().hex}"
        self.ranks.createOrReplaceTempView(own)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {own} {self.ranks.schema['v'].dataType.simpleString()}")
        self.spark.sql(f"SET VARIABLE {own} = (SELECT v FROM {own})")
        # computed apart from any Python function
        out = settle(df, {name: F.expr(expression.replace("c.ranks", own).replace("c.bytes", self.bytes))})
        self.spark.sql(f"DROP TEMPORARY VARIABLE {own}")
        self.spark.catalog.dropTempView(own)
        return out

    def dictionary(self, docs: DataFrame) -> pa.Table:
        """(word, ids) of the most frequent words; at most ``words`` of them."""
        word = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0))).alias("word")
        counts = stored(docs.select(word).filter(F.octet_length("word") <= LONGEST).groupBy("word").agg(
            F.count("*").alias("n")), "bpe-words")
        # the least count that leaves at most ``words`` words
        sizes = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("m")).orderBy(
            F.desc("n")).collect()
        total, cut = 0, None
        for row in sizes:
            total += row["m"]
            if total > self.words:
                break
            cut = row["n"]
        if cut is None:
            return pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.string())})
        frequent = counts.filter(F.col("n") >= cut).select("word").repartition(
            max(8, self.spark.sparkContext.defaultParallelism), "word")
        return self._bind(frequent, "ids", IDS.replace("WORD", "word")).toArrow()

    def encoded(self, docs: DataFrame) -> DataFrame:
        """Adds n_tokens, ids (decimal, one space between) and decoded.

        Columns of ``docs`` with one of these three names are replaced, all others are kept, whatever their names.
        """
        df = docs.drop("n_tokens", "ids", "decoded")
        own = {c: f"_bpe_own_{i}" for i, c in enumerate(df.columns) if c == "_code"}
        known = self.spark.sparkContext.broadcast(Words(self.dictionary(docs)))
        rank = self.spark.sparkContext.broadcast(self.rank)
        df = df.withColumnsRenamed(own).withColumn("_code", _encode(known, rank)("text"))
        return df.select("*", "_code.*").drop("_code").withColumnsRenamed({v: k for k, v in own.items()})


def folded(word: bytes, rank: dict[bytes, int], none: int) -> list[int]:
    """The ids of a word: the fold of its ranked merges; ``none`` is above any rank."""
    pieces = [word[i:i + 1] for i in range(len(word))]
    ranks = [rank.get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while ranks and (low := min(ranks)) < none:
        i = ranks.index(low)
        pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank.get(pieces[i] + pieces[i + 1], none)
        if i:
            ranks[i - 1] = rank.get(pieces[i - 1] + pieces[i], none)
    return [rank[p] for p in pieces]


def _encode(known: Broadcast, rank: Broadcast):
    """Ids of each text, from the dictionary or else by the fold, their number and what they decode to."""
    made = pa.struct([("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    @F.arrow_udf("n_tokens long, ids string, decoded string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, get, ranks = splitter(), known.value.get, rank.value
        none = max(ranks.values()) + 1
        piece = {str(r): p for p, r in ranks.items()}.__getitem__
        for batch in texts:
            for at in range(0, len(batch), TEXTS):
                rows = []
                for text in batch.slice(at, TEXTS):
                    words = find(text.as_py() or "")
                    found = list(map(get, words))
                    if None in found:
                        others = {w for w, ids in zip(words, found) if ids is None}
                        others = {w: " ".join(map(str, folded(w.encode(), ranks, none))) for w in others}
                        found = [ids or others[w] for w, ids in zip(words, found)]
                    ids = " ".join(found)
                    each = ids.split()
                    rows.append((len(each), ids, b"".join(map(piece, each)).decode("utf-8")))
                yield pa.array(rows, made)

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Codec(spark, default_path()).encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
