"""N-gram Jaccard join: components of documents whose 3-word shingle sets are at least 90 % alike.

1. Shingles are hashed to 64 bits; equal sets (128-bit signature) form one class.
2. Classes that share a minimum hash meet in groups of bounded size.  A group stores its sets in a
   prefix tree, most shared shingles first, and each set walks the tree: shared partial overlaps
   are counted once, and subtrees are pruned by what their remaining length could still match, or
   when everything below is linked already.  Leaders of the linked sets go on to the next round.
3. What is exact: every class lists its rarest shingles, as many as any partner must share one of
   (prefix filter).  Shingles that join different components so far give candidate pairs, cut by
   length, position and sketch bounds, and each candidate is verified on the whole texts.

So round 2 only saves work: large groups of near copies are linked there once, not pairwise.

Nulls, empty texts and texts without words have an empty set and are linked with nothing; a null
doc_id is its own row with a null component.  Repeated rows give repeated results.  Texts are read
whole.  An empty table gives an empty result.  Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardsift.llm import ngrams
from boardsift.llm.common import small_batches, stored, table

#: Id lists are sent to all tasks up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Buckets of a piece of the shingles' frequencies, and groups that tasks are dealt to for adding them.
PIECE = 4096
SALTS = 64
#: Code points that are hashed at once; several 64-bit numbers are held for each.
RUN = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``percent`` of the union that two sets must share; ``group``: sets in one prefix tree."""

    words: int = 3
    percent: int = 90
    hashes: int = 2
    group: int = 1000
    bits: int = 22


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text; A-Z count as a-z."""
    power = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)
    for run in ngrams.groups((t or "" for t in texts), RUN):
        raw = [t.encode("utf-8", "surrogatepass") for t in run]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        starts = np.cumsum([0] + [len(r) + 1 for r in raw])
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin = edge[inside[edge]]
        if inside[0]:
            begin = np.concatenate([[0], begin])
        end = edge[~inside[edge]]
        # a word's value is the sum over its bytes, by running sums over all bytes
        place = np.arange(len(data), dtype=np.int64) - np.repeat(
            begin, np.diff(np.append(begin, len(data)))) if len(begin) and begin[0] == 0 else np.arange(
            len(data), dtype=np.int64) - np.concatenate([np.zeros(begin[0] if len(begin) else len(data), np.int64),
                                                         np.repeat(begin, np.diff(np.append(begin, len(data))))])
        value = np.where(inside, (data.astype(np.uint64) + np.uint64(7)) * _ODD[0] * (
            power[place & 255] + place.astype(np.uint64)), np.uint64(0))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        h = ngrams.mixed(sums[end] - sums[begin])
        first = np.searchsorted(begin, starts)
        for k in range(len(run)):
            w = h[first[k]:first[k + 1]]
            n = len(w) - words + 1
            if not len(w):
                yield np.zeros(0, np.uint64)
            elif n < 1:
                out = np.full(1, len(w), np.uint64)
                for x in w:
                    out = ngrams.mixed(out * _ODD[1] + x)
                yield out
            else:
                out = np.zeros(n, np.uint64)
                for j in range(words):
                    out = ngrams.mixed(out * _ODD[1] + w[j:n + j])
                yield np.unique(out)


def linked(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with that overlap are alike enough."""
    return 100 * overlap >= percent * (a + b - overlap)


def prefix_size(n: int, percent: int) -> int:
    """So many of its first shingles (in any global order) must share one with each partner."""
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """Sets in a radix tree; each node knows the sizes below and whether all below are linked."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.root = self._node([], -1, 0)
        self.parent: dict[int, int] = {}

    @staticmethod
    def _node(tokens: list[int], doc: int, size: int) -> dict:
        return {"tokens": tokens, "kids": {}, "ends": [], "first": doc, "alike": True, "min": size, "max": size}

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, doc: int, tokens: list[int]) -> None:
        """Links ``doc`` with what it matches, then stores it."""
        self.parent[doc] = doc
        if self.root["kids"]:
            self._walk(doc, tokens)
        self._store(doc, tokens)

    def _walk(self, doc: int, tokens: list[int]) -> None:
        size, own, percent = len(tokens), set(tokens), self.percent
        whole = 100 + percent
        stack = [(kid, 0, 0) for kid in self.root["kids"].values()]
        stack.sort(key=lambda s: s[0]["tokens"][0] in own)
        while stack:
            node, missed, shared = stack.pop()
            if node["alike"] and self.find(node["first"]) == self.find(doc):
                continue
            if 100 * size < percent * node["min"]:
                continue
            # a set of the largest size below can miss only so many
            slack = (100 * node["max"] - percent * size) // whole
            hits = sum(t in own for t in node["tokens"])
            missed, shared = missed + len(node["tokens"]) - hits, shared + hits
            if missed > slack:
                continue
            for other, n in node["ends"]:
                if linked(shared, n, size, percent):
                    a, b = self.find(other), self.find(doc)
                    self.parent[max(a, b)] = min(a, b)
            kids = sorted(node["kids"].values(), key=lambda k: k["tokens"][0] in own)
            stack += [(kid, missed, shared) for kid in kids]

    def _store(self, doc: int, tokens: list[int]) -> None:
        size, node, at = len(tokens), self.root, 0
        while True:
            if node["first"] >= 0:
                node["alike"] = node["alike"] and self.find(node["first"]) == self.find(doc)
            else:
                node["first"] = doc
            node["min"], node["max"] = min(node["min"] or size, size), max(node["max"], size)
            if at == size:
                node["ends"].append((doc, size))
                return
            kid = node["kids"].get(tokens[at])
            if kid is None:
                leaf = self._node(tokens[at:], doc, size)
                leaf["ends"].append((doc, size))
                node["kids"][tokens[at]] = leaf
                return
            seg = kid["tokens"]
            same = 1
            while same < len(seg) and at + same < size and seg[same] == tokens[at + same]:
                same += 1
            if same < len(seg):  # split the run
                upper = self._node(seg[:same], kid["first"], 0)
                upper.update(alike=kid["alike"], min=kid["min"], max=kid["max"])
                kid["tokens"] = seg[same:]
                upper["kids"][seg[same]] = kid
                node["kids"][tokens[at]] = upper
                kid = upper
            node, at = kid, at + same


def tree_links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component."""
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.argsort(np.argsort(-counts, kind="stable"))
    tree = PrefixTree(percent)
    for k in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        if len(sets[k]):
            tree.add(k, sorted(rank[np.searchsorted(tokens, sets[k])].tolist()))
        else:
            tree.parent[k] = k
    return [tree.find(k) for k in range(len(sets))]


def shingle_frequencies(docs: DataFrame, cfg: Settings) -> np.ndarray:
    """How often shingles occur in all texts, by hash bucket: the order that puts frequent ones last.

    Every bucket of every task counts.  The counts travel as pieces of ``PIECE`` buckets, which are added up in two steps
    so that no group holds a piece of every task.  Any fixed order is right; this one keeps passages that many
    documents share out of the lists of rare shingles, however thinly they are spread.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << cfg.bits, np.uint32)
        for batch in batches:
            for s in shingle_sets(list(batch["text"]), cfg.words):
                total[(s >> np.uint64(64 - cfg.bits)).astype(np.int64)] += 1
        pieces = total.reshape(-1, min(PIECE, len(total)))
        part = TaskContext.get().partitionId() % SALTS
        for k in range(0, len(pieces), 256):
            at = k + np.flatnonzero(pieces[k:k + 256].any(axis=1))
            yield pd.DataFrame({"piece": at, "salt": part, "n": [_small(pieces[i]) for i in at]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((_wide(n) for n in rows["n"]), np.uint64(0))
        return pd.DataFrame({"piece": rows["piece"][:1], "salt": [0], "n": [_small(np.minimum(total, 2**31 - 1))]})

    schema = "piece long, salt long, n binary"
    parts = docs.select("text").mapInPandas(count, schema).groupBy("piece", "salt").applyInPandas(add, schema)
    out = np.zeros((max(1, (1 << cfg.bits) // PIECE), min(PIECE, 1 << cfg.bits)), np.int32)
    for r in parts.groupBy("piece").applyInPandas(add, schema).toLocalIterator():  # of fixed size in all
        out[r["piece"]] = _wide(r["n"])
    return out.ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte tells how many."""
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.uint64)


def profiles(docs: DataFrame, hot: np.ndarray, cfg: Settings) -> DataFrame:
    """(doc_id, h, n, s1, s2, keys, rare, sketch), stored: hash of the text, size, signature, minimum hashes,
    rarest shingles and a sketch: for each of 1024 hash buckets whether an odd number of shingles falls into it."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # of fixed size
    least = -(-cfg.percent // (100 - cfg.percent)) if cfg.percent < 100 else 1 << 62  # of sets with unequal partners

    @F.pandas_udf("n long, s1 long, s2 long, keys array<long>, rare array<long>, sketch array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        order = shared.value
        for batch in texts:
            rows = []
            for s in shingle_sets(list(batch), cfg.words):
                n = len(s)
                a, b = ngrams.mixed(s * _ODD[1]), ngrams.mixed(s * _ODD[2])
                rare = keys = sketch = None
                if n >= least:
                    rank = order[(s >> np.uint64(64 - cfg.bits)).astype(np.int64)]
                    p = prefix_size(n, cfg.percent)
                    cut = np.partition(rank, p - 1)[p - 1]
                    low, tie = np.flatnonzero(rank < cut), np.flatnonzero(rank == cut)
                    low = low[np.lexsort((s[low], rank[low]))]
                    rare = s[np.concatenate([low, tie])[:p]].view(np.int64)  # s is sorted, so ties are
                    own = s[rank <= np.partition(rank, n // 2)[n // 2]]  # less what is shared widely
                    keys = [int(ngrams.mixed(own * _ODD[k % 4] + np.uint64(k)).min().view(np.int64))
                            for k in range(cfg.hashes)]
                    parity = np.bincount((a >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
                    sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
                rows.append((n, int(a.sum(dtype=np.uint64).view(np.int64)) if n else 0,
                             int(np.bitwise_xor.reduce(b).view(np.int64)) if n else 0, keys, rare, sketch))
            yield pd.DataFrame(rows, columns=["n", "s1", "s2", "keys", "rare", "sketch"])

    rows = docs.select("doc_id", _hash().alias("h"), run(F.coalesce("text", F.lit(""))).alias("_r")).select(
        "doc_id", "h", "_r.*")
    rows = stored(rows, "jaccard-profiles")
    shared.destroy()
    return rows


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts_of(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (class, …) with the texts of their classes.

    A class stands in the row of its doc_id whose text has its hash.  A short list goes to the texts, a long one is
    shuffled.
    """
    at = members.join(classes.select("class", "doc_id", "h"), "class")
    small = members.count() <= BROADCAST_ROWS
    return docs.select("doc_id", _hash().alias("h"), "text").join(F.broadcast(at) if small else at, [
        "doc_id", "h"]).drop("doc_id", "h")


def _grouped_links(docs: DataFrame, classes: DataFrame, members: DataFrame, cfg: Settings) -> DataFrame:
    """(class, leader) for members (class, key, salt) of groups of bounded size."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["class"], kind="stable").drop_duplicates("class")
        ids = group["class"].to_numpy()
        first = tree_links(list(shingle_sets(list(group["text"]), cfg.words)), cfg.percent)
        return pd.DataFrame({"class": ids, "leader": ids[first]})

    return _texts_of(docs, classes, members).groupBy("key", "salt").applyInPandas(link, "class long, leader long")


def near_groups(docs: DataFrame, classes: DataFrame, cfg: Settings) -> DataFrame:
    """(class, comp) of every class: linked through groups that share a minimum hash."""
    comps = stored(classes.select("class", F.col("class").alias("comp")), "jaccard-comps")
    for k in range(cfg.hashes):
        keys = stored(classes.select("class", F.get("keys", F.lit(k)).alias("key")), f"jaccard-keys-{k}")
        for level in range(8):
            leaders = comps.select(F.col("comp").alias("class")).distinct().join(keys, "class")
            counts = leaders.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
            split = stored(leaders.join(counts, "key").withColumn("parts", F.ceil(F.col("m") / cfg.group)).select(
                "class", "key", F.pmod(F.xxhash64("class", F.lit(level)), F.col("parts")).alias("salt"),
                "parts"), f"jaccard-split-{k}-{level}")
            linked_to = stored(_grouped_links(docs, classes, split.drop("parts"), cfg).filter("class <> leader").select(
                F.col("class").alias("comp"), "leader"), f"jaccard-links-{k}-{level}")
            comps = stored(comps.join(linked_to, "comp", "left").select(
                "class", F.coalesce("leader", "comp").alias("comp")), f"jaccard-comps-{k}-{level}")
            # the leaders of keys that were dealt to several trees meet again, those of other keys don't
            keys = stored(split.filter("parts > 1").select("class", "key"), f"jaccard-keys-{k}-{level}")
            if keys.isEmpty() or linked_to.isEmpty():
                break
    return comps


def candidates(classes: DataFrame, comps: DataFrame, cfg: Settings) -> DataFrame:
    """(a, b, ca, cb): classes of different components that share a rare shingle and may be alike."""
    rows = classes.join(comps, "class").select("class", "comp", "n", F.posexplode("rare").alias("at", "token"))
    w = Window.partitionBy("token")
    mixed = rows.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).filter(
        "lo <> hi").drop("lo", "hi")
    mixed = stored(mixed, "jaccard-mixed")
    a = mixed.select("token", *(F.col(c).alias(f"a_{c}") for c in ("class", "comp", "n", "at")))
    b = mixed.select("token", *(F.col(c).alias(f"b_{c}") for c in ("class", "comp", "n", "at")))
    # the overlap a pair needs; both must share a shingle among the first size - needed + 1 of their order
    total = F.col("a_n") + F.col("b_n")
    needed = F.ceil(cfg.percent * total / (100 + cfg.percent))
    met = a.join(b, "token").filter(
        (F.col("a_comp") != F.col("b_comp")) & ((F.col("a_n") < F.col("b_n")) | (
            (F.col("a_n") == F.col("b_n")) & (F.col("a_class") < F.col("b_class"))))
        & (100 * F.col("a_n") >= cfg.percent * F.col("b_n"))
        & (F.col("a_at") <= F.col("a_n") - needed) & (F.col("b_at") <= F.col("b_n") - needed)
    ).select("a_class", "b_class", "a_comp", "b_comp", "a_n", "b_n").distinct()
    # two parity sketches differ in no more places than their sets in members
    sketch = classes.select("class", "sketch")
    both = met.join(sketch.withColumnsRenamed({"class": "a_class", "sketch": "sa"}), "a_class").join(
        sketch.withColumnsRenamed({"class": "b_class", "sketch": "sb"}), "b_class")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                         lambda acc, x: acc + x)
    return both.filter((100 + cfg.percent) * differ <= (100 - cfg.percent) * total).select(
        F.col("a_class").alias("a"), F.col("b_class").alias("b"), F.col("a_comp").alias("ca"),
        F.col("b_comp").alias("cb"))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, cfg: Settings) -> DataFrame:
    """(ca, cb) of the pairs whose whole texts are alike enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = shingle_sets(list(batch["text_a"]), cfg.words), shingle_sets(
                list(batch["text_b"]), cfg.words)
            ok = [linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), cfg.percent)
                  for x, y in zip(left, right)]
            yield batch.loc[ok, ["ca", "cb"]]

    ids = stored(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "jaccard-ids")
    texts = stored(_texts_of(docs, classes, ids).dropDuplicates(["class"]), "jaccard-texts")
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("ca", "cb", "text_a", "text_b").mapInPandas(check, "ca long, cb long").distinct()


def components(edges: DataFrame, a: str = "ca", b: str = "cb") -> DataFrame:
    """(node, root): the smallest node reachable, by spreading minima and jumping to them."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = stored(both.union(both.select("y", "x")).distinct(), "cc-edges")
    roots = stored(both.groupBy("x").agg(F.least("x", F.min("y")).alias("root")).withColumnRenamed("x", "node"), "cc-0")
    step = 0
    while True:
        step += 1
        near = both.join(roots.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        spread = roots.join(near, roots["node"] == near["x"]).select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(spread.join(jump, "root", "left").select(
            "node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"), f"cc-{step}")
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def join(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text)."""
    with small_batches(docs.sparkSession):  # every step with Python is stored
        return _joined(docs.select("doc_id", "text"), cfg)


def _joined(docs: DataFrame, cfg: Settings) -> DataFrame:
    sig = ["n", "s1", "s2"]
    rows = profiles(docs, shingle_frequencies(docs, cfg), cfg).withColumn("class", F.xxhash64(*sig))
    real = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # a class stands in its row with the smallest doc_id, whatever other texts that doc_id has
    classes = stored(real.groupBy("class").agg(F.min_by(
        F.struct("doc_id", "h", "n", "rare", "keys", "sketch"), F.struct("doc_id", "h")).alias("z")).select(
        "class", "z.*"), "jaccard-classes")
    # only sets that can have a different partner go on
    able = classes.filter(F.col("rare").isNotNull())
    comps = near_groups(docs, able, cfg)
    pairs = stored(candidates(able, comps, cfg), "jaccard-pairs")
    roots = components(verified(docs, able, pairs, cfg))
    comp_of = stored(classes.select("class", "doc_id").join(comps, "class", "left").join(
        roots, F.col("comp") == F.col("node"), "left").select(
        "class", "doc_id", F.coalesce("root", "comp", "class").alias("root")), "jaccard-roots")
    named = comp_of.join(comp_of.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select(
        "class", "component")
    out = rows.select("doc_id", "n", "class").join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(
        F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    found = join(docs, cfg)
    dropped = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
