"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed; document frequencies over all documents give the idf weights.
2. A randomised SVD of TF-IDF passages, the benchmark's and those of all documents, yields a latent
   space.  Documents' passages are added to a fixed number of signed sums while they are counted.  Products with
   the passage matrix run distributed; only what they make of its rows and the space itself, both of
   fixed size, reach the driver.
3. Every passage of every document (32 words, each 16 words) is projected by summing its words'
   latent rows, and compared with all benchmark items by cosine in the latent space.  An item of over 64
   words is cut into passages in the same way, and each is looked for.
4. A candidate is confirmed on the words themselves: the longest common subsequence of the item and
   the passage's surroundings, and how much of the item's ending (its answer) occurs in order.

Words are runs of letters and digits, case-folded for Latin letters.  Null and empty texts match
nothing; items without a word are left out; repeated items and rows give repeated results once per
pair.  Texts are read whole.  Empty tables give an empty result.  Further columns are ignored by
``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import ngrams
from boardsift.llm.common import small_batches, stored, table

#: Ids of leaking documents are sent to all tasks up to this many, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Buckets of the latent space that travel at once.
SLICE = 4096
#: Queries that are sent to all tasks at once; more take several passes over the documents.
QUERIES = 50_000
#: Rows of sums that travel at once, and the most tasks that make sums.
ROWS = 8
SUM_TASKS = 256


@dataclass(frozen=True)
class Settings:
    """The space is fitted on all items and all passages of all documents, which weigh as ``sample`` passages
    together.  More than ``items`` items share as many rows.  ``cosine`` is taken in the latent space; ``share`` is how
    much of the passage's whole weight must point along the item."""

    bits: int = 16
    rank: int = 96
    oversample: int = 8
    sample: int = 2000
    items: int = 4000
    emphasis: float = 20.0
    block: int = 16
    cosine: float = 0.6
    share: float = 0.4
    overlap: float = 0.8
    paraphrase: float = 0.65
    answer: float = 0.6


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words of all texts."""
    return ngrams.words(*ngrams.code_points(texts))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def statistics(docs: DataFrame, cfg: Settings) -> tuple[np.ndarray, DataFrame]:
    """Document frequencies, with the number of documents at the end, and (part, data): signed sums of passages.

    Each passage of each document (its words dealt in runs of ``2 * block``) is added, with a random sign, to one
    of ``rank + oversample`` rows; in expectation the sums' Gram matrix is that of all passages.  Both come from one
    reading.  A task sends a table of fixed size; more than ``SUM_TASKS`` partitions share tasks.
    """
    size, wide = 1 << cfg.bits, cfg.rank + cfg.oversample
    slices = max(1, size // SLICE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = np.zeros(size + 1, np.int64), np.zeros(wide * size, np.float32)
        for batch in batches:
            ids = batch["doc_id"].to_numpy().astype(np.int64).astype(np.uint64)
            base = 0
            for group in ngrams.groups(batch["text"].fillna("")):
                h, text = word_hashes(group)
                b = _bucket(h, cfg.bits)
                ends = np.searchsorted(text, np.arange(len(group) + 1))
                last = np.zeros(size, np.int64)
                for k in range(len(group)):
                    own = b[ends[k]:ends[k + 1]]
                    last[own] = np.arange(len(own))
                    total[own[last[own] == np.arange(len(own))]] += 1
                total[-1] += len(group)
                passage = ((np.arange(len(h)) - ends[text]) // (2 * cfg.block)).astype(np.uint64)
                dealt = ngrams.mixed(ngrams.mixed(ids[base + text]) + passage * np.uint64(0x9E3779B97F4A7C15))
                row, sign = (dealt >> np.uint64(8)) % np.uint64(wide), 1 - 2 * (dealt & np.uint64(1)).astype(np.int64)
                np.add.at(sums, row.astype(np.int64) * size + b, sign.astype(np.float32))
                base += len(group)
        yield pd.DataFrame({"part": [-1], "data": [total.astype(np.float64).tobytes()]})
        sums = sums.reshape(wide, size)
        for k in range(0, wide, ROWS):
            parts = [(k // ROWS * slices + n, sums[k:k + ROWS, n * SLICE:(n + 1) * SLICE]) for n in range(slices)]
            parts = [(n, x.astype(np.float64).tobytes()) for n, x in parts if x.any()]
            yield pd.DataFrame(parts, columns=["part", "data"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        out = 0
        for x in part["data"]:
            out = out + np.frombuffer(x)
        return pd.DataFrame({"part": part["part"].iloc[:1], "data": [out.tobytes()]})

    found = stored(docs.select("doc_id", "text").coalesce(SUM_TASKS).mapInPandas(
        count, "part long, data binary").groupBy("part").applyInPandas(added, "part long, data binary"), "lsa-sums")
    whole = found.filter("part < 0").first()
    return np.frombuffer(whole["data"]) if whole else np.zeros(size + 1), found.filter("part >= 0")


def _tfidf(h: np.ndarray, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(_bucket(h, bits), return_counts=True)
    x = n * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


def passages(sums: DataFrame, benchmark: DataFrame, idf: np.ndarray, cfg: Settings) -> DataFrame:
    """(key, item, idx, val): TF-IDF rows of the benchmark, and the documents' sums of passages.

    More than ``items`` different items are dealt to as many signed sums.  The documents weigh as ``sample`` passages.
    """
    shared = sums.sparkSession.sparkContext.broadcast(idf)  # of fixed size
    size, slices = 1 << cfg.bits, max(1, (1 << cfg.bits) // SLICE)
    schema = "key long, item boolean, idx array<int>, val array<double>"

    def weighted(part: int, data: bytes) -> np.ndarray:
        """Rows of a part, by bucket."""
        x = np.frombuffer(data).reshape(-1, min(SLICE, size))
        at = part % slices * SLICE
        return x * shared.value[at:at + x.shape[1]]

    def energy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"e": [float((weighted(p, x) ** 2).sum()) for p, x in zip(b["part"], b["data"])]})

    def rows(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        blocks = [(p % slices * SLICE, weighted(p, x)) for p, x in zip(parts["part"], parts["data"])]
        idx, val, first = [], [], parts["part"].iloc[0] // slices * ROWS
        for k in range(len(blocks[0][1])):
            at = [np.flatnonzero(x[k]) for _, x in blocks]
            idx.append(np.concatenate([lo + i for (lo, _), i in zip(blocks, at)]))
            val.append(np.concatenate([x[k][i] for (_, x), i in zip(blocks, at)]) * scale)
        return pd.DataFrame({"key": np.arange(first, first + len(idx)), "item": False, "idx": idx, "val": val})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            idx, val = [], []
            for t, sign in zip(batch["text"], batch["sign"]):
                at, x = _tfidf(word_hashes([t])[0], shared.value, cfg.bits)
                idx.append(at)
                val.append(x * (cfg.emphasis * sign))
            yield pd.DataFrame({"key": batch["key"], "item": True, "idx": idx, "val": val})

    def joined(same: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for i, x in zip(same["idx"], same["val"]):
            total[np.asarray(i, np.int64)] += x
        at = np.flatnonzero(total)
        return pd.DataFrame({"key": same["key"].iloc[:1], "item": True, "idx": [at], "val": [total[at]]})

    whole = sums.mapInPandas(energy, "e double").agg(F.sum("e")).first()[0] or 1.0
    scale = float(np.sqrt(cfg.sample / whole))
    documents = sums.groupBy(F.floor(F.col("part") / slices)).applyInPandas(rows, schema)
    items = benchmark.filter(F.col("text").isNotNull()).withColumn("key", F.col("item_id").cast("long"))
    if items.select("key").distinct().count() <= cfg.items:
        found = items.select("key", F.lit(1.0).alias("sign"), "text").mapInPandas(vectors, schema)
    else:
        dealt = F.xxhash64("key")
        sign = F.when(F.shiftright(dealt, 40).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)
        found = items.dropDuplicates(["key"]).select(
            F.pmod(dealt, F.lit(cfg.items)).alias("key"), sign.alias("sign"), "text").mapInPandas(
            vectors, schema).groupBy("key").applyInPandas(joined, schema)
    out = stored(found.unionByName(documents).coalesce(4), "lsa-passages")
    shared.destroy()
    return out


def latent_space(rows: DataFrame, cfg: Settings) -> np.ndarray:
    """(buckets, rank): right singular vectors by a randomised range finder with one power step.

    Products over all buckets stay in the tasks: the driver sees what they make of the rows, and the space itself
    once, a few slices of buckets at a time.
    """
    size, wide = 1 << cfg.bits, cfg.rank + cfg.oversample
    spark = rows.sparkSession

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows times a random matrix (buckets, wide), which each task draws by itself."""
        rng = np.random.default_rng(5)
        g = np.empty((size, wide), np.float32)
        for k in range(0, size, SLICE):
            g[k:k + SLICE] = rng.standard_normal((min(SLICE, size - k), wide))
        yield from products(batches, g)

    def products(batches: Iterable[pd.DataFrame], g: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "item": b["item"], "y": [
                (np.asarray(v) @ g[np.asarray(i)]).tobytes() for i, v in zip(b["idx"], b["val"])]})

    def transposed(batches: Iterable[pd.DataFrame]) -> np.ndarray:
        """The rows' transpose times their basis."""
        total = np.zeros((size, wide), np.float32)
        for b in batches:
            for i, v, q in zip(b["idx"], b["val"], b["q"]):
                i, v, q = np.asarray(i), np.asarray(v), np.frombuffer(q)
                for k in range(0, len(i), SLICE):
                    total[i[k:k + SLICE]] += np.outer(v[k:k + SLICE], q).astype(np.float32)
        return total

    def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows times their transpose times the basis."""
        kept = list(batches)  # of bounded size
        yield from products(kept, transposed(kept))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = transposed(batches)
        for k in range(0, size, SLICE):
            yield pd.DataFrame({"first": [k], "g": [total[k:k + SLICE].tobytes()]})

    def based(y: pd.DataFrame) -> DataFrame:
        """The rows with their basis; one task, as their number is bounded."""
        q = spark.createDataFrame(basis(y), "key long, item boolean, q binary")
        return rows.join(F.broadcast(q), ["key", "item"]).select("key", "item", "idx", "val", "q").coalesce(1)

    def basis(y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values(["item", "key"], kind="stable").drop_duplicates(["item", "key"])
        q, _ = np.linalg.qr(np.stack([np.frombuffer(x) for x in y["y"]]))
        q = np.pad(q, ((0, 0), (0, wide - q.shape[1])))
        return pd.DataFrame({"key": y["key"].to_numpy(), "item": y["item"].to_numpy(), "q": [x.tobytes() for x in q]})

    made = "key long, item boolean, y binary"
    y = rows.mapInPandas(sketch, made).toPandas()
    y = based(y).mapInPandas(power, made).toPandas()
    # a slice a file, so that few are on their way to the driver at once
    parts = stored(based(y).mapInPandas(slices, "first long, g binary").repartition(-(-size // SLICE)), "lsa-space")
    gram, g = np.zeros((wide, wide)), np.empty((size, wide), np.float32)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["g"], np.float32).reshape(-1, wide)
        g[r["first"]:r["first"] + len(part)] = part
    for k in range(0, size, SLICE):
        part = g[k:k + SLICE].astype(np.float64)
        gram += part.T @ part
    u, s, _ = np.linalg.svd(gram)
    keep = min(cfg.rank, int((s > 1e-9 * max(s[0], 1e-30)).sum()))
    turn = (u[:, :keep] / np.sqrt(s[:keep])).astype(np.float32)
    for k in range(0, size, SLICE):
        g[k:k + SLICE, :keep] = g[k:k + SLICE] @ turn
    return g[:, :keep]


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Index:
    """The latent rows of the words, their squared weights, and the items."""

    words: np.ndarray
    weights: np.ndarray
    items: list[tuple[int, list[int]]]
    queries: np.ndarray
    cfg: Settings

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text number, item id, cosine, share of the item in order, share of its answer) of each leak."""
        cfg, base = self.cfg, 0
        for group in ngrams.groups(texts):
            h, text = word_hashes(group)
            if len(h):
                ends = np.searchsorted(text, np.arange(len(group) + 1))
                place = np.arange(len(h)) - ends[text]
                at = np.flatnonzero(place % cfg.block == 0)
                b = _bucket(h, cfg.bits)
                sums = self._sums(b, at)
                norm = np.add.reduceat(self.weights[b], at)
                owner = text[at]
                pair = np.flatnonzero(owner[1:] == owner[:-1])
                sums[pair] += sums[pair + 1].copy()
                norm[pair] += norm[pair + 1].copy()
                sums /= np.sqrt(np.maximum(norm, 1e-9))[:, None]
                yield from self._confirmed(sums, at, owner, h, ends, base)
            base += len(group)

    def _sums(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The latent rows of the words, summed over the blocks that begin at ``at``, in the order of ``reduceat``."""
        out = np.empty((len(at), self.words.shape[1]), self.words.dtype)
        size = np.diff(at, append=len(b))
        whole = size == 16  # what follows is for blocks of 16 words, the others are left to ``reduceat``
        step = 1024  # blocks at a time, so that the rows stay in the cache
        buffers = np.empty((4, step, out.shape[1]), out.dtype)
        full = np.flatnonzero(whole)
        for lo in range(0, len(full), step):
            place = at[full[lo:lo + step]]
            total, two, three, row = buffers[:, :len(place)]

            def rows(k: int, to: np.ndarray) -> np.ndarray:
                return np.take(self.words, b[place + k], axis=0, out=to, mode="clip")

            def four(k: int, to: np.ndarray, other: np.ndarray) -> np.ndarray:
                np.add(rows(k, to), rows(k + 1, row), out=to)
                np.add(rows(k + 2, other), rows(k + 3, row), out=other)
                return np.add(to, other, out=to)

            np.add(four(1, total, two), four(5, two, three), out=total)
            for k in range(9, 16):
                total += rows(k, row)
            out[full[lo:lo + step]] = rows(0, row) + total
        for lo in range(0, len(at), 1 << 16):
            rest = lo + np.flatnonzero(~whole[lo:lo + (1 << 16)])
            if len(rest):
                n = size[rest]
                begin = np.cumsum(n) - n
                words = np.repeat(at[rest] - begin, n) + np.arange(n.sum())
                out[rest] = np.add.reduceat(self.words[b[words]], begin, axis=0)
        return out

    def _confirmed(self, sums, at, owner, h, ends, base):
        cfg, done = self.cfg, {}
        least = min(cfg.overlap, cfg.paraphrase)  # no leak has a smaller share
        for q in range(0, len(self.items), 512):
            for k in range(0, len(sums), 8192):
                part, items = sums[k:k + 8192], self.queries[q:q + 512]
                squares = np.maximum((items ** 2).sum(axis=1), 1e-12)
                share_of = part @ (items / squares[:, None]).T
                w, i = np.nonzero(share_of >= cfg.share)
                length = np.sqrt(np.maximum((part[w] ** 2).sum(axis=1), 1e-12))
                latent = share_of[w, i] * np.sqrt(squares[i]) / length
                near_enough = latent >= cfg.cosine
                for w, i, cosine in zip(w[near_enough], i[near_enough], latent[near_enough]):
                    key = (int(owner[k + w]), q + int(i))
                    found = done.get(key)
                    if found and found[1] >= cfg.overlap:
                        continue
                    own = self.items[key[1]][1]
                    lo, hi = ends[key[0]], ends[key[0] + 1]
                    near = h[max(lo, at[k + w] - len(own)):min(hi, at[k + w] + 2 * cfg.block + len(own))].tolist()
                    here = set(near)
                    if sum(x in here for x in own) / len(own) < least:
                        continue  # in whatever order
                    share = subsequence(own, near) / len(own)
                    if share >= least and (not found or share > found[1]):
                        tail = own[-max(3, len(own) // 4):]
                        done[key] = (float(cosine), share, subsequence(tail, near) / len(tail))
        for (t, i), (cosine, share, answer) in sorted(done.items()):
            if share >= cfg.overlap or share >= cfg.paraphrase and answer >= cfg.answer:
                yield base + t, self.items[i][0], cosine, share, answer


def queries(benchmark: DataFrame, cfg: Settings) -> list[tuple[int, tuple[int, ...]]]:
    """(item_id, words): each item, or its passages where it is longer than two of them.

    A passage is as long as the documents' own, so that a copied part of a long item stands out as a whole item does.
    """
    size, found = 2 * cfg.block, set()
    for r in benchmark.select("item_id", "text").toLocalIterator():
        h = word_hashes([r["text"]])[0].tolist()
        if len(h) <= 2 * size:
            starts, length = [0], len(h)
        else:
            starts, length = [*range(0, len(h) - size, cfg.block), len(h) - size], size
        found |= {(int(r["item_id"]), tuple(h[k:k + length])) for k in starts if h}
    return sorted(found)


def build(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> list[Index]:
    """An index for each ``QUERIES`` queries."""
    benchmark = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    df, sums = statistics(docs, cfg)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    asked = queries(benchmark, cfg)
    if not asked or not df[-1]:
        return []
    words = latent_space(passages(sums, benchmark, idf, cfg), cfg)
    words *= idf.astype(np.float32)[:, None]
    out = []
    for k in range(0, len(asked), QUERIES):
        items = [(i, list(h)) for i, h in asked[k:k + QUERIES]]
        rows = np.empty((len(items), words.shape[1]), np.float32)
        for n, (_, h) in enumerate(items):
            b = _bucket(np.array(h, np.uint64), cfg.bits)
            rows[n] = words[b].sum(axis=0) / np.sqrt(max((idf[b] ** 2).sum(), 1e-9))
        out.append(Index(words, (idf ** 2).astype(np.float32), items, rows, cfg))
    return out


LEAK = "doc_id long, item_id long, cosine double, overlap double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer): one row for each pair, the best passages'."""
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    with small_batches(docs.sparkSession):
        indexes = build(docs, benchmark, cfg)
    found = [_searched(docs, index) for index in indexes]
    if not found:
        return docs.sparkSession.createDataFrame([], LEAK)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(
        *(F.max(c).alias(c) for c in ("cosine", "overlap", "answer")))


def _searched(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of bounded size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            rows = [(int(ids[t]), *rest) for t, *rest in shared.value.search(list(batch["text"]))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "overlap", "answer"])

    return docs.mapInPandas(run, LEAK)


def clean(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The documents without a leak, with their own columns; a null doc_id stays."""
    with small_batches(docs.sparkSession):
        bad = stored(leaks(docs, benchmark, cfg).select("doc_id").distinct(), "leaking")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "doc_id", "left_anti").select(
        *docs.columns)


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
