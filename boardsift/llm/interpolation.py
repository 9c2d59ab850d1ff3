"""Language-model scores by deleted interpolation of n-grams.

P(w | history) mixes the maximum-likelihood estimates of all orders up to ``order`` and a uniform
one; the mixture weights depend on how often the histories were seen (buckets of doubling
frequency).  The weights come from expectation-maximisation on a part of the training documents,
over counts from which that part is deleted; the scores use the counts of all training documents.

Counts are exchanged in blocks.  A task cuts its documents into blocks of about ``block`` tokens and
sends each different n-gram of a block once, as sorted 64-bit hashes cut into ranges.  One group
of tasks adds up a range and answers every block with counts in the order the block has asked, so
answers hold no keys.  A frequent n-gram is one entry for each block that has it.  Ranges grow in
number with the corpus; nothing but sums leaves for the driver.

Words are told apart by 128-bit hashes, longer n-grams by 64 bits: two of them share a count
with odds of (number of n-grams)^2 / 2^65, which moves single estimates only.

Nulls: a null text is empty and scores its end token.  A row with a null doc_id is scored and
teaches nothing.  Repeated rows all count.  Without training text every probability is 1.
Further columns are ignored.  A text longer than a block makes a block of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import table
from boardsift.llm.ngrams import mixed
from boardsift.session import fresh_path

#: Rows of the training split by what they are for.
TEST, TRAIN, DELETED = 0, 1, 2
#: The end token is the empty word; no text has it as a word.
END = b""
_STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = ("block bigint, tokens bigint, train_tokens bigint, train_docs bigint, deleted_tokens bigint, "
          "deleted_docs bigint, doc_ids array<bigint>, roles binary, lengths binary, words binary, ids binary")
GRAMS = "size int, part bigint, block bigint, keys binary, checks binary, train binary, deleted binary"
COUNTS = "size int, part bigint, block bigint, distinct bigint, train binary, deleted binary"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    order: int = 2
    rounds: int = 12
    #: one training document in so many is deleted from the counts that the weights are learned on
    deleted_share: int = 20
    block: int = 1 << 21
    #: n-grams of one range, about
    part: int = 1 << 20


@dataclass(frozen=True)
class Totals:
    """Tokens, documents and different words that counts were taken from."""

    tokens: int
    docs: int
    words: int


# ------------------------------------------------------------ blocks


class Block:
    """Documents as numbers of their words."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.doc_ids: list[int | None] = []
        self.roles: list[int] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, role: int, text: bytes) -> None:
        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
        words.append(END)
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.doc_ids.append(doc_id)
        self.roles.append(role)
        self.tokens += len(words)

    def row(self, block: int) -> pa.RecordBatch:
        words = sorted(self.number)
        rank = np.empty(len(words), np.int32)
        rank[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        lengths = np.array([len(i) for i in self.ids], np.int32)
        roles = np.array(self.roles, np.uint8)
        trains, deleted = roles != TEST, roles == DELETED
        return pa.RecordBatch.from_pylist([{
            "block": block, "tokens": self.tokens, "train_tokens": int(lengths[trains].sum()),
            "train_docs": int(trains.sum()), "deleted_tokens": int(lengths[deleted].sum()),
            "deleted_docs": int(deleted.sum()), "doc_ids": self.doc_ids, "roles": roles.tobytes(),
            "lengths": lengths.tobytes(), "words": b"\n".join(words),
            "ids": planes(rank[np.concatenate(self.ids)])}], schema=_BLOCKS)


_BLOCKS = pa.schema([(n, pa.int64()) for n in ("block", "tokens", "train_tokens", "train_docs", "deleted_tokens",
                                               "deleted_docs")] + [("doc_ids", pa.list_(pa.int64()))] + [
    (n, pa.binary()) for n in ("roles", "lengths", "words", "ids")])


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte tells how many."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def blocks(docs: DataFrame, cfg: Settings) -> DataFrame:
    """The documents as blocks; those of deleted documents have odd numbers."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    role = F.when(F.col("doc_id").isNull() | (crc % 7 == 2), TEST).when(
        F.floor(crc / 7) % cfg.deleted_share == 0, DELETED).otherwise(TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        made = 0
        open_blocks = [Block(), Block()]
        for batch in batches:
            for doc_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2)):
                odd = int(role == DELETED)
                open_blocks[odd].add(doc_id, role, text.as_py())
                if open_blocks[odd].tokens >= cfg.block:
                    yield open_blocks[odd].row(first + 2 * made + odd)
                    open_blocks[odd], made = Block(), made + 1
        for odd, block in enumerate(open_blocks):
            if block.tokens:
                yield block.row(first + 2 * made + odd)

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", role.alias("role"), text.alias("text")).mapInArrow(run, BLOCKS)


# ------------------------------------------------------------ n-grams of a block


@dataclass(frozen=True)
class Grams:
    """The different n-grams of one size in a block, by ascending key, and which one each token ends."""

    keys: np.ndarray
    checks: np.ndarray
    at: np.ndarray

    def cuts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each range that has keys, where these begin and end)."""
        part = self.keys >> np.uint64(64 - bits) if bits else np.zeros(len(self.keys), np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        return part[begin].astype(np.int64), np.append(begin, len(part))


def first_tokens(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def grams(words: bytes, ids: np.ndarray, lengths: np.ndarray, order: int) -> list[Grams]:
    """The n-grams of all sizes up to ``order``; a document's first tokens follow a begin mark."""
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words.split(b"\n")), ">u8").reshape(-1, 2)
    key, check = digests[:, 0].astype(np.uint64), digests[:, 1].astype(np.uint64)
    by_key = np.lexsort((check, key))
    rank = np.empty(len(key), np.int64)
    rank[by_key] = np.arange(len(key))
    out = [Grams(key[by_key], check[by_key], rank[ids])]
    word = key[ids]
    begins = first_tokens(lengths)
    last = word
    for size in range(2, order + 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[begins] = size
        last = mixed(before * _STEP + word)
        found, at = np.unique(last, return_inverse=True)
        out.append(Grams(found, np.zeros(0, np.uint64), at))
    return out


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number of each token, documents' lengths, documents' roles)."""
    return (from_planes(row["ids"], np.int32), np.frombuffer(row["lengths"], np.int32),
            np.frombuffer(row["roles"], np.uint8))


def sent(rows: DataFrame, cfg: Settings, bits: int) -> DataFrame:
    """Every block's different n-grams with their counts, by size and range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, roles = opened(row)
                role = np.repeat(roles, lengths)
                for size, g in enumerate(grams(row["words"], ids, lengths, cfg.order), 1):
                    train = np.bincount(g.at[role != TEST], minlength=len(g.keys))
                    deleted = np.bincount(g.at[role == DELETED], minlength=len(g.keys))
                    parts, cuts = g.cuts(bits)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(parts), size, np.int32)), pa.array(parts),
                        pa.array(np.full(len(parts), row["block"], np.int64)),
                        *(pa.array([f(x[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for f, x in (
                            (lambda k: planes(np.diff(k, prepend=np.uint64(0))), g.keys), (np.ndarray.tobytes, g.checks),
                            (packed, train), (packed, deleted)))],
                        names=["size", "part", "block", "keys", "checks", "train", "deleted"])

    return rows.select("block", "roles", "lengths", "words", "ids").mapInArrow(run, GRAMS)


def added(group: pa.Table) -> pa.Table:
    """Total counts of one range, dealt back to each block in the order it sent its keys."""
    keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in group["keys"].to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    key = np.concatenate(keys)
    check = np.frombuffer(b"".join(group["checks"].to_pylist()), np.uint64)
    order = np.lexsort((check, key)) if len(check) else np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    if len(check):
        new[1:] |= check[order][1:] != check[order][:-1]
    begin = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    dealt, distinct = {}, 0
    for name in ("train", "deleted"):
        counts = np.concatenate([unpacked(c) for c in group[name].to_pylist()])
        total = np.add.reduceat(counts[order], begin)
        if name == "train":
            distinct = int((total > 0).sum())
        dealt[name] = pa.array([packed(c) for c in np.split(total[number], ends[:-1])], pa.binary())
    # the range's number of different n-grams stands in one of its rows
    return pa.table({"size": group["size"], "part": group["part"], "block": group["block"],
                     "distinct": pa.array([distinct] + [0] * (len(keys) - 1), pa.int64()), **dealt})


def answers(row: dict, replies: pa.Table, order: int) -> tuple[list[Grams], list[np.ndarray], list[np.ndarray]]:
    """A block's n-grams with (counts of all training documents, of deleted ones) by size."""
    ids, lengths, _ = opened(row)
    train: list[dict[int, np.ndarray]] = [{} for _ in range(order)]
    deleted: list[dict[int, np.ndarray]] = [{} for _ in range(order)]
    for r in replies.select(["size", "part", "train", "deleted"]).to_pylist():
        train[r["size"] - 1][r["part"]] = unpacked(r["train"])
        deleted[r["size"] - 1][r["part"]] = unpacked(r["deleted"])
    joined = [[np.concatenate([p[k] for k in sorted(p)]) for p in found] for found in (train, deleted)]
    return grams(row["words"], ids, lengths, order), *joined


# ------------------------------------------------------------ mixture


def estimates(found: list[Grams], counts: list[np.ndarray], lengths: np.ndarray, totals: Totals,
              words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token's histories, estimates by order with the uniform one first)."""
    begins = first_tokens(lengths)
    f = np.empty((len(found) + 1, len(found[0].at)))
    f[0] = 1 / (words + 1)
    bucket = np.zeros(f.shape[1], np.int64)
    before = np.full(f.shape[1], totals.tokens, np.int64)
    for size, (g, c) in enumerate(zip(found, counts), 1):
        here = c[g.at]
        f[size] = np.divide(here, before, out=np.zeros(len(here)), where=before > 0)
        if size > 1:
            bucket = bucket * 64 + np.frexp(before)[1]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[begins] = totals.docs
    return bucket, f


def seen(order: int) -> np.ndarray:
    """(buckets, order + 1): which estimates exist in a bucket."""
    bucket = np.arange(64 ** (order - 1))
    out = np.ones((len(bucket), order + 1), bool)
    for size in range(order, 1, -1):
        out[:, size] = bucket % 64 > 0
        bucket //= 64
    return out


def normalised(weights: np.ndarray, order: int) -> np.ndarray:
    weights = np.where(seen(order), weights, 0)
    return weights / weights.sum(1, keepdims=True)


def expected(weights: np.ndarray, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(buckets, order + 1): how many tokens each estimate accounts for."""
    share = weights[bucket].T * f
    share /= share.sum(0)
    return np.stack([np.bincount(bucket, s, len(weights)) for s in share], axis=1)


def maximised(counts: np.ndarray, order: int) -> np.ndarray:
    """New weights; a bucket's evidence is joined by one token of the average over all buckets."""
    pooled = counts.sum(0)
    if not pooled.sum():
        return normalised(np.ones(counts.shape), order)
    return normalised(counts + pooled / pooled.sum() + 1e-9, order)


def learned(events: DataFrame, cfg: Settings) -> np.ndarray:
    """Mixture weights by bucket, from rounds of expectation-maximisation over all events."""
    names = [f"f{k}" for k in range(cfg.order + 1)]
    weights = normalised(np.ones((64 ** (cfg.order - 1), cfg.order + 1)), cfg.order)
    for _ in range(cfg.rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(now.shape)
            for batch in batches:
                f = np.stack([batch.column(n).to_numpy() for n in names]).astype(np.float64)
                total += expected(now, batch.column("bucket").to_numpy(), f)
            b, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(k), pa.array(total[b, k])], names=["b", "k", "s"])

        counts = np.zeros(now.shape)
        # at most one row for each bucket and order
        for r in events.mapInArrow(run, "b bigint, k bigint, s double").groupBy("b", "k").agg(F.sum("s").alias("s")).collect():
            counts[r.b, r.k] = r.s
        weights = maximised(counts, cfg.order)
    return weights


def deleted_events(rows: DataFrame, counts: DataFrame, kept: Totals, words: int, cfg: Settings) -> DataFrame:
    """(bucket, estimates) of each token of the deleted documents, from counts without these."""
    names = [f"f{k}" for k in range(cfg.order + 1)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"bucket": [np.zeros(0, np.int64)]} | {n: [np.zeros(0, np.float32)] for n in names}
        for row in left.to_pylist():
            found, train, deleted = answers(row, right, cfg.order)
            bucket, f = estimates(found, [a - b for a, b in zip(train, deleted)], opened(row)[1], kept, words)
            out["bucket"].append(bucket)
            for n, x in zip(names, f.astype(np.float32)):
                out[n].append(x)
        return pa.table({n: np.concatenate(x) for n, x in out.items()})

    odd = F.col("block") % 2 == 1
    return _met(rows.filter(odd), counts.filter(odd)).applyInArrow(
        run, "bucket bigint, " + ", ".join(f"{n} float" for n in names))


def scored(rows: DataFrame, counts: DataFrame, weights: np.ndarray, totals: Totals, cfg: Settings) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            found, train, _ = answers(row, right, cfg.order)
            _, lengths, _ = opened(row)
            begins = first_tokens(lengths)
            bucket, f = estimates(found, train, lengths, totals, totals.words)
            c = train[0][found[0].at]
            base = np.log10((c + 1) / (totals.tokens + totals.words + 1))
            mix = np.log10((weights[bucket].T * f).sum(0))
            out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(lengths.astype(np.int64)),
                                 *(pa.array(np.add.reduceat(x, begins)) for x in ((c > 0).astype(np.int64), base, mix))],
                                schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return _met(rows, counts).applyInArrow(run, SCORES)


def _met(rows: DataFrame, counts: DataFrame):
    return rows.select("block", "doc_ids", "roles", "lengths", "words", "ids").groupBy("block").cogroup(
        counts.select("block", "size", "part", "train", "deleted").groupBy("block"))


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``common.stored``, but packed tighter: blocks are large and read twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(docs: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, Totals]:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of (doc_id, text), and what was learned from."""
    rows = written(blocks(docs, cfg), "blocks")
    names = ("tokens", "train_tokens", "train_docs", "deleted_tokens", "deleted_docs")
    tokens, n, docs_n, gone, gone_docs = (x or 0 for x in rows.agg(*(F.sum(c) for c in names)).first())
    bits = max(tokens // cfg.part, 1).bit_length() - 1
    counts = written(sent(rows, cfg, bits).groupBy("size", "part").applyInArrow(added, COUNTS), "counts")
    words = counts.filter("size = 1").agg(F.sum("distinct")).first()[0] or 0
    kept = Totals(n - gone, docs_n - gone_docs, words)
    weights = learned(written(deleted_events(rows, counts, kept, words, cfg), "events"), cfg)
    totals = Totals(n, docs_n, words)
    return scored(rows, counts, weights, totals, cfg), totals


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, totals = score(table(spark, sf_dir, "documents"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                      F.lit(totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
