"""A stored set of ids that answers which ids of a batch are new.

The ids lie in a table bucketed and sorted by id, so that a join with them moves the batch's ids
and not the stored ones.  Beside it lies a Bloom filter, cut into blocks of one bitmap each and bucketed by block:
ids it rules out are new without a look at the stored ids.  What a batch adds is a *part*; adding
a finished part again changes nothing, and a lookup can leave out its own part, so that a repeated
batch gets the answers of its first try.

A generation has fixed numbers of buckets and blocks; :meth:`IdIndex.compacted` writes the next one,
sized for what it holds, and readers switch to it once it is complete.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.sources import files

#: Bits of a block, the size of Spark's bitmaps.
BLOCK_BITS = 32768
BITS_PER_ID = 12
PROBES = 4
#: Stored ids of a bucket, about.
BUCKET_IDS = 4_000_000
LEAST_BUCKETS = 8
#: Parts and growth after which a new generation pays.
MAX_PARTS = 64
MAX_GROWTH = 4


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _places(key: str) -> list[Column]:
    """The bits of an id within its block."""
    h = F.xxhash64(F.lit("place"), key)
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def _is_set(bits: str, place: str) -> Column:
    return F.expr(f"(shiftright(CAST(conv(hex(substring({bits}, CAST({place} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT),"
                  f" CAST({place} % 8 AS INT)) & 1) = 1")


@dataclass(frozen=True)
class IdIndex:
    spark: SparkSession
    path: str
    generation: int
    buckets: int
    blocks: int
    left_out: str | None = None

    # -------------------------------------------------------- layout

    @property
    def folder(self) -> str:
        return f"{self.path}/gen-{self.generation:06d}"

    def _table(self, kind: str) -> str:
        return f"{kind}_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"

    def _declare(self) -> IdIndex:
        """Makes the two tables known to the session; their files are found by path."""
        for kind, columns, key in (("ids", "id STRING, part STRING", "id"),
                                   ("bloom", "block BIGINT, bits BINARY, part STRING", "block")):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(kind)} ({columns}) USING parquet CLUSTERED BY ({key})"
                f" SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{kind}'")
        return self

    def _rows(self, kind: str) -> DataFrame:
        # other sessions, such as those of micro-batches, may have added files
        self.spark.catalog.refreshTable(self._table(kind))
        rows = self.spark.table(self._table(kind))
        return rows if self.left_out is None else rows.filter(F.col("part") != self.left_out)

    def excluding(self, part: str) -> IdIndex:
        """The index as it was without ``part``."""
        return IdIndex(self.spark, self.path, self.generation, self.buckets, self.blocks, part)

    # -------------------------------------------------------- lookups

    def ids(self) -> DataFrame:
        """(id): all stored ids; a part that broke off and was repeated may show some twice."""
        return self._rows("ids").select("id")

    def may_hold(self, ids: DataFrame, key: str = "job_id") -> DataFrame:
        """The different ids of a batch that the filter does not rule out."""
        probes = ids.select(F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
        probes = probes.select("id", _block("id", self.blocks), *(
            p.alias(f"_p{i}") for i, p in enumerate(_places("id"))))
        hit = F.lit(True)
        for i in range(PROBES):
            hit = hit & _is_set("bits", f"_p{i}")
        hits = probes.join(self._rows("bloom"), "block").filter(hit).select("id")
        # dealt as the stored ids are, so that these stay where they lie in the join that follows
        return hits.repartition(self.buckets, "id").distinct()

    def known_among(self, ids: DataFrame, key: str = "job_id") -> DataFrame:
        """(key): the different ids of a batch that are stored."""
        found = self.may_hold(ids, key).join(self._rows("ids").select("id"), "id", "left_semi")
        return found.select(F.col("id").alias(key))

    def new_only(self, batch: DataFrame, key: str = "job_id") -> DataFrame:
        """Rows whose id is not stored; a null id is never stored."""
        return batch.join(self.known_among(batch, key), key, "left_anti")

    # -------------------------------------------------------- changes

    def add(self, ids: DataFrame, part: str, key: str = "job_id") -> bool:
        """Stores the ids of a part, once; False when that part was stored before."""
        marker = f"{self.folder}/parts/{quote(part, safe='')}"
        if files.exists(self.spark, marker):
            return False
        rows = ids.select(F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
        self._insert(rows.withColumn("part", F.lit(part)))
        files.touch(self.spark, marker)
        return True

    def _insert(self, rows: DataFrame) -> None:
        """Ids first: a lookup that meets a filter without them just asks once in vain."""
        rows.select("id", "part").repartition(self.buckets, "id").write.insertInto(self._table("ids"))
        bits = rows.select(_block("id", self.blocks), "part", F.explode(F.array(*_places("id"))).alias("_p"))
        bits = bits.groupBy("block", "part").agg(F.bitmap_construct_agg("_p").alias("bits"))
        bits.select("block", "bits", "part").repartition(self.buckets, "block").write.insertInto(self._table("bloom"))

    def parts(self) -> list[str]:
        return files.children(self.spark, f"{self.folder}/parts")

    def compacted(self, without: DataFrame | None = None, key: str = "job_id") -> IdIndex:
        """The next generation: one part, fitting sizes, and no ids of ``without``."""
        rows = self.ids().distinct()
        if without is not None:
            rows = rows.join(without.select(F.col(key).cast("string").alias("id")), "id", "left_anti")
        new = _created(self.spark, self.path, self.generation + 1, rows.count())
        new._insert(rows.withColumn("part", F.lit("compacted")))
        for part in self.parts():
            files.touch(self.spark, f"{new.folder}/parts/{part}")
        new._finish()
        return new

    def maintained(self) -> IdIndex:
        """Itself, or the next generation when parts or ids have become too many for this one."""
        if len(self.parts()) <= MAX_PARTS and self.ids().count() <= MAX_GROWTH * self.blocks * BLOCK_BITS // BITS_PER_ID:
            return self
        return self.compacted()

    def _finish(self) -> None:
        self.spark.createDataFrame([(self.buckets, self.blocks)], "buckets INT, blocks BIGINT").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.folder}/meta")


def _created(spark: SparkSession, path: str, generation: int, expected: int) -> IdIndex:
    buckets = max(LEAST_BUCKETS, -(-expected // BUCKET_IDS))
    blocks = max(1, -(-expected * BITS_PER_ID // BLOCK_BITS))
    index = IdIndex(spark, path, generation, buckets, blocks)
    # what a broken try left there is not looked at, as it never got its ``meta``
    while files.exists(spark, index.folder):
        index = IdIndex(spark, path, index.generation + 1, buckets, blocks)
    return index._declare()


def open_index(spark: SparkSession, path: str, expected: int = 1_000_000) -> IdIndex:
    """The newest complete generation below ``path``; a new one for ``expected`` ids if there is none."""
    made = sorted(int(c[4:]) for c in files.children(spark, path) if c.startswith("gen-"))
    for generation in reversed(made):
        meta = f"{path}/gen-{generation:06d}/meta"
        if files.finished(spark, meta):
            sizes = spark.read.schema("buckets INT, blocks BIGINT").parquet(meta).first()
            return IdIndex(spark, path, generation, sizes.buckets, sizes.blocks)._declare()
    index = _created(spark, path, (made[-1] if made else 0) + 1, expected)
    index._finish()
    return index
