"""Compression of vectors to short codes by entries of learned codebooks, searched in integers.

A vector is cut into parts, each part has a codebook, and the code lists the nearest entry of every
part.  Parts and entries are padded with zeros to a power of two and turned by the Walsh-Hadamard
transform, which only adds and subtracts: the squared distance of two turned parts is the true one
times the padded length, so nothing is rounded.  Squared differences are summed in order of
sequency (number of sign changes), where the slow coefficients come first; an entry whose sum
already exceeds the whole distance of a good entry is out.

Each round is one pass of tasks over the stored vectors; a task gives one row of sums for each entry,
Spark adds these, and the driver sees ``parts * entries`` rows.

Nulls and odd rows: see ``vectors.integer_vectors`` for rows that are dropped.  A null vec_id gets a
code but is no start; repeated rows count each.  With fewer rows than ``entries`` the codebooks are
as small as the table; an empty table gives no row.  Errors and sums that a long does not hold are
null.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import vectors as vec
from boardsift.llm.common import stored, table

#: Rows compared at once with a codebook.
BLOCK = 1024
#: Sums of labels are sent to all tasks up to this many rows (some 16 bytes each).
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """``entries`` is at most 256, as an index is written in two hex digits."""

    dims: int = 64
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    #: coefficients summed before entries are thrown out again
    step: int = 4

    @property
    def width(self) -> int:
        return self.dims // self.parts


def padded(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def sequency_order(n: int) -> np.ndarray:
    """Places of the transform's coefficients, fewest sign changes first."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < n:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of each row, padded with zeros, in sequency order."""
    rows, width = x.shape
    n = padded(width)
    y = np.zeros((rows, n), x.dtype)
    y[:, :width] = x
    h = 1
    while h < n:
        pairs = y.reshape(rows, n // (2 * h), 2, h)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return y[:, sequency_order(n)]


def nearest(x: np.ndarray, entries: np.ndarray, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row; ties go to the smaller index."""
    n = padded(x.shape[1])
    largest = max(np.abs(x).max(initial=0), max(abs(int(e)) for e in entries.ravel()))
    # a coefficient adds up to n components, and n squares are summed
    turned, book = (walsh(vec.exact(a, int(largest) * n, n)) for a in (x, entries))
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), turned.dtype)
    for a in range(0, len(x), BLOCK):
        index[a:a + BLOCK], best[a:a + BLOCK] = _searched(turned[a:a + BLOCK], book, step)
    return index, best // n


def _searched(t: np.ndarray, book: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    n = t.shape[1]
    part = np.zeros((len(t), len(book)), t.dtype)
    for j in range(min(step, n)):
        part += (t[:, j, None] - book[:, j]) ** 2
    guess = part.argmin(1)
    limit = ((t - book[guess]) ** 2).sum(1)
    row, entry = np.nonzero(part <= limit[:, None])
    sums = part[row, entry]
    for j in range(step, n, step):
        for k in range(j, min(j + step, n)):
            sums += (t[row, k] - book[entry, k]) ** 2
        left = sums <= limit[row]
        row, entry, sums = row[left], entry[left], sums[left]
        # the best sum so far leads to a whole distance that may throw out more
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        if j + step < n and len(row) > 2 * len(t):
            lead = np.minimum.reduceat(sums, begin)
            at = np.flatnonzero(sums == lead[row])
            at = at[np.diff(row[at], prepend=-1) != 0]
            limit = np.minimum(limit, ((t - book[entry[at]]) ** 2).sum(1))
    # rows ascend, and entries ascend in a row: the first of the smallest sums is the tie's winner
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(sums, begin)
    at = np.flatnonzero(sums == least[row])
    at = at[np.diff(row[at], prepend=-1) != 0]
    return entry[at], least


def starts(rows: DataFrame, cfg: Settings) -> np.ndarray:
    """(parts, entries, width): the parts of the rows with the smallest ids."""
    found = rows.filter("vec_id IS NOT NULL").select("vec_id", "v").orderBy("vec_id", "v").limit(cfg.entries).collect()
    first = np.array([r.v for r in found], dtype=object).reshape(len(found), cfg.parts, cfg.width)
    return first.transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray, cfg: Settings) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; one without parts stays."""
    parts, size, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((parts, size, width + 1), np.int64)  # the last is the count
        for batch in batches:
            x = vec.matrix(batch.column("v"), cfg.dims).reshape(-1, parts, width)
            for p in range(parts if len(x) else 0):
                index, _ = nearest(x[:, p], books[p], cfg.step)
                np.add.at(s[p], index, np.column_stack([x[:, p].astype(np.int64), np.ones(len(x), np.int64)]))
        p, e = np.nonzero(s[:, :, -1])
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)),
                                              vec.lists(s[p, e])], names=["part", "entry", "s"])

    found = vec.element_sums(rows.select("v").mapInArrow(sums, "part int, entry int, s array<bigint>"),
                             "part", "entry").collect()  # parts * entries * (width + 1) rows
    added = np.zeros((parts, size, width + 1), dtype=object)
    for r in found:
        added[r.part, r.entry, r["at"]] = int(r.total)
    books = books.copy()
    for p, e in zip(*np.nonzero(added[:, :, -1])):
        *s, n = added[p, e]
        books[p, e] = [x // n for x in s]
    return books


def encoded(df: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row of ``df``, and the codebooks."""
    rows = stored(vec.integer_vectors(df, cfg.dims, "label"), "integer-vectors")
    books = starts(rows, cfg)
    if not books.shape[1]:
        return df.sparkSession.createDataFrame([], "vec_id bigint, label int, code string, error bigint"), books
    for _ in range(cfg.rounds):
        books = moved(rows, books, cfg)
    last = books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column("v"), cfg.dims).reshape(-1, cfg.parts, cfg.width)
            if not len(x):
                continue
            found = [nearest(x[:, p], last[p], cfg.step) for p in range(cfg.parts)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum((best.astype(object) for _, best in found), np.zeros(len(x), object))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"),
                                              pa.array([c.tobytes().hex() for c in code]), vec.as_long(error)],
                                             names=["vec_id", "label", "code", "error"])

    return stored(rows.mapInArrow(run, "vec_id bigint, label int, code string, error bigint"), "codes"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, v array<int>): the entries that a code names, one after another."""
    parts, size, _ = books.shape
    literal = [F.array(*(F.array(*(F.lit(int(c)) for c in e)) for e in book)) for book in books]
    pieces = [F.element_at(literal[p], F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1)
              for p in range(parts)]
    return codes.select("vec_id", F.flatten(F.array(*pieces)).alias("v"))


def op12_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = encoded(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    sums = out.groupBy(F.col("label").alias("_label")).agg(vec.total("error").alias("label_error"))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return out.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(cfg: Settings = Settings()) -> str:
    """The query in SQL: every round compares all parts with all entries as they are."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({vec.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
flat AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS i FROM kept),
x AS MATERIALIZED (SELECT vec_id, c, i // {cfg.width} AS p, i % {cfg.width} AS i FROM flat),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {cfg.entries}),
c0 AS MATERIALIZED (SELECT p, k, i, c FROM x JOIN start USING (vec_id))"""]
    for r in range(cfg.rounds + 1):
        steps.append(f"""
d{r} AS (
  SELECT x.vec_id, x.p, m.k, CAST(sum((x.c - m.c) * (x.c - m.c)) AS BIGINT) AS d
  FROM x JOIN c{r} m USING (p, i) GROUP BY ALL),
a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(d := d, k := k)) AS m FROM d{r} GROUP BY ALL)""")
        if r < cfg.rounds:
            steps.append(f"""
m{r} AS (
  SELECT x.p, a.m.k AS k, x.i, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n
  FROM x JOIN a{r} a USING (vec_id, p) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT o.p, o.k, o.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, o.c) AS c
  FROM c{r} o LEFT JOIN m{r} m ON o.p = m.p AND o.k = m.k AND o.i = m.i)""")
    last = cfg.rounds
    return f"""WITH {','.join(steps)},
e AS (
  SELECT vec_id, string_agg(lower(printf('%02x', m.k)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM c{last})
SELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error,
  h.codebooks_sha256
FROM e JOIN kept USING (vec_id) CROSS JOIN h"""
