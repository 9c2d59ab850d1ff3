"""Centroid clustering of integer vectors, filtered in rotated coordinates.

The vectors are turned to the principal axes of the whole table.  Each row stores its leading
coordinates there and the length of what is left; for a centroid, the squared distance of the
leading parts plus the squared difference of the lengths is a lower bound of the squared distance.
Only centroids whose bound, less a margin for rounding, does not exceed the best distance found are
compared component by component, in integers.  So the rotation and its rounding never decide.

Each round is one pass of tasks over the stored vectors; a task gives one row of sums for each
centroid, Spark adds these, and the driver sees ``clusters`` rows.

Nulls and odd rows: see ``vectors.integer_vectors`` for rows that are dropped.  A null vec_id is
clustered but is no start.  Repeated rows count each.  With fewer rows than ``clusters`` there are
as many centroids as rows; an empty table gives no row.  Distances and sums that a long does not
hold are null.  Further columns are ignored.
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

#: Relative rounding of rotated coordinates kept as 32-bit floats, with a wide margin.
SLACK = 1e-5


@dataclass(frozen=True)
class Settings:
    dims: int = 64
    clusters: int = 8
    rounds: int = 10
    seed: int = 3
    #: coordinates kept of each rotated vector
    leading: int = 16


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leading coordinates, length of the rest, length) of each row."""
        x = x.astype(np.float64) - self.mean
        lead = x @ self.axes
        whole = np.einsum("ij,ij->i", x, x)
        rest = np.sqrt(np.maximum(whole - np.einsum("ij,ij->i", lead, lead), 0))
        return lead, rest, np.sqrt(whole)


def principal_axes(rows: DataFrame, cfg: Settings) -> Rotation:
    """The axes of largest variance over all rows, from sums of products added up by Spark."""
    at, other = np.tril_indices(cfg.dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(cfg.dims), np.zeros((cfg.dims, cfg.dims))
        for batch in batches:
            x = vec.matrix(batch.column("v"), cfg.dims).astype(np.float64)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([at, np.arange(cfg.dims), [0]]).astype(np.int32)),
                pa.array(np.concatenate([other, np.full(cfg.dims, -1), [-2]]).astype(np.int32)),
                pa.array(np.concatenate([p[at, other], s, [float(n)]]))], names=["i", "j", "s"])

    sums = rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(
        F.sum("s").alias("s")).collect()  # dims * (dims + 3) / 2 + 1 rows
    n, mean, cov = 0.0, np.zeros(cfg.dims), np.zeros((cfg.dims, cfg.dims))
    for i, j, s in sums:
        if j == -2:
            n = s
        elif j == -1:
            mean[i] = s
        else:
            cov[i, j] = cov[j, i] = s
    if n:
        mean /= n
        cov = cov / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    return Rotation(mean, axes[:, ::-1][:, :cfg.leading])


def turned(rows: DataFrame, rotation: Rotation, cfg: Settings) -> DataFrame:
    """(vec_id, v, lead array<float>, rest float, length float)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest, length = rotation.turned(vec.matrix(batch.column("v"), cfg.dims))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("v"), vec.lists(lead.astype(np.float32)),
                pa.array(rest.astype(np.float32)), pa.array(length.astype(np.float32))],
                names=["vec_id", "v", "lead", "rest", "length"])

    return rows.select("vec_id", "v").mapInArrow(
        run, "vec_id bigint, v array<int>, lead array<float>, rest float, length float")


def starts(rows: DataFrame, cfg: Settings) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.filter("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(
        cfg.clusters).collect()
    return np.array([r.v for r in found], dtype=object).reshape(len(found), cfg.dims)


@dataclass(frozen=True)
class Centroids:
    """Integer centroids and their rotated form."""

    at: np.ndarray
    rotation: Rotation

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray, length: np.ndarray):
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        largest = max(np.abs(x).max(initial=0), max(abs(int(c)) for c in self.at.ravel()))
        x, at = (vec.exact(a, int(largest), x.shape[1]) for a in (x, self.at))
        c_lead, c_rest, c_length = self.rotation.turned(self.at)
        lead = lead.astype(np.float64)
        near = ((lead**2).sum(1)[:, None] + (c_lead**2).sum(1) - 2 * lead @ c_lead.T
                + (rest.astype(np.float64)[:, None] - c_rest) ** 2)
        low = np.sqrt(np.maximum(near, 0)) - SLACK * (length.astype(np.float64)[:, None] + c_length)
        low = np.where(low > 0, low, 0.0) ** 2
        number = near.argmin(1)
        best = ((x - at[number]) ** 2).sum(1)
        first = number.copy()
        for k in range(len(at)):
            rows = np.flatnonzero((first != k) & (low[:, k] <= best.astype(np.float64)))
            found = ((x[rows] - at[k]) ** 2).sum(1)
            closer = (found < best[rows]) | ((found == best[rows]) & (k < number[rows]))
            rows, found = rows[closer], found[closer]
            best[rows], number[rows] = found, k
        return number, best


def _assigned(batch: pa.RecordBatch, centroids: Centroids, cfg: Settings):
    x = vec.matrix(batch.column("v"), cfg.dims)
    lead = vec.matrix(batch.column("lead"), min(cfg.leading, cfg.dims))
    number, best = centroids.nearest(x, lead, *(batch.column(c).to_numpy(zero_copy_only=False)
                                                for c in ("rest", "length")))
    return x, number, best


def moved(rows: DataFrame, centroids: Centroids, cfg: Settings) -> Centroids:
    """Each centroid at the floor of the mean of its rows; one without rows stays."""
    k = len(centroids.at)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((k, cfg.dims + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, number, _ = _assigned(batch, centroids, cfg)
                np.add.at(s, number, np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)]))
        if s.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), vec.lists(s)],
                                             names=["cluster", "s"])

    found = vec.element_sums(rows.select("v", "lead", "rest", "length").mapInArrow(
        sums, "cluster int, s array<bigint>"), "cluster").collect()  # clusters * (dims + 1) rows
    added = np.zeros((k, cfg.dims + 1), dtype=object)
    for r in found:
        added[r.cluster, r["at"]] = int(r.total)
    at = centroids.at.copy()
    for c, (*s, n) in enumerate(added):
        if n:
            at[c] = [x // n for x in s]
    return Centroids(at, centroids.rotation)


def clustered(df: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable row of ``df``, and the centroids."""
    rows = vec.integer_vectors(df, cfg.dims)
    at = starts(rows, cfg)
    if not len(at):
        return df.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), at
    rotation = principal_axes(rows, cfg)
    rows = stored(turned(rows, rotation, cfg), "turned-vectors")
    centroids = Centroids(at, rotation)
    for _ in range(cfg.rounds):
        centroids = moved(rows, centroids, cfg)
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, number, best = _assigned(batch, last, cfg)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)),
                                                  vec.as_long(best)], names=["vec_id", "cluster", "distance"])

    return stored(rows.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids.at


def op13_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Settings()
    out, at = clustered(table(spark, sf_dir, "embeddings"), cfg)
    inertia = dict(out.groupBy("cluster").agg(vec.total("distance")).collect())  # a row for each centroid
    parts = [inertia.get(k) for k in range(len(at))]
    # a null sum is one that does not fit; a centroid without rows has none
    whole = None if any(v is None for k, v in enumerate(parts) if k in inertia) else sum(v or 0 for v in parts)
    if whole is not None and whole >= 2**63:
        whole = None
    hashes = [hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest() for row in at]
    place = F.col("cluster") + 1

    def looked_up(values, kind):
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)).cast(f"array<{kind}>"), place)

    return out.select("vec_id", "cluster", "distance", looked_up(parts, "bigint").alias("cluster_inertia"),
                      F.lit(whole).cast("bigint").alias("inertia"), looked_up(hashes, "string").alias("centroid_sha256"))


def sql(cfg: Settings = Settings()) -> str:
    """The query in SQL: every round compares all vectors with all centroids, without a filter."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({vec.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {cfg.dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM kept),
start AS (
  SELECT row_number() OVER (ORDER BY sha256('{cfg.seed}:' || vec_id)) - 1 AS k, v FROM kept
  QUALIFY k < {cfg.clusters}),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM start)"""]
    for r in range(cfg.rounds + 1):
        steps.append(f"""
d{r} AS (
  SELECT x.vec_id, m.k, CAST(sum((x.c - m.c) * (x.c - m.c)) AS BIGINT) AS d
  FROM x JOIN c{r} m USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (
  SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < cfg.rounds:
            steps.append(f"""
m{r} AS (
  SELECT a.k, x.i, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT o.k, o.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, o.c) AS c
  FROM c{r} o LEFT JOIN m{r} m ON o.k = m.k AND o.i = m.i)""")
    last = cfg.rounds
    return f"""WITH {','.join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k),
s AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{last} GROUP BY k)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, s.cluster_inertia,
  CAST((SELECT sum(d) FROM a{last}) AS BIGINT) AS inertia, h.centroid_sha256
FROM a{last} a JOIN s USING (k) JOIN h USING (k)"""
