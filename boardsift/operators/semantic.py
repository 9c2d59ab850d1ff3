"""Similarity of listing vectors to profile vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX_BYTES = 32 << 20
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in index order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def best_similarity(vector: Column, profiles: Sequence[Sequence[float]]) -> Column:
    """The highest dot product with a profile, NULL for a missing vector.

    The profiles are configuration, so they travel as literals of the plan:
    one map-side pass, no join.  Without any profile the similarity is 0.
    """
    if not profiles:
        return F.when(vector.isNotNull(), F.lit(0.0))
    scores = [dot(vector, F.lit([float(v) for v in p])) for p in profiles]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def profile_vectors(profiles: DataFrame, column: str = "embedding", limit: int = 16) -> list[list[float]]:
    """A handful of profiles as configuration, in table order; see :func:`with_similarity` for more."""
    rows = profiles.select(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} profiles: use with_similarity")
    return [list(row[0]) for row in rows]


def _matrices(rows: list) -> dict[int, np.ndarray]:
    """Profiles by number of components, one per column; those with a missing component are left out."""
    found: dict[int, list] = {}
    for (v,) in rows:
        if v is not None and all(x is not None for x in v):
            found.setdefault(len(v), []).append(v)
    return {n: np.asarray(v, dtype=np.float64).T for n, v in found.items()}


def _best(vectors: pa.ListArray, matrices: dict[int, np.ndarray]) -> np.ndarray:
    """The highest dot product of each vector, NaN where there is none; products are made in blocks."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    out = np.full(len(vectors), np.nan)
    for n, matrix in matrices.items():
        at = np.flatnonzero(lengths == n)
        if not len(at):
            continue
        flat = vectors.take(pa.array(at)).flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)
        for k in range(0, len(at), BLOCK):
            out[at[k:k + BLOCK]] = (values[k:k + BLOCK] @ matrix).max(axis=1)
    return out


def with_similarity(df: DataFrame, vector: str, profiles: DataFrame, column: str = "embedding",
                    name: str = "similarity", max_bytes: int = MATRIX_BYTES) -> DataFrame:
    """Adds the highest dot product of ``vector`` with any row of a profile table of any size.

    Profiles up to ``max_bytes`` go to the tasks as one matrix, after their size was counted; the plan does not grow with
    them.  A larger table is taken in as many parts as it needs: each pass sends one part, keeps the
    maximum so far and is checkpointed before the matrix is dropped.  NULL for a missing vector, for one with a missing or NaN
    component, and for one whose length no profile has; 0 without profiles.
    """
    spark = df.sparkSession
    profiles = profiles.select(column).filter(F.col(column).isNotNull()).distinct()
    size = profiles.agg(F.coalesce(F.sum(F.size(column) * 8), F.lit(0))).first()[0]
    # parts are dealt by hash, so they are planned at half the size
    parts = 1 if size <= max_bytes else -(-2 * size // max_bytes)
    if not size:
        return df.withColumn(name, F.when(F.col(vector).isNotNull(), F.lit(0.0)))
    out = df.withColumn(name, F.lit(None).cast("double"))
    for k in range(parts):
        part = profiles.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == k) if parts > 1 else profiles
        sent = spark.sparkContext.broadcast(_matrices(part.collect()))

        @F.arrow_udf("double")
        def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = _best(batch, sent.value)
                yield pa.array(found, mask=np.isnan(found))

        out = out.withColumn(name, F.greatest(name, best(vector)))
        if parts > 1:
            out = out.checkpoint()
            sent.destroy()
    return out
