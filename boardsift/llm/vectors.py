"""Integer vectors made from arrays of floats, compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * x) and has to fit an ``int``.
SCALE = 1024
FITS = float(2**31)


def integer_vectors(df: DataFrame, dims: int, *others: str) -> DataFrame:
    """(vec_id, others, v array<int>) of the rows whose ``embedding`` can be used.

    Dropped: null vectors, those of another length than ``dims``, with a null or non-finite
    component, or with one of 2^21 and more, whose squared distances a long cannot hold.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return df.filter(usable(F.col("embedding"), dims)).select("vec_id", *others, scaled.cast("array<int>").alias("v"))


def usable(embedding: Column, dims: int) -> Column:
    # comparisons with NaN are true only for "greater", so NaN is out as well
    fits = F.forall(embedding, lambda x: F.coalesce(
        (x.cast("double") * SCALE < FITS) & (x.cast("double") * SCALE >= -FITS), F.lit(False)))
    return F.coalesce((F.size(embedding) == dims) & fits, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(values: np.ndarray) -> pa.Array:
    """A list column from a matrix."""
    rows, dims = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dims), pa.array(values.ravel()))


def exact(values: np.ndarray, largest: int, terms: int) -> np.ndarray:
    """``values`` as integers whose summed squared differences cannot overflow.

    ``largest`` bounds all magnitudes that meet, ``terms`` the number of squares summed.  Beyond
    64 bits Python's integers are used, slower but exact.
    """
    small = (2 * largest) ** 2 * terms < 2**62
    return values.astype(np.int64) if small else np.array(values, dtype=object)


def as_long(values: np.ndarray) -> pa.Array:
    """A long column; what does not fit becomes null."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if abs(v) < 2**63 else None for v in values], pa.int64())


def total(column: str) -> Column:
    """An exact sum of longs as a long, null when it does not fit."""
    return F.sum(F.col(column).cast("decimal(38,0)")).try_cast("bigint")


def element_sums(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, total): exact sums of the elements of the array column ``s``."""
    return df.select(*keys, F.posexplode("s").alias("at", "_s")).groupBy(*keys, "at").agg(
        F.sum(F.col("_s").cast("decimal(38,0)")).alias("total"))
