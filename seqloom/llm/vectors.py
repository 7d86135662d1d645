"""Vector columns: which rows take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def padded(v: Column, dim: int) -> Column:
    """Shorter vectors count as followed by zeros."""
    return F.when(F.size(v) == dim, v).otherwise(F.concat(v, F.array_repeat(F.get(v, F.lit(0)) * F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dim) - F.size(v)))))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """List column -> rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), dim)


def kind(df: DataFrame, vector: str) -> str:
    """Arrays of floats stay so; any other numbers are doubles."""
    return "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"


def take_part(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector (as of :func:`kind`) of the rows that take part; rows without a key don't."""
    d = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind(df, vector)).alias("vector"))
    return d.filter(F.col("key").isNotNull() & usable(F.col("vector")))
