"""Columns of vectors: which rows can be used, and their components as arrays in Python tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")


def finite(vector: Column) -> Column:
    """Whether the vector is there and all of its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INFINITE))


def integers(vector: Column) -> Column:
    """floor(256 * c) of each component, computed in double precision."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256.0))


def width(df: DataFrame, vector: str) -> tuple[int, int]:
    """The least and the largest number of components; (0, 0) without rows."""
    row = df.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    return row["least"] or 0, row["most"] or 0


def padded(vector: Column, d: int, zero: str = "bigint") -> Column:
    """The vector with zeros for the components that it lacks of d."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast(zero), F.lit(d) - F.size(vector)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d components each (without nulls) as one array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
