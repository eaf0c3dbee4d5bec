"""Vectors as exact integers: floor(256 * x) of each component, x as double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components may be so large; beyond, results would not fit in a long, and an error names the limit.
LIMIT = 1 << 26


def sound(vector: Column) -> Column:
    """True where a vector and all its components are there and finite; never null."""
    one = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < one), F.lit(False))), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component as array<int>."""

    def one(x):
        scaled = F.floor(F.lit(256.0) * x.cast("double"))
        far = F.abs(x.cast("double")) * 256 > LIMIT
        return F.when(far, F.raise_error(F.lit(f"a component is beyond {LIMIT // 256}, so that scores would not fit in a long"))).otherwise(scaled).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column whose rows all have `width` components, as int64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def exact_type(width: int, a: int, b: int) -> type:
    """The quickest type in which sums of `width` products of components up to a and b are exact; ValueError if none."""
    most = width * a * b
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    if most < 1 << 63:
        return np.int64
    raise ValueError(f"inner products of {width} components up to {a} and {b} do not fit in a long")
