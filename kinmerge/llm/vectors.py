"""What the operators on embeddings share: valid vectors, Arrow lists as matrices, sign hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: str = "embedding") -> Column:
    """True for a vector that is there, not empty, and all of whose components are finite numbers."""
    x = F.col(embedding)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ok, F.lit(False))


def one_each(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each vec_id that is not null; of several the least in the order of the columns."""
    least = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("x"))
    return least.select("vec_id", *(F.col(f"x.{c}") for c in columns))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sign_codes(x: np.ndarray, seed: int) -> np.ndarray:
    """64 random half-space tests of each row, as one number whose order is their lexicographic order."""
    planes = np.random.Generator(np.random.Philox(key=[seed, x.shape[1]])).standard_normal((x.shape[1], 64))
    scale = np.max(np.abs(x), axis=1, keepdims=True, initial=0)
    bits = (x / np.where(scale > 0, scale, 1)) @ planes > 0
    code = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return (code ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the order of the unsigned ones
