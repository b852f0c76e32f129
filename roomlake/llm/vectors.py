"""Vectors of Arrow list columns as numpy, with the rows that are usable, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    v = F.col(column)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``block``: a hash of the key into blocks of about ``size`` rows."""
    n = rows.count()
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size)))).cast("int"))
