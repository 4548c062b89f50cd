"""Vectors that take part in comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(id, v array<double>)``, one per key: of rows that share a key the smallest usable vector.

    Vectors null, empty, zero, or with null or non-finite components are left out, and null keys.
    """
    number = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), number.alias("v"))
    return (rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
            .groupBy("id").agg(F.min("v").alias("v")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
