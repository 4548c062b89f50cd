"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that are worked on at once; 64 MB at most, by Spark's own limit for a batch.
SLICE = 512


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def key_hash(column: str) -> Column:
    """crc32 of an id written as text: the rule by which rows are held out."""
    return F.crc32(F.col(column).cast("string"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 row bounds, without copying; null is empty."""
    column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int32)[column.offset:column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def by_slice(batches: Iterator[pa.RecordBatch],
             work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to slices of the batches, so that its arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield work(batch.slice(at, SLICE))


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to ``most`` bytes of text (a longer text is alone)."""
    for batch in batches:
        _, ends = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def spread(df: DataFrame) -> int:
    """The number of partitions for explicit exchanges: what the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
