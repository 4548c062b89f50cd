"""Build of the headline index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newslab.operators.dedup import dedup_index, index_statistics
from newslab.sources.headlines import scan_headlines, write_index


def build_index(spark: SparkSession, raw_path: str, index_path: str, overwrite: bool = False,
                columns: dict[str, str] | None = None) -> DataFrame:
    """Deduplicate, sort by ticker, write, and report on the written table."""
    raw = scan_headlines(spark, raw_path, columns)
    write_index(dedup_index(raw), index_path, overwrite)
    return index_statistics(scan_headlines(spark, index_path))
