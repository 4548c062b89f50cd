"""Deduplication of headlines. Spark aggregates within each task before the shuffle, so a
headline with very many copies arrives as one partial row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newslab.functions.dates import DateLike, within


def dedup_index(raw: DataFrame) -> DataFrame:
    """First date and mean score of each headline of a ticker."""
    return raw.groupBy("ticker", "headline").agg(
        F.min("date").alias("date"), F.avg("sentiment_score").alias("sentiment_score")
    )


def dedup_in_range(raw: DataFrame, date_from: DateLike = None,
                   date_to: DateLike = None) -> DataFrame:
    """Filter first, then take the first date inside the range."""
    return dedup_index(within(raw, date_from, date_to))


def index_statistics(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("ticker").alias("tickers"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
