"""Daily adjusted close prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslab.functions.dates import DateLike, day, within
from newslab.sources.paths import require


def scan_prices(spark: SparkSession, path: str, fmt: str = "parquet",
                columns: dict[str, str] | None = None, date_from: DateLike = None,
                date_to: DateLike = None, **options) -> DataFrame:
    """A long price table ``(ticker, date, close)`` in any format Spark reads."""
    require(spark, path, "price table")
    return as_prices(spark.read.format(fmt).options(**options).load(path), columns,
                     date_from, date_to)


def as_prices(table: DataFrame, columns: dict[str, str] | None = None,
              date_from: DateLike = None, date_to: DateLike = None) -> DataFrame:
    names = {"ticker": "ticker", "date": "date", "close": "close"} | (columns or {})
    rows = table.select(
        F.col(names["ticker"]).cast("string").alias("ticker"),
        day(F.col(names["date"])).alias("date"),
        F.col(names["close"]).cast("double").alias("close"),
    )
    return within(rows, date_from, date_to).filter(F.col("close").isNotNull())


def long_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """A frame with one price column per ticker as ``(ticker, date, close)``; picking one
    ticker is then a filter, which prunes the other columns."""
    tickers = [c for c in wide.columns if c != date]
    return as_prices(wide.unpivot([date], tickers, "ticker", "close"), {"date": date})
