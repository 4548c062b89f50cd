"""Tables behind a ticker dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newslab.functions.dates import lookback_start
from newslab.functions.numbers import sign_class
from newslab.operators.daily import all_days, by_day, dashboard_sentiment, merge_days

CARD_ROWS = 30
LINE_ROWS = 7


def dashboard_series(headlines: DataFrame, prices: DataFrame, lookback: str = "all",
                     since: str | None = None) -> DataFrame:
    """Trading days with sentiment inside a look-back from the last sentiment day, and the
    7-row mean line. ``total_articles`` counts all of the ticker's headlines, also those
    before the look-back, from ``since`` on if it is given."""
    rows = merge_days(prices.select("ticker", "date", "close"), dashboard_sentiment(headlines, since))
    last = F.max(F.when(F.col("n_rows").isNotNull(), F.col("date"))).over(all_days())
    rows = rows.withColumns({
        "_last": last, "total_articles": F.sum("n_rows").over(all_days()),
    })
    start = lookback_start(F.col("_last"), lookback)
    if start is not None:
        rows = rows.filter(F.col("date") >= start)
    rows = rows.filter(F.col("close").isNotNull()).dropna(subset=["sentiment"])
    line = F.avg("sentiment").over(by_day().rowsBetween(1 - LINE_ROWS, 0))
    return rows.select(
        "ticker", "date", "close", "sentiment", "articles", "total_articles",
        F.when(F.count("*").over(all_days()) >= LINE_ROWS, line).alias("sentiment_7d"),
        sign_class(F.col("sentiment")).alias("bar"),
    )


def last_rows_mean(series: DataFrame, rows: int = CARD_ROWS) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return (
        series.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= rows)
        .groupBy("ticker")
        .agg(F.avg("sentiment").alias("avg_30"))
    )


def cards(series: DataFrame) -> DataFrame:
    """One row per ticker, in a single pass over the series."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = F.col("_n") <= CARD_ROWS
    return (
        series.withColumn("_n", F.row_number().over(newest))
        .groupBy("ticker")
        .agg(
            F.max_by("close", "date").alias("last_close"),
            F.avg(F.when(recent, F.col("sentiment"))).alias("avg_30"),
            F.max("total_articles").alias("total_articles"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.count("*").alias("trading_days"),
        )
    )
