"""Days on which a ticker's sentiment reached a given headline's score, and trade records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab.constants import HORIZONS
from newslab.operators.daily import by_day
from newslab.operators.events import price_forward_returns
from newslab.operators.strategy import TICKER, as_signal, uptrend


def with_overlay(frame: DataFrame, score: float | Column, keys=TICKER) -> DataFrame:
    """``headline_signal`` is 1 where smoothed sentiment is at or above the score in an
    uptrend; ``is_entry`` marks the first day of each run, the first row included."""
    level = score if isinstance(score, Column) else F.lit(score)
    marked = frame.withColumn(
        "headline_signal", as_signal((F.col("smooth_sentiment") >= level) & uptrend())
    )
    before = F.lag("headline_signal", 1, 0).over(by_day(keys))
    return marked.withColumn("is_entry", (F.col("headline_signal") == 1) & (before == 0))


def with_price_returns(frame: DataFrame) -> DataFrame:
    """Returns 1, 5 and 10 rows ahead, by ticker; take them before a frame is repeated for
    several queries."""
    return price_forward_returns(frame)


def overlay_summary(overlay: DataFrame, keys=TICKER) -> DataFrame:
    """Entries and the mean returns after them; days inside a run do not count again."""
    entry = F.col("is_entry")
    return overlay.groupBy(*keys).agg(
        F.count(F.when(entry, 1)).alias("num_signals"),
        *[F.avg(F.when(entry, F.col(f"ret_{n}d"))).alias(f"avg_{n}d") for n in HORIZONS],
    )


def zone_days(overlay: DataFrame) -> DataFrame:
    return overlay.filter(F.col("headline_signal") == 1)


def zones(overlay: DataFrame, signal: str = "headline_signal", keys=TICKER) -> DataFrame:
    """Runs of signal days. A run ends on the first day after it, or on its own last day
    while it is still open."""
    w = by_day(keys)
    on = F.col(signal) == 1
    edge = F.when(on & (F.lag(signal, 1, 0).over(w) == 0), 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = overlay.select(
        *keys, "date", signal, F.lead("date").over(w).alias("next_date"), edge.alias("edge")
    ).withColumn("zone_id", F.sum("edge").over(running))
    ends = numbered.filter(on).groupBy(*keys, "zone_id").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("last_date"),
        F.max_by(F.struct("next_date"), "date")["next_date"].alias("next_date"),
    )
    return ends.select(
        *keys, "zone_id", "start_date",
        F.coalesce("next_date", "last_date").alias("end_date"),
        F.col("next_date").isNull().alias("is_open"),
    )


def trades(backtest: DataFrame, keys=TICKER) -> DataFrame:
    """Buys and sells on the day the position opens or closes."""
    active = as_signal(F.col("position") > 0)
    moved = active - F.coalesce(F.lag(active).over(by_day(keys)), F.lit(0))
    action = F.when(F.col("_moved") == 1, "buy").when(F.col("_moved") == -1, "sell")
    return (
        backtest.withColumn("_moved", moved)
        .withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .select(*keys, "date", "action", "close", "smooth_sentiment")
    )


def chart_series(backtest: DataFrame, keys=TICKER) -> DataFrame:
    """Everything the three panels of a ticker chart show, as one table."""
    smooth = F.coalesce("smooth_sentiment", F.lit(0.0))
    return backtest.select(
        *keys, "date", "close", "sma_50", "equity", "buyhold_equity", "smooth_sentiment",
        F.greatest(smooth, F.lit(0.0)).alias("positive_sentiment"),
        F.least(smooth, F.lit(0.0)).alias("negative_sentiment"),
    )
