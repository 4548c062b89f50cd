"""Long/cash strategy on smoothed sentiment and trend: indicators, backtest, metrics.

Every window of a frame is partitioned by ticker and ordered by date, so the whole chain runs
on one exchange and one sort. A ticker has at most one row per calendar day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab import constants as C
from newslab.functions.numbers import net_return, sharpe, sizing_weight
from newslab.operators.daily import by_day, daily_sentiment, prices_with_sentiment

ANNUAL = math.sqrt(C.TRADING_DAYS)
TICKER = ("ticker",)


def _last_rows(n: int, keys=TICKER):
    return by_day(keys).rowsBetween(1 - n, 0)


def _so_far(keys):
    return by_day(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _full(value: Column, over, n: int, result: Column) -> Column:
    """``result`` only where the frame holds ``n`` values."""
    return F.when(F.count(value).over(over) >= n, result.over(over))


# --- indicators --------------------------------------------------------------


def fill_sentiment(rows: DataFrame, limit: int = C.FILL_ROWS) -> DataFrame:
    """Carry the last score over at most ``limit`` trading days; articles are not filled."""
    window = by_day().rowsBetween(-limit, 0)
    return rows.withColumn("daily_score", F.last("daily_score", ignorenulls=True).over(window))


def with_indicators(rows: DataFrame) -> DataFrame:
    change = F.try_divide(F.col("close"), F.lag("close").over(by_day())) - 1
    rows = fill_sentiment(rows).withColumn("returns", change)
    w20, w50 = _last_rows(20), _last_rows(50)
    returns, close = F.col("returns"), F.col("close")
    return rows.withColumns({
        "volatility_20d": _full(returns, w20, 20, F.stddev_samp(returns)) * ANNUAL,
        "smooth_sentiment": F.avg("daily_score").over(_last_rows(3)),
        "sma_50": _full(close, w50, 50, F.avg(close)),
    })


def strategy_frame(headlines: DataFrame, prices: DataFrame,
                   lead_days: int = C.LEAD_DAYS) -> DataFrame:
    """One row per ticker and trading day with sentiment and indicators."""
    rows = prices_with_sentiment(prices, daily_sentiment(headlines), lead_days=lead_days)
    return with_indicators(rows)


# --- signals -----------------------------------------------------------------


def uptrend() -> Column:
    return F.col("close") > F.col("sma_50")


def as_signal(condition: Column) -> Column:
    """1 where the condition holds; an unknown condition is 0."""
    return F.when(condition, 1).otherwise(0)


def apply_signal(frame: DataFrame, threshold: float | Column = C.SIGNAL_THRESHOLD) -> DataFrame:
    """Long when smoothed sentiment is strictly above the threshold in an uptrend."""
    level = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return frame.withColumn("signal", as_signal((F.col("smooth_sentiment") > level) & uptrend()))


# --- backtest ----------------------------------------------------------------


def run_backtest(frame: DataFrame, keys=TICKER) -> DataFrame:
    """Positions follow the signal of the day before; costs are paid on changes."""
    w = by_day(keys)
    target = F.col("signal") * sizing_weight(F.col("volatility_20d"))
    held = frame.withColumn("position", F.lag(target, 1, 0.0).over(w))
    position = F.col("position")
    turned = held.withColumn(
        "turnover", F.abs(position - F.coalesce(F.lag(position).over(w), F.lit(0.0)))
    )
    earned = turned.withColumn(
        "strategy_returns", net_return(position, F.col("returns"), F.col("turnover"))
    )
    return earned.withColumns({
        "equity": equity_curve(F.col("strategy_returns"), keys),
        "buyhold_equity": equity_curve(F.col("returns"), keys),
    })


def equity_curve(returns: Column, keys=TICKER) -> Column:
    growth = F.lit(1.0) + F.coalesce(returns, F.lit(0.0))
    return F.product(growth).over(_so_far(keys)) * C.CAPITAL


def drawdown(equity: str, keys=TICKER) -> Column:
    return F.col(equity) / F.max(equity).over(_so_far(keys)) - 1


# --- metrics -----------------------------------------------------------------


def growth_rate(total: Column, n_days: Column) -> Column:
    """Yearly growth; undefined after a total loss."""
    return F.when(
        (total > -1) & (n_days > 0),
        F.pow(1 + total, F.try_divide(F.lit(float(C.TRADING_DAYS)), n_days)) - 1,
    )


def entries(signal: str = "signal", keys=TICKER) -> Column:
    """A change from 0 to 1; the first row never counts."""
    return (F.col(signal) == 1) & (F.lag(signal).over(by_day(keys)) == 0)


def metrics(backtest: DataFrame, keys=TICKER) -> DataFrame:
    """Strategy and buy-and-hold statistics, one row per key."""
    rows = backtest.select(
        *keys, "date", "position", "strategy_returns", "returns", "equity", "buyhold_equity",
        entries(keys=keys).alias("entry"),
        drawdown("equity", keys).alias("dd"),
        drawdown("buyhold_equity", keys).alias("bh_dd"),
    )
    active = F.col("position") > 0
    sums = rows.groupBy(*keys).agg(
        *_curve_sums("strategy_returns", "equity", "dd", ""),
        *_curve_sums("returns", "buyhold_equity", "bh_dd", "bh_"),
        F.count(F.when(F.col("entry"), 1)).alias("n_trades"),
        F.avg(F.when(active, 1.0).otherwise(0.0)).alias("exposure"),
        F.avg(
            F.when(active & F.col("strategy_returns").isNotNull(),
                   F.when(F.col("strategy_returns") > 0, 1.0).otherwise(0.0))
        ).alias("daily_win_rate"),
    )
    return sums.select(
        *keys, *_curve_stats(""), *_curve_stats("bh_"), "n_trades", "exposure", "daily_win_rate"
    )


def _curve_sums(returns: str, equity: str, dd: str, prefix: str) -> list[Column]:
    return [
        F.count(returns).alias(f"{prefix}n"),
        F.avg(returns).alias(f"{prefix}mean"),
        F.stddev_samp(returns).alias(f"{prefix}sd"),
        (F.max_by(equity, "date") / C.CAPITAL - 1).alias(f"{prefix}total"),
        F.min(dd).alias(f"{prefix}worst"),
    ]


def _curve_stats(prefix: str) -> list[Column]:
    n, mean, sd, total, worst = (
        F.col(prefix + c) for c in ("n", "mean", "sd", "total", "worst")
    )
    return [
        F.when(n > 0, total).alias(f"{prefix}total_return"),
        growth_rate(total, n).alias(f"{prefix}cagr"),
        (sd * ANNUAL).alias(f"{prefix}volatility"),
        sharpe(mean, sd).alias(f"{prefix}sharpe"),
        F.when(n > 0, worst).alias(f"{prefix}max_drawdown"),
    ]
