"""Event study: returns after headline dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslab.constants import HORIZONS
from newslab.operators.daily import by_day, merge_days


def _ahead(column: str, n: int) -> Column:
    """The n-th next trading day's value, stepping over days without a price."""
    return F.expr(
        f"lead({column}, {n}) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date)"
    )


def _percent(later: Column, base: Column) -> Column:
    return F.try_divide(later - base, base) * 100


def price_forward_returns(prices: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Percent change of the close 1, 5 and 10 rows ahead; NULL past the end."""
    close = F.col("close")
    return prices.select(
        *prices.columns,
        *[_percent(F.lead("close", n).over(by_day()), close).alias(f"ret_{n}d") for n in horizons],
    )


def event_days(matches: DataFrame) -> DataFrame:
    return matches.select("ticker", "date").filter(F.col("date").isNotNull()).distinct()


def forward_returns(days: DataFrame, prices: DataFrame, horizons=HORIZONS) -> DataFrame:
    """For each (ticker, date): the first trading day on or after it and the returns from
    there. Days after the last trading day drop out.

    This is a forward as-of join without a range condition: both tables are merged by day and
    ``lead`` skips the rows without a price, so the work is linear in days per ticker.
    """
    marked = event_days(days).withColumn("is_event", F.lit(True))
    traded = prices.select("ticker", "date", "close", F.col("date").alias("trade_date"))
    rows = merge_days(traded, marked)

    on_day = F.col("close").isNotNull()
    base = F.when(on_day, F.col("close")).otherwise(_ahead("close", 1))
    ahead = {
        n: F.when(on_day, _ahead("close", n)).otherwise(_ahead("close", n + 1)) for n in horizons
    }
    based = rows.select(
        "ticker", "date", "is_event",
        F.when(on_day, F.col("date")).otherwise(_ahead("trade_date", 1)).alias("base_date"),
        base.alias("base_close"),
        *[c.alias(f"ahead_{n}") for n, c in ahead.items()],
    )
    return based.filter(F.col("is_event") & F.col("base_date").isNotNull()).select(
        "ticker", "date", "base_date",
        *[_percent(F.col(f"ahead_{n}"), F.col("base_close")).alias(f"ret_{n}d")
          for n in horizons],
    )


def with_forward_returns(matches: DataFrame, returns: DataFrame) -> DataFrame:
    """Every match with the returns of its date, if there are any. Spark splits a date that
    holds very many matches (adaptive skew join)."""
    return matches.join(returns, ["ticker", "date"], "left")


