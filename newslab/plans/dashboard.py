"""Dashboard tables of all tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newslab.operators.dashboard import cards, dashboard_series


def dashboard(headlines: DataFrame, prices: DataFrame,
              lookback: str = "all", since: str | None = None) -> tuple[DataFrame, DataFrame]:
    series = dashboard_series(headlines, prices, lookback, since)
    return series, cards(series)
