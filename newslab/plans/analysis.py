"""From headlines to evidence, verdicts and equity curves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from newslab import constants as C
from newslab.functions.dates import DateLike
from newslab.operators import verdict as V
from newslab.operators.daily import usable_tickers
from newslab.operators.events import event_days, forward_returns
from newslab.operators.overlay import overlay_summary, with_overlay, with_price_returns
from newslab.operators.scoring import score_text
from newslab.operators.search import METHODS, asked_tickers, check_queries, for_tickers, search, tickers_only
from newslab.operators.skew import join_many_to_series
from newslab.operators.strategy import apply_signal, metrics, run_backtest, strategy_frame
from newslab.session import settle

KEY = ("query_id", "ticker")
LEVEL = ("ticker", "live_score")


@dataclass(frozen=True)
class Analysis:
    """The steps of an analysis, each worked out when it is first asked for.

    The matches, at most ``top_n`` rows per query, are stored then: the search over all headlines runs once, and
    returns, verdicts and report read its result. Whoever wants the scored queries alone pays for no search.
    """

    queries: DataFrame      # with keywords, reject_reason and live_score
    prices: DataFrame
    find: Callable[[DataFrame], DataFrame]
    as_of: DateLike = None

    @cached_property
    def usable(self) -> DataFrame:
        """Stored, because the search, the verdicts and the comparison all read them, and a model should score them once."""
        return settle(self.queries.filter(F.col("reject_reason").isNull()), "queries")

    @cached_property
    def matches(self) -> DataFrame:
        return settle(self.find(self.usable), "matches")

    @cached_property
    def returns(self) -> DataFrame:
        return forward_returns(event_days(self.matches), prices_from(self.prices, self.matches))

    @cached_property
    def verdicts(self) -> DataFrame:
        return V.verdicts(self.matches, self.returns, self.usable, self.as_of)

    @cached_property
    def report(self) -> DataFrame:
        return V.report_rows(self.matches, self.returns)

    @cached_property
    def comparison(self) -> DataFrame:
        return V.comparison(self.verdicts, self.usable)


def prices_from(prices: DataFrame, matches: DataFrame) -> DataFrame:
    """Prices of the matched tickers from their first matched day on: all that returns after matches can need. The
    bounds come from the stored matches, and reach the price scan as a runtime filter."""
    first = settle(matches.groupBy("ticker").agg(F.min("date").alias("_first")).filter(F.col("_first").isNotNull()), "first-days")
    return prices.join(first, "ticker").filter(F.col("date") >= F.col("_first")).drop("_first")


def analyze(queries: DataFrame, headlines: DataFrame, prices: DataFrame, method: str = "auto",
            corpus: DataFrame | None = None, embed: Callable | None = None,
            scorer: Callable | None = None, top_n: int = C.TOP_N, date_from: DateLike = None,
            date_to: DateLike = None, as_of: DateLike = None, **search_options) -> Analysis:
    """Search, event study and verdict for a table ``(query_id, ticker, headline)``.
    ``scorer`` and ``embed`` add ``live_score`` and ``embedding`` to the queries."""
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}")
    scored = (scorer or score_text)(check_queries(queries, method))

    def find(usable: DataFrame) -> DataFrame:
        return search(usable, headlines, method, corpus, embed, top_n, date_from, date_to, **search_options)

    return Analysis(scored, prices, find, as_of)


def compare(queries: DataFrame, tickers: Column, headlines: DataFrame, prices: DataFrame,
            **options) -> Analysis:
    """The same headlines against many tickers. Each headline is scored once, before it is
    repeated per ticker."""
    scorer = options.pop("scorer", None) or score_text
    scored = for_tickers(scorer(queries), tickers)
    return analyze(scored, headlines, prices, scorer=lambda df: df, **options)


@dataclass(frozen=True)
class SignalBacktest:
    analysis: Analysis
    backtest: DataFrame
    metrics: DataFrame
    overlay: DataFrame
    overlay_summary: DataFrame


def unified(queries: DataFrame, headlines: DataFrame, prices: DataFrame,
            daily_source: DataFrame | None = None, **options) -> SignalBacktest:
    """The analysis, then trading the ticker whenever its sentiment is above the headline's
    own score. Queries without a score have no backtest. Daily sentiment comes from ``daily_source`` where that
    differs from the searched table.

    A backtest depends on the ticker and the score alone, so each different pair of them is run once, and queries
    that share it meet its result: their number costs one row each, not a series. The scores are stored once,
    because the join reads them several times and a model should not run again for each; only tickers with a score get a frame.
    """
    analysis = analyze(queries, headlines, prices, **options)
    levels = settle(analysis.usable.filter(F.col("live_score").isNotNull()).select(*KEY, "live_score").distinct(), "levels")
    tickers = asked_tickers(levels)
    source = headlines if daily_source is None else daily_source
    frame = with_price_returns(traded_frame(tickers_only(source, tickers), tickers_only(prices, tickers)))
    rows = join_many_to_series(levels.select(*LEVEL).distinct(), frame, "ticker")
    level = F.col("live_score")
    backtest = run_backtest(apply_signal(rows, level), LEVEL)
    overlay = with_overlay(rows, level, LEVEL)

    def of_queries(found: DataFrame) -> DataFrame:
        return levels.join(found, [*LEVEL]).select(*KEY, *[c for c in found.columns if c not in KEY])

    return SignalBacktest(
        analysis=analysis, backtest=of_queries(backtest), metrics=of_queries(metrics(backtest, LEVEL)),
        overlay=of_queries(overlay), overlay_summary=of_queries(overlay_summary(overlay, LEVEL)),
    )


def traded_frame(headlines: DataFrame, prices: DataFrame) -> DataFrame:
    """Strategy frames of tickers with at least one day of sentiment."""
    return usable_tickers(strategy_frame(headlines, prices), 0)


def backtest_all(headlines: DataFrame, prices: DataFrame,
                 threshold: float = C.SIGNAL_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Backtest and metrics of every ticker that has sentiment, in one job."""
    backtest = run_backtest(apply_signal(traded_frame(headlines, prices), threshold))
    return backtest, metrics(backtest)
