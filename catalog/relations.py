"""Joins and aggregations."""

from pyspark.sql import functions as F

from catalog.oracle import r, r8
from catalog.registry import query, rounded, tidy
from catalog.tables import AS_OF, TEST_KEYWORDS, Tables
from newslab.operators import daily as D
from newslab.operators import dashboard as B
from newslab.operators import dedup, events
from newslab.operators import overlay as O
from newslab.operators import search as S
from newslab.operators import strategy as ST
from newslab.operators import validate as V
from newslab.operators import verdict as VD


def list_matches(t: Tables):
    """The fixed keyword list against every ticker."""
    asked = t.universe.select(
        F.lit(1).cast("long").alias("query_id"), "ticker",
        F.array(*[F.lit(k) for k in TEST_KEYWORDS]).alias("keywords"),
    )
    return S.lexical_search(t.index, asked)


def all_returns(t: Tables):
    return events.forward_returns(events.event_days(t.raw), t.prices)


# --- joins ------------------------------------------------------------------------


@query("j1_prices_left_sentiment", f"""
    SELECT p.ticker, p.date, {r('close')}, {r8('daily_score')}, articles FROM prices p
    LEFT JOIN daily d ON d.ticker = p.ticker AND d.date = p.date""")
def j1(t: Tables):
    rows = D.prices_with_sentiment(t.prices, D.daily_sentiment(t.raw))
    return tidy(rows, "ticker", "date", "articles", r="close", r8="daily_score")


@query("j2_prices_inner_sentiment", f"""
    SELECT p.ticker, p.date, {r('close')}, {r8('daily_score')}, articles FROM prices p
    JOIN daily d ON d.ticker = p.ticker AND d.date = p.date""")
def j2(t: Tables):
    rows = D.prices_with_sentiment(t.prices, D.daily_sentiment(t.raw), how="inner")
    return tidy(rows, "ticker", "date", "articles", r="close", r8="daily_score")


@query("j3_forward_asof", "SELECT ticker, date, base_date FROM based")
def j3(t: Tables):
    return all_returns(t).select("ticker", "date", "base_date")


RETS = "ret_1d ret_5d ret_10d"


@query("j4_matches_with_returns", f"""
    SELECT m.ticker, m.headline, m.date, {r(RETS)} FROM list_matches m
    LEFT JOIN fwd f ON f.ticker = m.ticker AND f.date = m.date""")
def j4(t: Tables):
    matches = list_matches(t)
    returns = events.forward_returns(events.event_days(matches), t.prices)
    return tidy(events.with_forward_returns(matches, returns), "ticker", "headline", "date", r=RETS)


@query("j5_headlines_with_keywords", f"SELECT ticker, headline, shared_count, {r('jaccard')} FROM list_matches")
def j5(t: Tables):
    return tidy(list_matches(t), "ticker", "headline", "shared_count", r="jaccard")


@query("j6_returns_with_weights", f"""
    SELECT f.ticker, f.date, {r('weight', 8)}, {r('ret_1d')} FROM fwd f JOIN (
      SELECT ticker, date, max(exp(-ln(2) / 180 * greatest(date_diff('day', date, DATE '{AS_OF}'), 0))) AS weight
      FROM list_matches GROUP BY ticker, date) w ON w.ticker = f.ticker AND w.date = f.date""")
def j6(t: Tables):
    matches = list_matches(t)
    weights = VD.date_weights(matches, AS_OF)
    returns = events.forward_returns(events.event_days(matches), t.prices)
    joined = returns.join(weights, ["ticker", "date"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(1.0))
    )
    return tidy(joined, "ticker", "date", r="ret_1d", r8="weight")


@query("j7_headline_many_tickers", f"""
    SELECT query_id, ticker, rank, headline, shared_count, {r('jaccard')} FROM listed_matches""")
def j7(t: Tables):
    return tidy(S.lexical_search(t.index, t.ticker_queries), "query_id", "ticker", "rank",
                "headline", "shared_count", r="jaccard")


@query("j8_semi_join", """
    SELECT b.ticker, count(*) AS n FROM base b
    SEMI JOIN (SELECT ticker, date FROM overlay WHERE headline_signal = 1) z
      ON z.ticker = b.ticker AND z.date = b.date GROUP BY b.ticker""")
def j8(t: Tables):
    zone = O.zone_days(O.with_overlay(t.frame, 0.05)).select("ticker", "date")
    return t.prices.join(zone, ["ticker", "date"], "left_semi").groupBy("ticker").agg(
        F.count("*").alias("n")
    )


@query("j9_frame_by_threshold", f"""
    SELECT ticker, date, threshold, round(sr, 8) + 0.0 AS strategy_returns FROM var_ret WHERE mode = 'threshold'""")
def j9(t: Tables):
    rows = V.variant_returns(D.usable_tickers(t.frame), V.threshold_variants())
    return tidy(rows, "ticker", "date", "threshold", r8="strategy_returns")


@query("j10_frame_by_mode", f"""
    SELECT ticker, date, mode, round(sr, 8) + 0.0 AS strategy_returns FROM var_ret WHERE mode <> 'threshold'""")
def j10(t: Tables):
    rows = V.variant_returns(D.usable_tickers(t.frame), V.mode_variants())
    return tidy(rows, "ticker", "date", "mode", r8="strategy_returns")


# --- aggregations -------------------------------------------------------------------


@query("a1_dedup_index", f"SELECT ticker, headline, date, {r8('sentiment_score')} FROM headline_index")
def a1(t: Tables):
    return tidy(t.index, "ticker", "headline", "date", r8="sentiment_score")


@query("a2_dedup_after_filter", f"""
    SELECT ticker, headline, min(date) AS date, round(avg(sentiment_score), 8) + 0.0 AS sentiment_score
    FROM headlines_raw WHERE date BETWEEN DATE '1998-06-01' AND DATE '2000-05-31' GROUP BY ticker, headline""")
def a2(t: Tables):
    found = dedup.dedup_in_range(t.raw, "1998-06-01", "2000-05-31")
    return tidy(found, "ticker", "headline", "date", r8="sentiment_score")


@query("a3_dedup_for_embedding", """
    SELECT ticker, headline, min(date) AS date, round(avg(sentiment_score), 8) + 0.0 AS sentiment_score
    FROM headlines_raw GROUP BY ticker, headline""")
def a3(t: Tables):
    """What an embedder is given: each ticker's headlines once, of all tickers."""
    found = dedup.dedup_in_range(t.raw, None, None)
    return tidy(found, "ticker", "headline", "date", r8="sentiment_score")


@query("a4_daily_sentiment", f"SELECT ticker, date, {r8('daily_score')}, articles FROM daily")
def a4(t: Tables):
    return tidy(D.daily_sentiment(t.raw), "ticker", "date", "articles", r8="daily_score")


@query("a5_dashboard_sentiment", f"SELECT ticker, date, {r8('sentiment')}, articles FROM dash_daily")
def a5(t: Tables):
    return tidy(D.dashboard_sentiment(t.raw), "ticker", "date", "articles", r8="sentiment")


@query("a6_index_statistics", """
    SELECT count(*) AS n_rows, count(DISTINCT ticker) AS tickers, min(date) AS min_date, max(date) AS max_date
    FROM headline_index""")
def a6(t: Tables):
    return dedup.index_statistics(t.index)


def _as_query(df):
    return df.withColumn("query_id", F.lit(1).cast("long"))


@query("a7_weighted_sentiment", f"""
    SELECT ticker, round(sum(w * sentiment_score) / sum(w), 8) + 0.0 AS avg_sentiment FROM (
      SELECT *, exp(-ln(2) / 180 * greatest(date_diff('day', date, DATE '{AS_OF}'), 0)) AS w FROM headline_index)
    GROUP BY ticker""")
def a7(t: Tables):
    return tidy(VD.weighted_sentiment(_as_query(t.index), AS_OF), "ticker", r8="avg_sentiment")


@query("a8_class_shares", """
    SELECT ticker, round(100.0 * count(*) FILTER (WHERE s > 0.1) / count(*), 6) + 0.0 AS pct_bullish,
           round(100.0 * count(*) FILTER (WHERE s < -0.1) / count(*), 6) + 0.0 AS pct_bearish
    FROM (SELECT ticker, round(sentiment_score, 8) AS s FROM headline_index) GROUP BY ticker""")
def a8(t: Tables):
    rows = _as_query(t.index).withColumn("sentiment_score", F.round("sentiment_score", 8))
    return tidy(VD.class_shares(rows), "ticker", r="pct_bullish pct_bearish")


AVGS = "avg_1d avg_5d avg_10d"


@query("a9_weighted_returns", f"SELECT ticker, {r(AVGS)} FROM list_matches_p")
def a9(t: Tables):
    matches = list_matches(t)
    returns = events.forward_returns(events.event_days(matches), t.prices)
    return tidy(VD.weighted_returns(matches, returns, AS_OF), "ticker", r=AVGS)


@query("a10_date_weights", f"""
    SELECT ticker, date, {r8('weight')} FROM list_matches_d""")
def a10(t: Tables):
    return tidy(VD.date_weights(list_matches(t), AS_OF), "ticker", "date", r8="weight")


VERDICT = "avg_sentiment avg_1d avg_5d avg_10d pct_bullish pct_bearish"
VERDICT_PLAIN = "query_id, ticker, verdict, confidence, n_matches, recency_weighted"


def verdict_table(t: Tables, queries, matches):
    returns = events.forward_returns(events.event_days(matches), t.prices)
    return tidy(VD.verdicts(matches, returns, queries, AS_OF), *VERDICT_PLAIN.split(", "), r=VERDICT)


@query("a11_verdict_reduction", f"SELECT {VERDICT_PLAIN}, {r(VERDICT)} FROM list_matches_v")
def a11(t: Tables):
    return verdict_table(t, t.ticker_queries, list_matches(t))


def _metric(name: str, columns: str, places: int = 6):
    @query(name, f"SELECT ticker, {r(columns, places)} FROM stats")
    def build(t: Tables):
        return ST.metrics(t.backtest).select("ticker", *[rounded(c, places) for c in columns.split()])

    return build


_metric("a12_total_return", "total_return bh_total_return")
_metric("a13_cagr", "cagr bh_cagr")
_metric("a14_volatility", "volatility bh_volatility")
_metric("a15_sharpe", "sharpe bh_sharpe")
_metric("a16_max_drawdown", "max_drawdown bh_max_drawdown")
_metric("a18_exposure", "exposure")
_metric("a19_win_rate", "daily_win_rate")

METRICS = ("total_return cagr volatility sharpe max_drawdown bh_total_return bh_cagr "
           "bh_volatility bh_sharpe bh_max_drawdown exposure daily_win_rate")


@query("a17_entries", "SELECT ticker, n_trades FROM stats")
def a17(t: Tables):
    return ST.metrics(t.backtest).select("ticker", "n_trades")


@query("a20_metrics", f"SELECT ticker, n_trades, {r(METRICS)} FROM stats")
def a20(t: Tables):
    return tidy(ST.metrics(t.backtest), "ticker", "n_trades", r=METRICS)


@query("a21_overlay_means", """
    SELECT ticker, count(*) FILTER (WHERE is_entry) AS num_signals,
           round(avg(ret_1d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_1d,
           round(avg(ret_5d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_5d,
           round(avg(ret_10d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_10d
    FROM overlay GROUP BY ticker""")
def a21(t: Tables):
    overlay = O.with_overlay(O.with_price_returns(t.frame), 0.05)
    return tidy(O.overlay_summary(overlay), "ticker", "num_signals", r=AVGS)


def _scores(t: Tables):
    frame = V.universe_frames(t.raw, t.prices, t.universe)
    return V.variant_scores(frame, V.threshold_variants() + V.mode_variants())


@query("a22_mean_sharpe", f"SELECT split, threshold, {r('mean_sharpe')} FROM sweep")
def a22(t: Tables):
    return tidy(V.mean_sharpe(_scores(t), V.alternating_split(t.universe)), "split", "threshold",
                r="mean_sharpe")


@query("a23_best_threshold", f"SELECT split, threshold, {r('mean_sharpe')} FROM best")
def a23(t: Tables):
    sweep = V.mean_sharpe(_scores(t), V.alternating_split(t.universe))
    return tidy(V.best_threshold(sweep), "split", "threshold", r="mean_sharpe")


@query("a24_component_sharpe", f"SELECT mode, {r('mean_sharpe')} FROM components")
def a24(t: Tables):
    return tidy(V.decomposition(_scores(t)), "mode", r="mean_sharpe")


@query("a25_cards", """
    SELECT ticker, round(arg_max(close, date), 6) + 0.0 AS last_close,
           round(avg(sentiment) FILTER (WHERE n <= 30), 8) + 0.0 AS avg_30,
           max(total_articles) AS total_articles, min(date) AS first_date, max(date) AS last_date,
           count(*) AS trading_days
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM dash_whole)
    GROUP BY ticker""")
def a25(t: Tables):
    return tidy(B.cards(B.dashboard_series(t.raw, t.prices)), "ticker", "total_articles",
                "first_date", "last_date", "trading_days", r="last_close", r8="avg_30")


@query("a26_sentiment_days", "SELECT ticker, count(daily_score) AS sentiment_days FROM frame GROUP BY ticker")
def a26(t: Tables):
    return D.sentiment_days(t.frame)
