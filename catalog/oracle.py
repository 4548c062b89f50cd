"""Common table expressions of the SQL texts. The logic is stated anew in SQL; only fixed
values are shared with the Spark side."""

from __future__ import annotations

import re

from catalog.tables import AS_OF, LIST_HEADLINE, TEST_KEYWORDS
from newslab.constants import STOP_WORDS, THRESHOLDS
from newslab.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS

W = "PARTITION BY ticker ORDER BY date"
CUM = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def r(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns.split())


def r8(columns: str) -> str:
    return r(columns, 8)


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOPS = words(STOP_WORDS)
KEYWORDS = words(TEST_KEYWORDS)
UP, DOWN = words(POSITIVE_WORDS), words(NEGATIVE_WORDS)


def kw(text: str) -> str:
    """Keywords as a list; the order of first use is not needed for overlap."""
    return (f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
            f"lambda t: length(t) > 1 AND NOT list_contains({STOPS}, t)))")


def polarity(text: str) -> str:
    toks = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    up = f"len(list_filter({toks}, lambda t: list_contains({UP}, t)))"
    down = f"len(list_filter({toks}, lambda t: list_contains({DOWN}, t)))"
    return f"coalesce(({up} - {down})::DOUBLE / nullif({up} + {down}, 0), 0.0)"


CTES: dict[str, str] = {
    "headlines_raw": """
        SELECT p_type AS ticker,
               lower(concat(o_orderpriority, ' ', p_name, ' ', l_returnflag, l_linestatus)) AS headline,
               CAST(o_orderdate AS DATE) AS date,
               (l_extendedprice % 1000) / 500 - 1 AS sentiment_score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "prices": """
        SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date,
               100 + 2 * (CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) - 4) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_type, CAST(l_shipdate AS DATE)""",
    "headline_index": """
        SELECT ticker, headline, min(date) AS date, avg(sentiment_score) AS sentiment_score
        FROM headlines_raw GROUP BY ticker, headline""",
    "universe": "SELECT DISTINCT p_type AS ticker FROM part",
    "daily": """
        SELECT ticker, date, avg(sentiment_score) AS daily_score, count(*) AS articles
        FROM headlines_raw GROUP BY ticker, date""",
    "first_day": "SELECT ticker, min(date) AS first_date FROM daily GROUP BY ticker",
    "traded": """
        SELECT p.ticker, p.date, p.close, d.daily_score AS day_score, d.articles
        FROM prices p JOIN first_day f ON f.ticker = p.ticker AND p.date >= f.first_date - 100
        LEFT JOIN daily d ON d.ticker = p.ticker AND d.date = p.date""",
    "base": f"""
        SELECT ticker, date, close, articles, close / lag(close) OVER ({W}) - 1 AS returns,
               last_value(day_score IGNORE NULLS) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS daily_score
        FROM traded""",
    "frame": f"""
        SELECT ticker, date, close, daily_score, articles, returns,
               CASE WHEN count(returns) OVER w20 = 20 THEN stddev_samp(returns) OVER w20 * sqrt(252) END AS volatility_20d,
               avg(daily_score) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smooth_sentiment,
               CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50
        FROM base
        WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
               w50 AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "sized": """
        SELECT *, CASE WHEN volatility_20d > 0 THEN least(0.4 / volatility_20d, 1) ELSE 0 END AS weight,
               CASE WHEN smooth_sentiment > 0 AND close > sma_50 THEN 1 ELSE 0 END AS signal
        FROM frame""",
    "held": f"SELECT *, coalesce(lag(signal * weight) OVER ({W}), 0) AS position FROM sized",
    "turned": f"""
        SELECT *, abs(position - coalesce(lag(position) OVER ({W}), 0)) AS turnover FROM held""",
    "earned": "SELECT *, position * returns - turnover * 0.0015 AS strategy_returns FROM turned",
    "bt": f"""
        SELECT *, 1000000 * product(1 + coalesce(strategy_returns, 0)) OVER ({CUM}) AS equity,
               1000000 * product(1 + coalesce(returns, 0)) OVER ({CUM}) AS buyhold_equity
        FROM earned""",
    "dd": f"""
        SELECT *, equity / max(equity) OVER ({CUM}) - 1 AS drawdown,
               buyhold_equity / max(buyhold_equity) OVER ({CUM}) - 1 AS bh_drawdown,
               CASE WHEN signal = 1 AND lag(signal) OVER ({W}) = 0 THEN 1 ELSE 0 END AS entry
        FROM bt""",
    "sums": """
        SELECT ticker, count(strategy_returns) AS n, count(returns) AS bh_n,
               arg_max(equity, date) / 1000000 - 1 AS total_return,
               arg_max(buyhold_equity, date) / 1000000 - 1 AS bh_total_return,
               avg(strategy_returns) AS m, stddev_samp(strategy_returns) AS sd,
               avg(returns) AS bh_m, stddev_samp(returns) AS bh_sd,
               min(drawdown) AS max_drawdown, min(bh_drawdown) AS bh_max_drawdown,
               sum(entry)::BIGINT AS n_trades,
               avg(CASE WHEN position > 0 THEN 1.0 ELSE 0.0 END) AS exposure,
               avg(CASE WHEN strategy_returns > 0 THEN 1.0 ELSE 0.0 END)
                 FILTER (WHERE position > 0 AND strategy_returns IS NOT NULL) AS daily_win_rate
        FROM dd GROUP BY ticker""",
    "stats": """
        SELECT ticker, total_return, bh_total_return, max_drawdown, bh_max_drawdown, n_trades,
               exposure, daily_win_rate,
               CASE WHEN total_return > -1 AND n > 0 THEN pow(1 + total_return, 252.0 / n) - 1 END AS cagr,
               CASE WHEN bh_total_return > -1 AND bh_n > 0 THEN pow(1 + bh_total_return, 252.0 / bh_n) - 1 END AS bh_cagr,
               sd * sqrt(252) AS volatility, bh_sd * sqrt(252) AS bh_volatility,
               CASE WHEN sd > 0 THEN m / sd * sqrt(252) END AS sharpe,
               CASE WHEN bh_sd > 0 THEN bh_m / bh_sd * sqrt(252) END AS bh_sharpe
        FROM sums""",
    # returns after dates
    "numbered": f"""
        SELECT ticker, date AS base_date, close,
               (lead(close, 1) OVER ({W}) - close) / close * 100 AS ret_1d,
               (lead(close, 5) OVER ({W}) - close) / close * 100 AS ret_5d,
               (lead(close, 10) OVER ({W}) - close) / close * 100 AS ret_10d
        FROM prices""",
    "event_dates": "SELECT DISTINCT ticker, date FROM headlines_raw",
    "based": """
        SELECT e.ticker, e.date, min(n.base_date) AS base_date
        FROM event_dates e JOIN numbered n
          ON n.ticker = e.ticker AND n.base_date >= e.date
        GROUP BY e.ticker, e.date""",
    "fwd": """
        SELECT b.ticker, b.date, b.base_date, n.ret_1d, n.ret_5d, n.ret_10d
        FROM based b JOIN numbered n ON n.ticker = b.ticker AND n.base_date = b.base_date""",
    # lexical matches of one keyword list in every ticker
    "overlap": f"""
        SELECT *, len(list_intersect(words, {KEYWORDS})) AS shared_count,
               len(list_distinct(words || {KEYWORDS})) AS union_count
        FROM (SELECT *, regexp_split_to_array(lower(headline), '[^a-z0-9]+') AS words FROM headline_index)""",
    "list_matches": """
        SELECT 1::BIGINT AS query_id, ticker, headline, date, sentiment_score, shared_count, jaccard, rank
        FROM (SELECT *, shared_count::DOUBLE / union_count AS jaccard,
                     row_number() OVER (PARTITION BY ticker ORDER BY shared_count DESC,
                       shared_count::DOUBLE / union_count DESC, date DESC, headline) AS rank
              FROM overlap WHERE shared_count >= 2)
        WHERE rank <= 20""",
    # many queries
    "queries": f"""
        SELECT *, {kw('headline')} AS kws FROM (
          SELECT min(p_partkey) AS query_id, p_type AS ticker,
                 'Urgent: ' || p_name || ' was NOT recalled' AS headline
          FROM part GROUP BY p_type, p_name)""",
    "listed": f"""
        SELECT 1::BIGINT AS query_id, ticker, '{LIST_HEADLINE}' AS headline,
               {kw("'" + LIST_HEADLINE + "'")} AS kws FROM universe""",
    # one headline per part name, worded up or down, for every ticker
    "named": f"""
        SELECT query_id, u.ticker, n.headline, {kw('n.headline')} AS kws, {polarity('n.headline')} AS live_score
        FROM (SELECT min(p_partkey) AS query_id, 'Urgent: ' || p_name || CASE WHEN contains(p_name, 'red')
                THEN ' profit gains but fear' ELSE ' beats on growth, weak loss, drop' END AS headline
              FROM part GROUP BY p_name) n CROSS JOIN universe u""",
}


def match_ctes(matches: str, queries: str) -> dict[str, str]:
    """The best 20 headlines of each query by shared words."""
    return {
        f"{matches}_all": f"""
            SELECT q.query_id, h.ticker, h.headline, h.date, h.sentiment_score,
                   len(list_intersect(h.words, q.kws)) AS shared_count,
                   len(list_intersect(h.words, q.kws))::DOUBLE
                     / greatest(len(list_distinct(h.words || q.kws)), 1) AS jaccard
            FROM overlap h JOIN {queries} q ON q.ticker = h.ticker""",
        matches: f"""
            SELECT * FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id, ticker
                       ORDER BY shared_count DESC, jaccard DESC, date DESC, headline) AS rank
              FROM {matches}_all WHERE shared_count >= 2)
            WHERE rank <= 20""",
    }


def verdict_ctes(matches: str, queries: str) -> dict[str, str]:
    """Weights, sums and verdict over a match table."""
    return {
        f"{matches}_w": f"""
            SELECT m.*, f.ret_1d, f.ret_5d, f.ret_10d,
                   exp(-ln(2) / 180 * greatest(date_diff('day', m.date, DATE '{AS_OF}'), 0)) AS weight
            FROM {matches} m LEFT JOIN fwd f ON f.ticker = m.ticker AND f.date = m.date""",
        f"{matches}_d": f"""
            SELECT query_id, ticker, date, max(weight) AS weight, max(ret_1d) AS ret_1d,
                   max(ret_5d) AS ret_5d, max(ret_10d) AS ret_10d
            FROM {matches}_w GROUP BY query_id, ticker, date""",
        f"{matches}_p": f"""
            SELECT query_id, ticker,
                   sum(weight * ret_1d) / sum(weight) FILTER (WHERE ret_1d IS NOT NULL) AS avg_1d,
                   sum(weight * ret_5d) / sum(weight) FILTER (WHERE ret_5d IS NOT NULL) AS avg_5d,
                   sum(weight * ret_10d) / sum(weight) FILTER (WHERE ret_10d IS NOT NULL) AS avg_10d
            FROM {matches}_d GROUP BY query_id, ticker""",
        f"{matches}_s": f"""
            SELECT query_id, ticker, count(*) AS n_matches,
                   sum(weight * sentiment_score) / sum(weight) AS avg_sentiment,
                   100.0 * count(*) FILTER (WHERE sentiment_score > 0.1) / count(*) AS pct_bullish,
                   100.0 * count(*) FILTER (WHERE sentiment_score < -0.1) / count(*) AS pct_bearish
            FROM {matches}_w GROUP BY query_id, ticker""",
        f"{matches}_c": f"""
            SELECT q.query_id, q.ticker, coalesce(s.n_matches, 0) AS n_matches,
                   coalesce(s.avg_sentiment, 0.0) AS avg_sentiment,
                   coalesce(s.pct_bullish, 0.0) AS pct_bullish,
                   coalesce(s.pct_bearish, 0.0) AS pct_bearish, p.avg_1d, p.avg_5d, p.avg_10d,
                   s.n_matches IS NOT NULL AS recency_weighted,
                   (p.avg_1d IS NOT NULL)::INT + (p.avg_5d IS NOT NULL)::INT + (p.avg_10d IS NOT NULL)::INT AS known,
                   coalesce(p.avg_1d, 0) + coalesce(p.avg_5d, 0) + coalesce(p.avg_10d, 0) AS total
            FROM {queries} q LEFT JOIN {matches}_s s ON s.query_id = q.query_id AND s.ticker = q.ticker
            LEFT JOIN {matches}_p p ON p.query_id = q.query_id AND p.ticker = q.ticker""",
        f"{matches}_v": f"""
            SELECT *, CASE WHEN composite > 10 THEN 'BULLISH' WHEN composite < -10 THEN 'BEARISH'
                           ELSE 'NEUTRAL' END AS verdict,
                   round_even(least(95, abs(composite)) * least(1, n_matches / 20.0), 0)::BIGINT AS confidence
            FROM (SELECT *, CASE WHEN known > 0
                      THEN 0.4 * 100 * greatest(-1, least(1, avg_sentiment))
                         + 0.6 * greatest(-100, least(100, total / known * 20))
                      ELSE 100 * greatest(-1, least(1, avg_sentiment)) END AS composite
                  FROM {matches}_c)""",
    }


for _matches, _queries in (("query_matches", "queries"), ("listed_matches", "listed"),
                           ("named_matches", "named")):
    CTES |= match_ctes(_matches, _queries) | verdict_ctes(_matches, _queries)
CTES |= verdict_ctes("list_matches", "listed")

Q = "PARTITION BY query_id, ticker ORDER BY date"
CTES |= {
    # trading each ticker at each headline's own score
    "q_sized": """
        SELECT n.query_id, n.live_score, z.*, CASE WHEN z.smooth_sentiment > n.live_score AND z.close > z.sma_50
                 THEN 1 ELSE 0 END AS q_signal
        FROM named n JOIN sized z ON z.ticker = n.ticker""",
    "q_held": f"SELECT *, coalesce(lag(q_signal * weight) OVER ({Q}), 0) AS q_position FROM q_sized",
    "q_earned": f"""
        SELECT *, q_position * returns - 0.0015 * abs(q_position - coalesce(lag(q_position) OVER ({Q}), 0)) AS sr,
               q_signal = 1 AND lag(q_signal) OVER ({Q}) = 0 AS q_entry
        FROM q_held""",
    "q_curve": f"""
        SELECT *, product(1 + coalesce(sr, 0)) OVER ({Q} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth
        FROM q_earned""",
    "q_dd": f"""
        SELECT *, growth / max(growth) OVER ({Q} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS down
        FROM q_curve""",
    "q_stats": """
        SELECT query_id, ticker, arg_max(growth, date) - 1 AS total_return, min(down) AS max_drawdown,
               CASE WHEN stddev_samp(sr) > 0 THEN avg(sr) / stddev_samp(sr) * sqrt(252) END AS sharpe,
               avg(CASE WHEN q_position > 0 THEN 1.0 ELSE 0.0 END) AS exposure,
               count(*) FILTER (WHERE q_entry) AS n_trades
        FROM q_dd GROUP BY query_id, ticker""",
    "q_marked": f"""
        SELECT z.query_id, z.ticker, z.date, n.ret_1d, n.ret_5d, n.ret_10d,
               CASE WHEN z.smooth_sentiment >= z.live_score AND z.close > z.sma_50 THEN 1 ELSE 0 END AS mark
        FROM q_sized z JOIN numbered n ON n.ticker = z.ticker AND n.base_date = z.date""",
    "q_entries": f"SELECT *, mark = 1 AND coalesce(lag(mark) OVER ({Q}), 0) = 0 AS is_entry FROM q_marked",
}

CTES |= {
    # thresholds and components
    "split": """
        SELECT ticker, CASE WHEN (row_number() OVER (ORDER BY ticker)) % 2 = 1 THEN 'train' ELSE 'test' END AS split
        FROM universe""",
    "usable": "SELECT ticker FROM frame GROUP BY ticker HAVING count(daily_score) > 250",
    "variants": "SELECT 'threshold' AS mode, unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS)
                + "]) AS threshold UNION ALL SELECT unnest(['trend', 'sentiment', 'combined']), 0.0",
    "var_sig": """
        SELECT v.mode, v.threshold, z.ticker, z.date, z.returns, z.weight,
               CASE WHEN (v.mode = 'trend' OR smooth_sentiment > v.threshold)
                     AND (v.mode = 'sentiment' OR close > sma_50) THEN 1 ELSE 0 END AS signal
        FROM sized z SEMI JOIN usable u ON u.ticker = z.ticker CROSS JOIN variants v""",
    "var_pos": """
        SELECT *, coalesce(lag(signal * weight) OVER (PARTITION BY mode, threshold, ticker ORDER BY date), 0) AS position
        FROM var_sig""",
    "var_ret": """
        SELECT *, position * returns - 0.0015 * abs(position - coalesce(
                 lag(position) OVER (PARTITION BY mode, threshold, ticker ORDER BY date), 0)) AS sr
        FROM var_pos""",
    "scores": """
        SELECT mode, threshold, ticker,
               CASE WHEN stddev_samp(sr) > 0 THEN avg(sr) / stddev_samp(sr) * sqrt(252) END AS sharpe,
               product(1 + coalesce(sr, 0)) - 1 AS total_return,
               CASE WHEN stddev_samp(returns) > 0 THEN avg(returns) / stddev_samp(returns) * sqrt(252) END AS bh_sharpe
        FROM var_ret GROUP BY mode, threshold, ticker""",
    "sweep": """
        SELECT split, threshold, avg(sharpe) AS mean_sharpe
        FROM scores JOIN split USING (ticker) WHERE mode = 'threshold' GROUP BY split, threshold""",
    "best": """
        SELECT split, threshold, mean_sharpe FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY coalesce(mean_sharpe, -1e9) DESC, threshold) AS n
          FROM sweep) WHERE n = 1""",
    "components": """
        SELECT mode, avg(sharpe) AS mean_sharpe FROM scores WHERE mode <> 'threshold' GROUP BY mode
        UNION ALL SELECT 'buyhold', avg(bh_sharpe) FROM scores WHERE mode = 'combined'""",
    # overlay at a fixed score
    "marked": f"""
        SELECT f.*, n.ret_1d, n.ret_5d, n.ret_10d,
               CASE WHEN smooth_sentiment >= 0.05 AND f.close > sma_50 THEN 1 ELSE 0 END AS headline_signal
        FROM frame f JOIN numbered n ON n.ticker = f.ticker AND n.base_date = f.date""",
    "overlay": f"""
        SELECT *, headline_signal = 1 AND coalesce(lag(headline_signal) OVER ({W}), 0) = 0 AS is_entry
        FROM marked""",
    "islands": f"""
        SELECT *, sum(CASE WHEN is_entry THEN 1 ELSE 0 END) OVER ({CUM})::BIGINT AS zone_id,
               lead(date) OVER ({W}) AS next_date
        FROM overlay""",
    "zones": """
        SELECT ticker, zone_id, min(date) AS start_date,
               coalesce(max(CASE WHEN is_last THEN next_date END), max(date)) AS end_date,
               max(CASE WHEN is_last THEN next_date END) IS NULL AS is_open
        FROM (SELECT *, date = max(date) OVER (PARTITION BY ticker, zone_id) AS is_last
              FROM islands WHERE headline_signal = 1)
        GROUP BY ticker, zone_id""",
    "trades": f"""
        SELECT ticker, date, CASE moved WHEN 1 THEN 'buy' ELSE 'sell' END AS action, close, smooth_sentiment
        FROM (SELECT *, (position > 0)::INT - coalesce(lag((position > 0)::INT) OVER ({W}), 0) AS moved FROM bt)
        WHERE moved <> 0""",
    # dashboard
    "dash_daily": """
        SELECT ticker, date, avg(sentiment_score) AS sentiment, count(sentiment_score) AS articles, count(*) AS n_rows
        FROM headlines_raw GROUP BY ticker, date""",
    "dash_last": "SELECT ticker, max(date) AS last_day, sum(n_rows)::BIGINT AS total_articles FROM dash_daily GROUP BY ticker",
    "dash_rows": """
        SELECT d.ticker, d.date, p.close, d.sentiment, d.articles, l.total_articles
        FROM dash_daily d JOIN dash_last l ON l.ticker = d.ticker
        JOIN prices p ON p.ticker = d.ticker AND p.date = d.date""",
    "dash_recent": """
        SELECT r.* FROM dash_rows r JOIN dash_last l ON l.ticker = r.ticker
        WHERE r.date >= l.last_day - INTERVAL 6 MONTH""",
    **{name: f"""
        SELECT *, CASE WHEN count(*) OVER (PARTITION BY ticker) >= 7
                    THEN avg(sentiment) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS sentiment_7d,
               CASE WHEN sentiment > 0 THEN 'positive' WHEN sentiment < 0 THEN 'negative' ELSE 'flat' END AS bar
        FROM {rows}""" for name, rows in (("dash", "dash_recent"), ("dash_whole", "dash_rows"))},
    # vectors
    "vectors": """
        SELECT vec_id AS query_id, label::VARCHAR AS ticker, 'vec ' || vec_id AS headline,
               DATE '2000-01-01' + (vec_id % 365)::INT AS date,
               (vec_id % 200) / 100.0 - 1 AS sentiment_score, embedding::DOUBLE[] AS v
        FROM embeddings""",
    "cosines": """
        SELECT q.query_id, c.ticker, c.headline, c.date, c.sentiment_score,
               round(list_dot_product(c.v, q.v), 12) AS similarity
        FROM vectors c JOIN vectors q ON q.ticker = c.ticker""",
    "close_vectors": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ticker
            ORDER BY similarity DESC, date DESC, headline) AS rank
          FROM cosines WHERE similarity >= 0.2)
        WHERE rank <= 5""",
    "index_newest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker
            ORDER BY date DESC, md5(headline), headline) AS age FROM headline_index)
        WHERE age <= 700""",
}


def with_ctes(sql: str) -> str:
    """Put the CTEs that a text needs in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
