"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F

from catalog.oracle import kw, r, r8
from catalog.registry import query, rounded, tidy
from catalog.tables import TEST_KEYWORDS, Tables
from newslab import constants as C
from newslab.functions import dates, numbers
from newslab.operators import daily as D
from newslab.operators import overlay as O
from newslab.operators import search as S
from newslab.sources import embeddings as E
from newslab.sources import headlines as H
from newslab.sources import prices as P

EVENT_COLUMNS = {"ticker": "event_type", "headline": "props", "date": "ts",
                 "sentiment_score": "value"}


@query("s1_scan_raw", """
    SELECT event_type AS ticker, props AS headline, CAST(ts AS DATE) AS date, value AS sentiment_score
    FROM events""")
def s1(t: Tables):
    return H.scan_headlines(t.spark, t.path("events"), EVENT_COLUMNS)


def _built_index(t: Tables) -> str:
    path = t.scratch("index")
    H.write_index(t.index, path)
    return path


@query("s2_scan_index", f"SELECT ticker, headline, date, {r8('sentiment_score')} FROM headline_index WHERE ticker = 'PROMO'")
def s2(t: Tables):
    found = H.for_ticker(H.scan_headlines(t.spark, _built_index(t)), " promo ")
    return tidy(found, "ticker", "headline", "date", r8="sentiment_score")


@query("s3_load_headlines", f"SELECT ticker, headline, date, {r8('sentiment_score')} FROM headline_index")
def s3(t: Tables):
    raw = t.scratch("raw")
    t.raw.write.parquet(raw)
    found = H.load_headlines(t.spark, t.scratch("no-index"), raw)
    return tidy(found, "ticker", "headline", "date", r8="sentiment_score")


@query("s5_scan_prices", f"""
    SELECT ticker, date, {r('close')} FROM prices
    WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'""")
def s5(t: Tables):
    path = t.scratch("prices")
    t.prices.withColumnRenamed("close", "adjusted").write.csv(path, header=True)
    found = P.scan_prices(t.spark, path, "csv", {"close": "adjusted"}, "1998-01-01",
                          "1999-12-31", header=True,
                          schema="ticker string, date date, adjusted double")
    return tidy(found, "ticker", "date", r="close")


@query("s6_index_sink", f"SELECT ticker, headline, date, {r8('sentiment_score')} FROM headline_index")
def s6(t: Tables):
    found = H.scan_headlines(t.spark, _built_index(t))
    return tidy(found, "ticker", "headline", "date", r8="sentiment_score")


@query("s7_guarded_overwrite", f"""
    SELECT ticker, count(*) AS n, TRUE AS refused FROM headline_index GROUP BY ticker""")
def s7(t: Tables):
    """A second build without ``overwrite`` is refused and leaves the index as it was; with
    ``overwrite`` it replaces it."""
    path, refused = _built_index(t), False
    try:
        H.write_index(t.index.limit(0), path)
    except FileExistsError:
        refused = True
    H.write_index(H.scan_headlines(t.spark, path), other := t.scratch("index"))
    H.write_index(H.scan_headlines(t.spark, path), other, overwrite=True)
    counts = H.scan_headlines(t.spark, other).groupBy("ticker").agg(F.count("*").alias("n"))
    return counts.withColumn("refused", F.lit(refused))


def _stored_vectors(t: Tables) -> str:
    path = t.scratch("vectors")
    rows = t.vectors.drop("query_id").withColumn("model", F.lit("given")).join(
        E.source_versions(t.vectors), "ticker"
    )
    E.write_embeddings(rows, path)
    return path


@query("s8_embedding_sink", f"""
    SELECT ticker, headline, date, {r8('sentiment_score')}, len(v) AS dim,
           round(list_sum(v), 6) + 0.0 AS total FROM vectors""")
def s8(t: Tables):
    found = E.read_embeddings(t.spark, _stored_vectors(t), "given")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tidy(
        found.withColumn("dim", F.size("embedding").cast("long")).withColumn("total", total),
        "ticker", "headline", "date", "dim", r="total", r8="sentiment_score",
    )


@query("s9_stale_tickers", """
    SELECT DISTINCT ticker FROM vectors WHERE sentiment_score > 0.98""")
def s9(t: Tables):
    """After scores above 0.98 were revised, only the tickers that have one are stale."""
    revised = t.vectors.withColumn("sentiment_score", F.least("sentiment_score", F.lit(0.98)))
    return E.stale_tickers(revised, _stored_vectors(t), "given").select("ticker")


@query("s10_missing_source", """
    SELECT ticker, count(m.headline) AS n_rows FROM (SELECT ticker FROM universe UNION ALL SELECT 'NONE') u
    LEFT JOIN query_matches m USING (ticker) GROUP BY ticker""")
def s10(t: Tables):
    """An absent table is an error; an unknown ticker among known ones has no rows, and they keep theirs."""
    try:
        H.load_headlines(t.spark, t.scratch("absent"), t.scratch("absent"))
        raise AssertionError("an absent table must be reported")
    except FileNotFoundError:
        pass
    unknown = t.queries.select("query_id", F.lit("NONE").alias("ticker"), "headline")
    found = S.lexical_search(t.index, t.queries.unionByName(unknown)).groupBy("ticker").agg(F.count("*").alias("n"))
    asked = t.universe.unionByName(t.spark.range(1).select(F.lit("NONE").alias("ticker")))
    return asked.join(found, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n_rows"))


# --- filters --------------------------------------------------------------------


@query("f1_ticker", "SELECT ticker, headline, count(*) AS n FROM headlines_raw WHERE ticker = 'STANDARD' GROUP BY ALL")
def f1(t: Tables):
    return H.for_ticker(t.raw, "  standard ").groupBy("ticker", "headline").agg(
        F.count("*").alias("n")
    )


@query("f2_date_bounds", """
    SELECT event_type AS ticker, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY event_type""")
def f2(t: Tables):
    found = dates.within(t.events, "2024-01-05", "2024-01-20")
    return found.groupBy("ticker").agg(
        F.count("*").alias("n"), F.countDistinct(dates.day(F.col("date"))).alias("days")
    )


@query("f3_lookback_code", """
    SELECT ticker, count(*) AS n, min(date) AS first_date FROM headlines_raw
    WHERE date BETWEEN DATE '2001-06-30' - 365 AND DATE '2001-06-30' GROUP BY ticker""")
def f3(t: Tables):
    low, high = dates.resolve_window("1Y", since="1996-01-01", as_of="2001-06-30")
    return dates.within(t.raw, low, high).groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date")
    )


@query("f4_from_last_day", f"""
    SELECT d.ticker, d.date, {r8('daily_score')} FROM daily d
    JOIN (SELECT ticker, max(date) AS last_day FROM daily GROUP BY ticker) l ON l.ticker = d.ticker
    WHERE d.date >= l.last_day - INTERVAL 3 MONTH""")
def f4(t: Tables):
    return tidy(dates.from_last_day(D.daily_sentiment(t.raw), "3m"), "ticker", "date",
                r8="daily_score")


@query("f5_min_overlap", "SELECT ticker, headline, shared_count FROM overlap WHERE shared_count >= 2")
def f5(t: Tables):
    wanted = F.array(*[F.lit(k) for k in TEST_KEYWORDS])
    return S.score_overlap(t.index, wanted).select("ticker", "headline", "shared_count")


@query("f6_similarity_floor", """
    SELECT query_id, headline FROM (
      SELECT q.query_id, c.headline, list_dot_product(c.v, q.v) AS sim
      FROM vectors c JOIN vectors q ON q.ticker = c.ticker) WHERE sim >= 0.3""")
def f6(t: Tables):
    return S.similar_pairs(t.vectors, t.vectors, top_n=None, min_similarity=0.3).select(
        "query_id", "headline"
    )


@query("f7_date_floor", """
    SELECT ticker, date, articles, n_rows::BIGINT AS n_rows FROM dash_daily
    WHERE date >= DATE '2000-01-01'""")
def f7(t: Tables):
    return D.dashboard_sentiment(t.raw, C.DASHBOARD_FLOOR).select("ticker", "date", "articles", "n_rows")


@query("f8_class_predicates", """
    SELECT ticker, count(*) FILTER (WHERE sentiment_score > 0.1) AS bullish,
           count(*) FILTER (WHERE sentiment_score < -0.1) AS bearish FROM headlines_raw GROUP BY ticker""")
def f8(t: Tables):
    label = numbers.sign_class(F.col("sentiment_score"), C.CLASS_CUT)
    return t.raw.groupBy("ticker").agg(
        F.count(F.when(label == "positive", 1)).alias("bullish"),
        F.count(F.when(label == "negative", 1)).alias("bearish"),
    )


@query("f9_drop_null_sentiment", f"""
    SELECT p.ticker, p.date, {r('close')}, {r8('daily_score')} FROM prices p
    LEFT JOIN daily d ON d.ticker = p.ticker AND d.date = p.date WHERE daily_score IS NOT NULL""")
def f9(t: Tables):
    rows = D.prices_with_sentiment(t.prices, D.daily_sentiment(t.raw))
    return tidy(rows.dropna(subset=["daily_score"]), "ticker", "date", r="close", r8="daily_score")


@query("f10_drop_null_returns", """
    SELECT ticker, count(returns) AS n, round(avg(returns), 8) + 0.0 AS mean_return
    FROM base GROUP BY ticker""")
def f10(t: Tables):
    return t.frame.filter(F.col("returns").isNotNull()).groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg("returns").alias("mean_return")
    ).select("ticker", "n", rounded("mean_return", 8))


@query("f11_active_days", f"SELECT ticker, date, {r('position', 8)} FROM held WHERE position > 0")
def f11(t: Tables):
    return tidy(t.backtest.filter(F.col("position") > 0), "ticker", "date", r8="position")


@query("f12_usable_tickers", """
    SELECT ticker, count(*) AS n FROM frame SEMI JOIN usable USING (ticker) GROUP BY ticker""")
def f12(t: Tables):
    return D.usable_tickers(t.frame).groupBy("ticker").agg(F.count("*").alias("n"))


@query("f13_universe", """
    SELECT ticker, headline, date FROM headline_index WHERE ticker IN ('PROMO', 'LARGE', 'SMALL')""")
def f13(t: Tables):
    return H.for_universe(t.index, ["promo", "LARGE ", "SMALL"]).select("ticker", "headline", "date")


@query("f14_query_checks", f"""
    SELECT conv_id, turn, CASE WHEN length(trim(text)) < 5 THEN 'headline too short'
             WHEN len({kw('trim(text)')}) < 2 THEN 'too few keywords' END AS reject_reason
    FROM conversations""")
def f14(t: Tables):
    asked = t.read("conversations").select(
        "conv_id", "turn", F.lit("x").alias("ticker"), F.col("text").alias("headline")
    )
    return S.check_queries(asked, "lexical").select("conv_id", "turn", "reject_reason")


@query("f15_zone_rows", f"SELECT ticker, date, {r('close')} FROM overlay WHERE headline_signal = 1")
def f15(t: Tables):
    return tidy(O.zone_days(O.with_overlay(t.frame, 0.05)), "ticker", "date", r="close")


@query("f16_project_rename", f"SELECT ticker, date, {r('close')} FROM prices")
def f16(t: Tables):
    named = t.prices.select(F.col("ticker").alias("Symbol"), F.col("date").alias("Date"),
                            F.col("close").alias("Close"))
    found = P.as_prices(named, {"ticker": "Symbol", "date": "Date", "close": "Close"})
    return tidy(found, "ticker", "date", r="close")


@query("f17_labels", """
    SELECT ticker, headline, date,
           CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'flat' END AS class_5,
           CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'flat' END AS class_10,
           CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'flat' END AS class_0,
           CASE WHEN s * 50 > 10 THEN 'BULLISH' WHEN s * 50 < -10 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict
    FROM (SELECT ticker, headline, date, round(sentiment_score, 8) AS s FROM headlines_raw)""")
def f17(t: Tables):
    s = F.round("sentiment_score", 8)
    return t.raw.select(
        "ticker", "headline", "date",
        numbers.sign_class(s, 0.05).alias("class_5"), numbers.sign_class(s, 0.1).alias("class_10"),
        numbers.sign_class(s).alias("class_0"), numbers.verdict_label(s * 50).alias("verdict"),
    )


@query("f18_lead_in", f"SELECT ticker, date, {r('close')} FROM traded")
def f18(t: Tables):
    rows = D.prices_with_sentiment(t.prices, D.daily_sentiment(t.raw), lead_days=C.LEAD_DAYS)
    return tidy(rows, "ticker", "date", r="close")
