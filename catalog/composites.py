"""Whole analyses, and the two model jobs."""

from pyspark.sql import functions as F

from catalog.oracle import polarity, r, r8
from catalog.registry import query, tidy
from catalog.relations import (
    AVGS, METRICS, RETS, VERDICT, VERDICT_PLAIN, all_returns, verdict_table,
)
from catalog.tables import AS_OF, TICKERS, Tables
from newslab.functions import text
from newslab.functions.vectors import norm
from newslab.operators import overlay as O
from newslab.operators import scoring
from newslab.operators import search as S
from newslab.operators import strategy as ST
from newslab.operators import text_network
from newslab.operators import validate as V
from newslab.plans import analysis as A
from newslab.plans.dashboard import dashboard
from newslab.plans.index import build_index
from newslab.plans.semantic import search_with_refresh
from newslab.plans.validation import out_of_sample, threshold_sweep
from newslab.session import settle
from newslab.sources import embeddings as E

MATCH = "query_id, ticker, rank, headline, date"


@query("c1_verdict", f"SELECT {VERDICT_PLAIN}, {r(VERDICT)} FROM query_matches_v")
def c1(t: Tables):
    return verdict_table(t, t.queries, S.lexical_search(t.index, t.queries))


@query("c2_build_index", """
    SELECT count(*) AS n_rows, count(DISTINCT ticker) AS tickers, min(date) AS min_date, max(date) AS max_date
    FROM headline_index""")
def c2(t: Tables):
    raw = t.scratch("raw")
    t.raw.write.parquet(raw)
    return build_index(t.spark, raw, t.scratch("index"))


@query("c3_lexical_search", f"SELECT {MATCH}, shared_count, {r('jaccard')}, {r8('sentiment_score')} FROM query_matches")
def c3(t: Tables):
    found = S.lexical_search(t.index, t.queries)
    return tidy(found, *MATCH.split(", "), "shared_count", r="jaccard", r8="sentiment_score")


@query("c4_semantic_search", f"SELECT {MATCH}, {r('similarity')}, {r8('sentiment_score')} FROM close_vectors")
def c4(t: Tables):
    found = S.semantic_search(t.vectors, t.vectors, top_n=5, min_similarity=0.2)
    return tidy(found, *MATCH.split(", "), r="similarity", r8="sentiment_score")


@query("c5_search_method", f"""
    SELECT 'semantic' AS method, query_id, ticker, rank, headline FROM close_vectors
    UNION ALL SELECT 'lexical', query_id, ticker, rank, headline FROM query_matches""")
def c5(t: Tables):
    """``auto`` takes vectors where it has them and words where it has none."""
    vectors = S.search(t.vectors, t.index, "auto", corpus=t.vectors, embed=lambda q: q, top_n=5,
                       min_similarity=0.2)
    words = S.search(t.queries, t.index, "auto")
    columns = ["method", "query_id", "ticker", "rank", "headline"]
    return vectors.select(*columns).unionByName(words.select(*columns))


def remainder_model():
    """A stand-in embedder of texts that end in a number: its remainders, as a vector."""
    def vectors(texts):
        numbers = [int(x.rsplit(" ", 1)[-1]) for x in texts]
        return [[n % 7 + 1, n % 11 + 1, n % 13 + 1, n % 17 + 1] for n in numbers]

    return vectors


@query("c5_search_with_refresh", """
    WITH raw AS (
      SELECT vec_id, label::VARCHAR AS ticker, 'vec ' || vec_id AS headline,
             DATE '2000-01-01' + (vec_id % 365)::INT AS date,
             [vec_id % 7 + 1, vec_id % 11 + 1, vec_id % 13 + 1, vec_id % 17 + 1]::DOUBLE[] AS w FROM embeddings),
    units AS (
      SELECT *, list_transform(w, lambda x: (x / sqrt(list_dot_product(w, w)))::FLOAT::DOUBLE) AS u FROM raw),
    scored AS (
      SELECT q.vec_id AS query_id, c.ticker, c.headline, c.date, round(list_dot_product(c.u, q.u), 12) AS similarity
      FROM units c JOIN units q USING (ticker))
    SELECT 'semantic' AS method, query_id, ticker, rank, headline FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, ticker ORDER BY similarity DESC, date DESC, headline) AS rank
      FROM scored WHERE similarity >= 0.9) WHERE rank <= 5""")
def c5_refresh(t: Tables):
    """One ticker is asked for first and is the only one embedded; the others follow when they are asked for."""
    path, loader = t.scratch("vectors"), _by_value(remainder_model)
    rows = t.vectors.select("ticker", "headline", "date", "sentiment_score")
    asked = t.vectors.select("query_id", "ticker", "headline")
    bounds = {"top_n": 5, "min_similarity": 0.9}
    first = asked.join(asked.agg(F.min("ticker").alias("ticker")), "ticker")
    search_with_refresh(first, rows, path, "remainders", loader, **bounds)
    assert E.read_embeddings(t.spark, path, "remainders").select("ticker").distinct().count() == 1
    found = search_with_refresh(asked, rows, path, "remainders", loader, **bounds)
    return found.select("method", "query_id", "ticker", "rank", "headline")


@query("c6_forward_returns", f"SELECT ticker, date, base_date, {r(RETS)} FROM fwd")
def c6(t: Tables):
    return tidy(all_returns(t), "ticker", "date", "base_date", r=RETS)


FRAME = "close returns volatility_20d sma_50"


@query("c7_strategy_frame", f"SELECT ticker, date, articles, {r(FRAME)}, {r8('daily_score smooth_sentiment')} FROM frame")
def c7(t: Tables):
    return tidy(t.frame, "ticker", "date", "articles", r=FRAME, r8="daily_score smooth_sentiment")


@query("c8_signal", "SELECT ticker, date, signal FROM sized")
def c8(t: Tables):
    return ST.apply_signal(t.frame).select("ticker", "date", "signal")


BACKTEST = "position turnover strategy_returns"


@query("c9_backtest", f"SELECT ticker, date, signal, {r8(BACKTEST)}, {r('equity buyhold_equity', 4)} FROM bt")
def c9(t: Tables):
    return t.backtest.select(
        "ticker", "date", "signal",
        *[(F.round(c, 8) + 0.0).alias(c) for c in BACKTEST.split()],
        *[(F.round(c, 4) + 0.0).alias(c) for c in ("equity", "buyhold_equity")],
    )


@query("c10_metrics", f"SELECT ticker, n_trades, {r(METRICS)} FROM stats")
def c10(t: Tables):
    return tidy(ST.metrics(t.backtest), "ticker", "n_trades", r=METRICS)


@query("c11_overlay", f"""
    SELECT ticker, date, headline_signal, is_entry, {r(RETS)} FROM overlay""")
def c11(t: Tables):
    overlay = O.with_overlay(O.with_price_returns(t.frame), 0.05)
    return tidy(overlay, "ticker", "date", "headline_signal", "is_entry", r=RETS)


CHART = "close sma_50"


@query("c12_chart_series", f"""
    SELECT ticker, date, {r(CHART)}, {r('equity buyhold_equity')}, {r8('smooth_sentiment')},
           round(greatest(coalesce(smooth_sentiment, 0), 0), 8) + 0.0 AS positive_sentiment,
           round(least(coalesce(smooth_sentiment, 0), 0), 8) + 0.0 AS negative_sentiment
    FROM bt""".replace(r('equity buyhold_equity'), r('equity buyhold_equity', 4)))
def c12(t: Tables):
    rows = O.chart_series(t.backtest)
    signs = "smooth_sentiment positive_sentiment negative_sentiment"
    return tidy(
        rows.withColumns({c: F.round(c, 4) for c in ("equity", "buyhold_equity")}),
        "ticker", "date", "equity", "buyhold_equity", r=CHART, r8=signs,
    )


@query("c12_trade_log", f"SELECT ticker, date, action, {r('close')} FROM trades")
def c12_log(t: Tables):
    return tidy(O.trades(t.backtest), "ticker", "date", "action", r="close")


def _analysis(t: Tables) -> A.Analysis:
    return A.analyze(t.queries, t.index, t.prices, method="lexical", as_of=AS_OF)


@query("c13_analyze", f"SELECT {VERDICT_PLAIN}, {r(VERDICT)} FROM query_matches_v")
def c13(t: Tables):
    return tidy(_analysis(t).verdicts, *VERDICT_PLAIN.split(", "), r=VERDICT)


@query("c14_compare", f"""
    SELECT query_id, ticker, verdict, confidence, n_matches, {r(AVGS)}, {r8('avg_sentiment live_score')},
           CASE WHEN avg_sentiment > 0.05 THEN 'positive' WHEN avg_sentiment < -0.05 THEN 'negative' ELSE 'flat' END AS sentiment_class,
           round(live_score - avg_sentiment, 8) + 0.0 AS score_delta
    FROM named_matches_v JOIN named USING (query_id, ticker)""")
def c14(t: Tables):
    tickers = text.ticker_list(F.lit(TICKERS))
    result = A.compare(t.named_queries, tickers, t.index, t.prices, method="lexical", as_of=AS_OF)
    return tidy(result.comparison, "query_id", "ticker", "verdict", "confidence", "n_matches",
                "sentiment_class", r=AVGS, r8="avg_sentiment live_score score_delta")


def _unified(t: Tables) -> A.SignalBacktest:
    asked = S.for_tickers(t.named_queries, text.ticker_list(F.lit(TICKERS)))
    return A.unified(asked, t.index, t.prices, daily_source=t.raw, method="lexical", as_of=AS_OF)


UNIFIED = "total_return max_drawdown sharpe exposure"


@query("c15_unified_flow", f"SELECT query_id, ticker, n_trades, {r(UNIFIED)} FROM q_stats")
def c15(t: Tables):
    return tidy(_unified(t).metrics, "query_id", "ticker", "n_trades", r=UNIFIED)


@query("c15_unified_overlay", """
    SELECT query_id, ticker, count(*) FILTER (WHERE is_entry) AS num_signals,
           round(avg(ret_1d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_1d,
           round(avg(ret_5d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_5d,
           round(avg(ret_10d) FILTER (WHERE is_entry), 6) + 0.0 AS avg_10d
    FROM q_entries GROUP BY query_id, ticker""")
def c15_overlay(t: Tables):
    return tidy(_unified(t).overlay_summary, "query_id", "ticker", "num_signals", r=AVGS)


@query("c16_sharpe_at", f"SELECT ticker, threshold, {r('sharpe total_return')} FROM scores WHERE mode = 'threshold' AND threshold = 0.1")
def c16(t: Tables):
    return tidy(V.sharpe_at(V.universe_frames(t.raw, t.prices), 0.1), "ticker", "threshold",
                r="sharpe total_return")


@query("c17_threshold_sweep", f"""
    SELECT s.split, s.threshold, {r('s.mean_sharpe').replace('AS s.', 'AS ')}, s.threshold = b.threshold AS is_best
    FROM sweep s JOIN best b ON b.split = s.split""")
def c17(t: Tables):
    sweep = threshold_sweep(t.raw, t.prices, t.universe)
    return tidy(sweep, "split", "threshold", "is_best", r="mean_sharpe")


@query("c18_component_modes", f"SELECT ticker, mode, {r('sharpe bh_sharpe')} FROM scores WHERE mode <> 'threshold'")
def c18(t: Tables):
    frame = V.universe_frames(t.raw, t.prices, t.universe)
    return tidy(V.variant_scores(frame, V.mode_variants()), "ticker", "mode", r="sharpe bh_sharpe")


@query("c19_decomposition", f"SELECT mode, {r('mean_sharpe')} FROM components")
def c19(t: Tables):
    frame = V.universe_frames(t.raw, t.prices, t.universe)
    return tidy(V.decomposition(V.variant_scores(frame, V.mode_variants())), "mode", r="mean_sharpe")


@query("c20_out_of_sample", """
    SELECT tr.threshold AS train_threshold, te.threshold AS test_threshold,
           round(s.mean_sharpe, 6) + 0.0 AS test_at_train, round(te.mean_sharpe, 6) + 0.0 AS test_optimum,
           round(te.mean_sharpe - s.mean_sharpe, 6) + 0.0 AS gap,
           CASE WHEN tr.threshold = te.threshold THEN 'agree'
                WHEN te.mean_sharpe - s.mean_sharpe < 0.10 THEN 'robust' ELSE 'curve-fit' END AS label
    FROM best tr JOIN best te ON tr.split = 'train' AND te.split = 'test'
    JOIN sweep s ON s.split = 'test' AND s.threshold = tr.threshold""")
def c20(t: Tables):
    report = out_of_sample(t.raw, t.prices, t.universe).generalisation
    return tidy(report, "train_threshold", "test_threshold", "label",
                r="test_at_train test_optimum gap")


@query("c20_test_tickers", f"""
    SELECT s.ticker, s.threshold, {r('sharpe total_return')} FROM scores s
    JOIN best b ON b.split = 'train' AND b.threshold = s.threshold
    JOIN split p ON p.ticker = s.ticker AND p.split = 'test' WHERE s.mode = 'threshold'""")
def c20_tickers(t: Tables):
    report = out_of_sample(t.raw, t.prices, t.universe).test_tickers
    return tidy(report, "ticker", "threshold", r="sharpe total_return")


@query("c20_edge", f"""
    SELECT {r('trend sentiment combined buyhold')},
           CASE WHEN sentiment < 0.10 AND combined < trend THEN 'no edge' ELSE 'contributes' END AS edge
    FROM (SELECT max(mean_sharpe) FILTER (WHERE mode = 'trend') AS trend,
                 max(mean_sharpe) FILTER (WHERE mode = 'sentiment') AS sentiment,
                 max(mean_sharpe) FILTER (WHERE mode = 'combined') AS combined,
                 max(mean_sharpe) FILTER (WHERE mode = 'buyhold') AS buyhold FROM components)""")
def c20_edge(t: Tables):
    return tidy(out_of_sample(t.raw, t.prices, t.universe).edge, "edge",
                r="trend sentiment combined buyhold")


@query("c21_dashboard", f"""
    SELECT ticker, date, articles, total_articles, bar, {r('close')}, {r8('sentiment sentiment_7d')} FROM dash""")
def c21(t: Tables):
    series, _ = dashboard(t.raw, t.prices, "6m")
    return tidy(series, "ticker", "date", "articles", "total_articles", "bar", r="close",
                r8="sentiment sentiment_7d")


@query("c22_report_rows", f"""
    SELECT query_id, ticker, rank, strftime(date, '%Y-%m-%d') AS date, trim(headline) AS headline,
           CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'flat' END AS sentiment_class,
           {r(RETS)}, {r8('sentiment_score')}
    FROM query_matches_w""")
def c22(t: Tables):
    return tidy(_analysis(t).report, "query_id", "ticker", "rank", "date", "headline",
                "sentiment_class", r=RETS, r8="sentiment_score")


@query("c23_backtest_all", f"SELECT ticker, n_trades, {r(METRICS)} FROM stats")
def c23(t: Tables):
    _, metrics = A.backtest_all(t.raw, t.prices)
    return tidy(metrics, "ticker", "n_trades", r=METRICS)


@query("c24_universe_frames", f"""
    SELECT ticker, date, {r('close sma_50')}, {r8('smooth_sentiment')} FROM frame SEMI JOIN usable USING (ticker)""")
def c24(t: Tables):
    frame = V.universe_frames(t.raw, t.prices, t.universe)
    return tidy(frame, "ticker", "date", r="close sma_50", r8="smooth_sentiment")


# --- models --------------------------------------------------------------------------


@query("p1_word_scores", f"SELECT doc_id, round({polarity('text')}, 6) + 0.0 AS score FROM documents")
def p1(t: Tables):
    scored = scoring.score_text(t.documents, text="text", output="score")
    return tidy(scored, "doc_id", r="score")


def _label_sides(t: Tables, scored):
    known = scored.select("doc_id", "live_score").join(
        t.read("labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    means = known.groupBy("label").agg(F.avg("live_score").alias("mean")).filter(F.col("label").isNotNull())
    return known.join(means, "label", "left").select(
        "doc_id", F.col("live_score").between(-1, 1).alias("inside"),
        F.coalesce(F.col("label"), F.lit(-1)).cast("long").alias("label"),
        F.coalesce((F.col("mean") > 0) == (F.col("label") == 1), F.lit(True)).alias("apart"),
    )


@query("p1_trained_scorer", """
    SELECT doc_id, true AS inside, coalesce(quality, -1)::BIGINT AS label, true AS apart
    FROM documents LEFT JOIN labels USING (doc_id)""")
def p1_trained(t: Tables):
    """Trained on the labelled documents, applied to all of them: each score lies in [-1, 1], and the mean score
    of a label's documents lies on the label's side of zero (label -1: none)."""
    labelled = t.documents.join(t.read("labels"), "doc_id").select(
        "text", F.col("quality").alias("label")
    )
    scorer = scoring.fit_scorer(labelled)
    return _label_sides(t, scoring.score_with(scorer, t.documents.select("doc_id", "text")))


@query("p1_network_scores", """
    SELECT doc_id, true AS inside, coalesce(quality, -1)::BIGINT AS label, true AS apart
    FROM documents LEFT JOIN labels USING (doc_id)""")
def p1_network(t: Tables):
    """As above, by the network."""
    labelled = t.documents.join(t.read("labels"), "doc_id").select("text", F.col("quality").alias("label"))
    network = text_network.fit_network(labelled)
    return _label_sides(t, text_network.score_with_network(network, t.documents.select("doc_id", "text"), "text"))


def letter_model():
    """A stand-in classifier: logits from counts of three letters."""
    def logits(texts):
        return [[x.count("a") / len(x), x.count("e") / len(x), x.count("o") / len(x)] for x in texts]

    return logits


@query("p1_model_scores", """
    SELECT doc_id, round((exp(a) - exp(e)) / (exp(a) + exp(e) + exp(o)), 6) + 0.0 AS live_score FROM (
      SELECT doc_id, (length(text) - length(replace(text, 'a', '')))::DOUBLE / length(text) AS a,
             (length(text) - length(replace(text, 'e', '')))::DOUBLE / length(text) AS e,
             (length(text) - length(replace(text, 'o', '')))::DOUBLE / length(text) AS o FROM documents)""")
def p1_model(t: Tables):
    return tidy(scoring.score_text(t.documents, _by_value(letter_model), "text"), "doc_id", r="live_score")


def _by_value(load):
    """Ship the stand-in model with the job, as an interactive user's function would be."""
    from pyspark import cloudpickle
    import catalog.composites as module

    cloudpickle.register_pickle_by_value(module)
    return load


@query("p2_embed_headlines", """
    SELECT ticker, headline, 256::BIGINT AS dim, 1.0::DOUBLE AS length FROM headline_index""")
def p2(t: Tables):
    rows = scoring.embed_text(t.index).withColumn("length", norm(F.col("embedding")))
    rows = rows.withColumn("dim", F.size("embedding").cast("long"))
    return tidy(rows, "ticker", "headline", "dim", r="length")


@query("p2_model_vectors", """
    SELECT ticker, headline, round(a / n, 5) + 0.0 AS a, round(e / n, 5) + 0.0 AS e, round(o / n, 5) + 0.0 AS o FROM (
      SELECT *, CASE WHEN a + e + o = 0 THEN 1 ELSE sqrt(a * a + e * e + o * o) END AS n FROM (
        SELECT ticker, headline, length(headline) - length(replace(headline, 'a', '')) AS a,
               length(headline) - length(replace(headline, 'e', '')) AS e,
               length(headline) - length(replace(headline, 'o', '')) AS o FROM headline_index))""")
def p2_model(t: Tables):
    """The values of the unit vectors that a plugged-in model gives."""
    rows = scoring.embed_text(t.index, _by_value(letter_model))
    return rows.select("ticker", "headline", *[
        (F.round(F.get("embedding", F.lit(i)).cast("double"), 5) + F.lit(0.0)).alias(c) for i, c in enumerate("aeo")])


@query("p3_refresh_embeddings", f"SELECT ticker, headline, date, {r8('sentiment_score')} FROM headline_index")
def p3(t: Tables):
    """A first refresh embeds every ticker, a second finds nothing stale. The index is stored first: each
    step reads it, and none joins the raw tables again."""
    path = t.scratch("vectors")
    index = settle(t.index, "index")
    E.refresh_embeddings(index, path, "words")
    assert E.stale_tickers(index, path, "words").isEmpty()
    return tidy(E.refresh_embeddings(index, path, "words"), "ticker", "headline", "date",
                r8="sentiment_score")
