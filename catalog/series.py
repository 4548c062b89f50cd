"""Windows, sorts, sets and scalar functions."""

from pyspark.sql import Window, functions as F

from catalog.oracle import KEYWORDS, kw, r, r8
from catalog.registry import query, rounded, tidy
from catalog.tables import TEST_KEYWORDS, Tables
from newslab.functions import dates, numbers, text, vectors
from newslab.operators import daily as D
from newslab.operators import dashboard as B
from newslab.operators import events
from newslab.operators import newest
from newslab.operators import overlay as O
from newslab.operators import search as S
from newslab.operators import strategy as ST
from newslab.operators import validate as V
from newslab.session import settle
from newslab.sources import headlines as H


def _frame_column(name: str, column: str, places: int = 6):
    @query(name, f"SELECT ticker, date, {r(column, places)} FROM frame")
    def build(t: Tables):
        return t.frame.select("ticker", "date", rounded(column, places))


def _backtest_columns(name: str, columns: str, places: int = 6):
    @query(name, f"SELECT ticker, date, {r(columns, places)} FROM bt")
    def build(t: Tables):
        return t.backtest.select("ticker", "date", *[rounded(c, places) for c in columns.split()])


_frame_column("w1_daily_return", "returns", 8)
_frame_column("w2_rolling_volatility", "volatility_20d")
_frame_column("w3_smooth_sentiment", "smooth_sentiment", 8)
_frame_column("w4_moving_average", "sma_50")
_frame_column("w6_limited_fill", "daily_score", 8)
_backtest_columns("w7_lagged_position", "position", 8)
_backtest_columns("w8_turnover", "turnover", 8)
_backtest_columns("w9_equity", "equity buyhold_equity", 4)


@query("w5_seven_row_line", f"SELECT ticker, date, {r8('sentiment_7d')} FROM dash_whole")
def w5(t: Tables):
    return tidy(B.dashboard_series(t.raw, t.prices), "ticker", "date", r8="sentiment_7d")


@query("w10_drawdown", f"SELECT ticker, date, {r('drawdown bh_drawdown')} FROM dd")
def w10(t: Tables):
    rows = t.backtest.select(
        "ticker", "date", ST.drawdown("equity").alias("drawdown"),
        ST.drawdown("buyhold_equity").alias("bh_drawdown"),
    )
    return tidy(rows, "ticker", "date", r="drawdown bh_drawdown")


@query("w11_forward_returns", f"SELECT ticker, base_date AS date, {r('ret_1d ret_5d ret_10d')} FROM numbered")
def w11(t: Tables):
    return tidy(events.price_forward_returns(t.prices), "ticker", "date", r="ret_1d ret_5d ret_10d")


@query("w12_trade_entries", "SELECT ticker, date FROM dd WHERE entry = 1")
def w12(t: Tables):
    rows = t.backtest.select("ticker", "date", ST.entries().alias("entry"))
    return rows.filter("entry").select("ticker", "date")


@query("w13_overlay_entries", "SELECT ticker, date FROM overlay WHERE is_entry")
def w13(t: Tables):
    return O.with_overlay(t.frame, 0.05).filter("is_entry").select("ticker", "date")


@query("w14_trade_markers", f"SELECT ticker, date, action, {r('close')}, {r8('smooth_sentiment')} FROM trades")
def w14(t: Tables):
    return tidy(O.trades(t.backtest), "ticker", "date", "action", r="close", r8="smooth_sentiment")


@query("w15_zones", "SELECT ticker, zone_id, start_date, end_date, is_open FROM zones")
def w15(t: Tables):
    return O.zones(O.with_overlay(t.frame, 0.05))


@query("w16_last_rows_mean", """
    SELECT ticker, round(avg(sentiment), 8) + 0.0 AS avg_30 FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM dash_whole)
    WHERE n <= 30 GROUP BY ticker""")
def w16(t: Tables):
    return tidy(B.last_rows_mean(B.dashboard_series(t.raw, t.prices)), "ticker", r8="avg_30")


@query("w17_alternating_split", "SELECT ticker, split FROM split")
def w17(t: Tables):
    return V.alternating_split(t.universe)


@query("w18_match_rank", "SELECT query_id, ticker, rank, headline FROM query_matches")
def w18(t: Tables):
    return S.lexical_search(t.index, t.queries).select("query_id", "ticker", "rank", "headline")


# --- sorts, top-k, sets ---------------------------------------------------------------


@query("k1_lexical_topk", f"""
    SELECT headline, date, shared_count, round(shared_count::DOUBLE / union_count, 6) + 0.0 AS jaccard
    FROM overlap WHERE ticker = 'MEDIUM' AND shared_count >= 2
    ORDER BY shared_count DESC, shared_count::DOUBLE / union_count DESC, date DESC, headline LIMIT 20""")
def k1(t: Tables):
    found = S.search_one(t.index, "medium", keywords=TEST_KEYWORDS)
    return tidy(found, "headline", "date", "shared_count", r="jaccard")


@query("k2_semantic_topk", f"SELECT query_id, ticker, rank, headline, {r('similarity')} FROM close_vectors")
def k2(t: Tables):
    found = S.semantic_search(t.vectors, t.vectors, top_n=5, min_similarity=0.2)
    return tidy(found, "query_id", "ticker", "rank", "headline", r="similarity")


@query("k3_newest_cap", "SELECT ticker, headline, date FROM index_newest")
def k3(t: Tables):
    return newest.newest_per_ticker(t.index, 700).select("ticker", "headline", "date")


def _placed(ordered, *keys: str):
    """The rows with ``in_order``: whether each comes after the row before it, in its partition or, for the first
    one of a partition, after the last row of the partitions before. Equal keys pass."""
    key = F.struct(*keys)
    rows = settle(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
                  "placed")
    inside = F.lag(key).over(Window.partitionBy("_part").orderBy("_at"))
    ends = rows.groupBy("_part").agg(F.max(key).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", F.max("_last").over(earlier).alias("_before"))
    return rows.withColumn("_previous", inside).join(F.broadcast(before), "_part").withColumn(
        "in_order", F.coalesce(key >= F.coalesce("_previous", "_before"), F.lit(True))
    ).drop("_part", "_at", "_previous", "_before")


@query("k4_date_order", f"""
    SELECT ticker, date, round(daily_score, 8) + 0.0 AS daily_score, articles, true AS in_order
    FROM daily ORDER BY ticker, date""")
def k4(t: Tables):
    rows = _placed(D.daily_sentiment(t.raw).orderBy("ticker", "date"), "ticker", "date")
    return tidy(rows, "ticker", "date", "articles", "in_order", r8="daily_score")


@query("k5_ticker_order", "SELECT ticker, headline, date, true AS in_order FROM headline_index")
def k5(t: Tables):
    """Rows are in order within a range, and no range begins before the end of an earlier one."""
    rows = _placed(H.cluster_by_ticker(t.index), "ticker", "date", "headline")
    return rows.select("ticker", "headline", "date", "in_order")


@query("k6_highest_row", f"SELECT split, threshold FROM best")
def k6(t: Tables):
    frame = V.universe_frames(t.raw, t.prices, t.universe)
    scores = V.variant_scores(frame, V.threshold_variants())
    sweep = V.mean_sharpe(scores, V.alternating_split(t.universe))
    return V.best_threshold(sweep).select("split", "threshold")


def _word_sets(t: Tables):
    wanted = F.array(*[F.lit(k) for k in TEST_KEYWORDS])
    return text.stored_words(F.col("headline")), wanted


@query("u1_word_intersection", f"""
    SELECT ticker, headline, list_aggregate(list_sort(list_intersect(words, {KEYWORDS})), 'string_agg', ' ') AS shared
    FROM overlap WHERE shared_count > 0""")
def u1(t: Tables):
    both = text.shared_words(*_word_sets(t))
    return t.index.filter(F.size(both) > 0).select(
        "ticker", "headline", F.array_join(F.sort_array(both), " ").alias("shared")
    )


@query("u2_word_union", f"""
    SELECT ticker, headline, list_aggregate(list_sort(list_distinct(words || {KEYWORDS})), 'string_agg', ' ') AS words
    FROM overlap""")
def u2(t: Tables):
    union = text.all_words(*_word_sets(t))
    return t.index.select("ticker", "headline", F.array_join(F.sort_array(union), " ").alias("words"))


@query("u3_disjoint_split", """
    SELECT ticker, (split = 'train')::INT::BIGINT AS in_train, (split = 'test')::INT::BIGINT AS in_test FROM split""")
def u3(t: Tables):
    """How often each ticker of the universe stands on each side."""
    split = V.alternating_split(t.universe)
    sides = split.groupBy("ticker").pivot("split", ["train", "test"]).count()
    return t.universe.join(sides, "ticker", "left").select(
        "ticker", F.coalesce("train", F.lit(0)).alias("in_train"), F.coalesce("test", F.lit(0)).alias("in_test"))


# --- scalar functions --------------------------------------------------------------------


@query("x1_stored_words", """
    SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: x = '')) AS n_empty, md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents)""")
def x1(t: Tables):
    w = text.stored_words(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: x == "")).cast("long").alias("n_empty"),
        F.md5(F.array_join(w, " ")).alias("digest"),
    )


@query("x2_tokens", """
    SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)""")
def x2(t: Tables):
    w = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"),
                              F.md5(F.array_join(w, " ")).alias("digest"))


@query("x3_keywords", f"""
    SELECT doc_id, len(k) AS n, md5(array_to_string(list_sort(k), ' ')) AS digest, k[1] IS NULL AS is_empty
    FROM (SELECT doc_id, {kw('text')} AS k FROM documents)""")
def x3(t: Tables):
    k = text.keywords(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(k).cast("long").alias("n"),
        F.md5(F.array_join(F.sort_array(k), " ")).alias("digest"), (F.size(k) == 0).alias("is_empty"),
    )


@query("x4_shared_count", "SELECT ticker, headline, shared_count FROM overlap")
def x4(t: Tables):
    return t.index.select("ticker", "headline", text.shared_count(*_word_sets(t)).alias("shared_count"))


@query("x5_jaccard", "SELECT ticker, headline, round(shared_count::DOUBLE / union_count, 6) + 0.0 AS jaccard FROM overlap")
def x5(t: Tables):
    rows = t.index.withColumn("jaccard", text.jaccard(*_word_sets(t)))
    return tidy(rows, "ticker", "headline", r="jaccard")


@query("x6_cosine", f"""
    SELECT query_id AS vec_id, first_id, round(list_dot_product(v, p), 6) + 0.0 AS similarity FROM (
      SELECT query_id, v, first_value(v) OVER w AS p, first_value(query_id) OVER w AS first_id FROM vectors
      WINDOW w AS (PARTITION BY ticker ORDER BY query_id))""")
def x6(t: Tables):
    """Each vector with its ticker's first one, as the search works it out."""
    first = t.vectors.groupBy("ticker").agg(
        F.min("query_id").alias("query_id"), F.min_by("embedding", "query_id").alias("embedding"))
    pairs = S.similar_pairs(t.vectors, first, top_n=None, min_similarity=-2.0)
    vec_id = F.substring_index("headline", " ", -1).cast("long").alias("vec_id")
    return tidy(pairs.select(vec_id, F.col("query_id").alias("first_id"), "similarity"), "vec_id", "first_id", r="similarity")


@query("x7_unit_vectors", """
    SELECT vec_id, pos, round(x, 6) + 0.0 AS x FROM (
      SELECT vec_id, unnest(generate_series(1, len(u))) AS pos, unnest(u) AS x FROM (
        SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM (
          SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 2)) AS w FROM embeddings)))""")
def x7(t: Tables):
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 2))
    rows = t.read("embeddings").select(
        "vec_id", F.posexplode(vectors.unit(longer)).alias("pos", "x")
    ).withColumn("pos", (F.col("pos") + 1).cast("long"))
    return tidy(rows, "vec_id", "pos", r="x")


@query("x8_recency_weight", """
    SELECT ticker, date, round(exp(-ln(2) / 180 * greatest(date_diff('day', date, DATE '2000-06-30'), 0)), 8) + 0.0 AS weight
    FROM daily""")
def x8(t: Tables):
    rows = D.daily_sentiment(t.raw).withColumn(
        "weight", numbers.recency_weight(F.col("date"), dates.as_date("2000-06-30"))
    )
    return tidy(rows, "ticker", "date", r8="weight")


@query("x9_clamp", """
    SELECT event_id, greatest(-1, least(1, round(value - 10, 6))) + 0.0 AS unit_range, least(95, value * 3) + 0.0 AS capped
    FROM events""")
def x9(t: Tables):
    value = F.col("value")
    return t.read("events").select(
        "event_id", (numbers.clamp(F.round(value - 10, 6), -1.0, 1.0) + 0.0).alias("unit_range"),
        (numbers.clamp(value * 3, None, 95.0) + 0.0).alias("capped"),
    )


@query("x10_half_even", """
    SELECT part.p_partkey, round_even(p_size / 2.0, 0)::BIGINT AS half FROM part""")
def x10(t: Tables):
    return t.read("part").select("p_partkey", numbers.half_even(F.col("p_size") / 2.0).alias("half"))


@query("x11_sizing_weight", f"SELECT ticker, date, {r('weight', 8)} FROM sized")
def x11(t: Tables):
    rows = t.frame.withColumn("weight", numbers.sizing_weight(F.col("volatility_20d")))
    return tidy(rows, "ticker", "date", r8="weight")


@query("x12_net_return", f"SELECT ticker, date, {r8('strategy_returns')} FROM earned")
def x12(t: Tables):
    return tidy(t.backtest, "ticker", "date", r8="strategy_returns")


@query("x13_calendar_day", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def x13(t: Tables):
    return t.read("events").select("event_id", dates.day(F.col("ts")).alias("date"))


@query("x14_date_text", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS written, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def x14(t: Tables):
    written = dates.format_day(F.col("o_orderdate"))
    return t.read("orders").select(
        "o_orderkey", written.alias("written"), dates.parse_day(written).alias("parsed")
    )


@query("x15_display_text", r"""
    SELECT doc_id, md5(trim(replace(replace(text, chr(10), ' '), chr(13), ' '))) AS digest FROM documents""")
def x15(t: Tables):
    return t.documents.select("doc_id", F.md5(text.display_text(F.col("text"))).alias("digest"))


@query("x16_ticker_list", """
    SELECT p_partkey, unnest([upper(x) FOR x IN [trim(p_type), trim(p_name)] IF x <> '']) AS ticker FROM part""")
def x16(t: Tables):
    typed = F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ,, "), "p_name", F.lit(",  "))
    return t.read("part").select("p_partkey", F.explode(text.ticker_list(typed)).alias("ticker"))


@query("x18_score_delta", """
    SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) + 0.0 AS delta FROM events""")
def x18(t: Tables):
    means = t.read("events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    rows = t.read("events").join(means, "event_type").withColumn(
        "delta", numbers.score_delta(F.col("value"), F.col("mean"))
    )
    return tidy(rows, "event_id", r="delta")


@query("x19_polarity", """
    SELECT vec_id, round((exp(a) - exp(b)) / (exp(a) + exp(b) + exp(c)), 6) + 0.0 AS score
    FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)""")
def x19(t: Tables):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = t.read("embeddings").withColumn("score", numbers.polarity(logits))
    return tidy(rows, "vec_id", r="score")
