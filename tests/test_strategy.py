"""Hand-made frames for the edges of the strategy chain."""

import pytest
from pyspark.sql import functions as F

from newslab.functions import numbers
from newslab.operators import daily, overlay, strategy, validate


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("date").select(*columns).collect()]


def test_fill_is_limited_to_five_rows(spark, day):
    data = [("A", day(1), 1.0)] + [("A", day(n), None) for n in range(2, 9)]
    df = spark.createDataFrame(data, "ticker string, date date, daily_score double")
    filled = rows(strategy.fill_sentiment(df), "daily_score")
    assert filled == [(1.0,)] * 6 + [(None,)] * 2


def test_first_volatility_is_on_row_21(spark, day):
    data = [("A", day(n), 100.0 + n % 3, 1, 0.1) for n in range(1, 23)]
    df = spark.createDataFrame(data, "ticker string, date date, close double, articles long, daily_score double")
    found = [v for (v,) in rows(strategy.with_indicators(df), "volatility_20d")]
    assert found[:20] == [None] * 20 and found[20] is not None


def test_moving_average_needs_fifty_rows(spark, day):
    data = [("A", day(n), float(n), None, None) for n in range(1, 52)]
    df = spark.createDataFrame(data, "ticker string, date date, close double, articles long, daily_score double")
    found = [v for (v,) in rows(strategy.with_indicators(df), "sma_50")]
    assert found[:49] == [None] * 49 and found[49:] == [25.5, 26.5]


def test_sizing_weight(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.2,), (0.8,)], "v double")
    found = [r[0] for r in df.select(numbers.sizing_weight(F.col("v"))).collect()]
    assert found == [0.0, 0.0, 1.0, 0.5]


def signals(spark, day, values, **columns):
    data = [("A", day(n + 1), v, 100.0) for n, v in enumerate(values)]
    return spark.createDataFrame(data, "ticker string, date date, signal int, close double")


def test_first_row_entry(spark, day):
    df = signals(spark, day, [1, 0, 1])
    trades = df.select("date", strategy.entries().alias("entry"))
    assert [e for (e,) in rows(trades, "entry")] == [None, False, True]
    frame = df.withColumns({"smooth_sentiment": F.col("signal").cast("double"), "sma_50": F.lit(1.0)})
    assert [e for (e,) in rows(overlay.with_overlay(frame, 0.5), "is_entry")] == [True, False, True]


def test_zones(spark, day):
    df = signals(spark, day, [0, 1, 1, 0, 1])
    found = overlay.zones(df, "signal").orderBy("zone_id").collect()
    assert [tuple(r) for r in found] == [
        ("A", 1, day(2), day(4), False), ("A", 2, day(5), day(5), True),
    ]


def test_trades_open_on_first_row(spark, day):
    data = [("A", day(n), p, 1.0, 0.0) for n, p in ((1, 0.5), (2, 0.4), (3, 0.0), (4, 0.0), (5, 1.0))]
    df = spark.createDataFrame(data, "ticker string, date date, position double, close double, smooth_sentiment double")
    assert rows(overlay.trades(df), "date", "action") == [
        (day(1), "buy"), (day(3), "sell"), (day(5), "buy"),
    ]


def backtest_input(spark, day, closes, signal=1, volatility=0.2):
    data = [("A", day(n + 1), c, signal, volatility) for n, c in enumerate(closes)]
    df = spark.createDataFrame(data, "ticker string, date date, close double, signal int, volatility_20d double")
    return df.withColumn("returns", F.col("close") / F.lag("close").over(daily.by_day()) - 1)


def test_position_lags_one_day_and_costs_are_paid_once(spark, day):
    found = rows(strategy.run_backtest(backtest_input(spark, day, [100.0, 110.0, 99.0])),
                 "position", "turnover", "strategy_returns", "equity", "buyhold_equity")
    assert [f[:2] for f in found] == [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)]
    assert found[0][2] is None and found[0][3] == 1e6
    assert found[1][2] == pytest.approx(0.1 - 0.0015)
    assert found[2][4] == pytest.approx(990_000.0)


def test_no_look_ahead(spark, day):
    closes = [100.0, 101.0, 99.0, 104.0, 103.0]
    a = rows(strategy.run_backtest(backtest_input(spark, day, closes)), "position")
    b = rows(strategy.run_backtest(backtest_input(spark, day, closes[:-1] + [9.0])), "position")
    assert a == b


def test_total_loss_has_no_growth_rate(spark, day):
    df = strategy.run_backtest(backtest_input(spark, day, [100.0, 50.0, 0.0]))
    found = strategy.metrics(df).collect()[0]
    assert found["bh_total_return"] == -1.0 and found["bh_cagr"] is None
    assert found["bh_max_drawdown"] == -1.0


def test_metrics_of_a_flat_price(spark, day):
    found = strategy.metrics(strategy.run_backtest(backtest_input(spark, day, [5.0] * 4, signal=0))).collect()[0]
    assert found["sharpe"] is None and found["daily_win_rate"] is None
    assert (found["n_trades"], found["exposure"], found["total_return"]) == (0, 0.0, 0.0)


def test_single_row_ticker(spark, day):
    found = strategy.metrics(strategy.run_backtest(backtest_input(spark, day, [5.0]))).collect()[0]
    assert found["total_return"] is None and found["volatility"] is None


@pytest.fixture(scope="module")
def frame(spark, day):
    data = [(t, day(n), 100.0 + (n * k) % 17 - n * 0.01, 1, ((n * k) % 11) / 10 - 0.5)
            for k, t in enumerate("ABC", 3) for n in range(1, 121)]
    df = spark.createDataFrame(data, "ticker string, date date, close double, articles long, daily_score double")
    return strategy.with_indicators(df)


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.1])
def test_window_free_variants_equal_the_backtest(frame, threshold):
    variant = {r["ticker"]: r for r in validate.sharpe_at(frame, threshold).collect()}
    full = strategy.metrics(strategy.run_backtest(strategy.apply_signal(frame, threshold))).collect()
    for row in full:
        assert variant[row["ticker"]]["sharpe"] == pytest.approx(row["sharpe"])
        assert variant[row["ticker"]]["total_return"] == pytest.approx(row["total_return"])


def test_best_threshold_takes_the_lowest_of_equals(spark):
    sweep = spark.createDataFrame(
        [("train", 0.1, 0.5), ("train", -0.1, 0.5), ("train", 0.3, None), ("test", 0.2, None), ("test", 0.1, None)],
        "split string, threshold double, mean_sharpe double")
    best = {r["split"]: tuple(r)[1:] for r in validate.best_threshold(sweep).collect()}
    assert best == {"train": (-0.1, 0.5), "test": (0.1, None)}
    flagged = validate.mark_best(sweep).filter("is_best").collect()
    assert {(r["split"], r["threshold"]) for r in flagged} == {("train", -0.1), ("test", 0.1)}


def test_generalisation_labels(spark):
    def label(test_pick, test_at_train):
        sweep = spark.createDataFrame(
            [("train", 0.1, 0.9), ("test", 0.1, test_at_train), ("test", 0.2, 0.5)],
            "split string, threshold double, mean_sharpe double")
        best = spark.createDataFrame([("train", 0.1, 0.9), ("test", test_pick, 0.5)],
                                     "split string, threshold double, mean_sharpe double")
        return validate.generalisation(sweep, best).collect()[0]["label"]

    assert label(0.1, 0.5) == "agree"
    assert label(0.2, 0.45) == "robust"
    assert label(0.2, 0.1) == "curve-fit"


def test_split_alternates_over_the_sorted_universe(spark):
    names = ["TSLA", "T", "AMD", "AAPL", "AMZN", "V", "BA", "BABA", "C"]
    df = spark.createDataFrame([(n,) for n in names], "ticker string")
    split = {r["ticker"]: r["split"] for r in validate.alternating_split(df).collect()}
    assert {t for t, s in split.items() if s == "train"} == set(sorted(names)[0::2])


def test_alignment_drops_days_without_trading_and_keeps_the_lead_in(spark, day):
    prices = spark.createDataFrame([(t, day(n), 1.0) for t in "AB" for n in (1, 2, 5, 6)],
                                   "ticker string, date date, close double")
    sentiment = spark.createDataFrame([("A", day(4), 0.5, 2), ("A", day(6), None, 1)],
                                      "ticker string, date date, daily_score double, articles long")
    left = rows(daily.prices_with_sentiment(prices, sentiment, lead_days=2), "ticker", "date", "articles")
    assert left == [("A", day(2), None), ("A", day(5), None), ("A", day(6), 1)]
    assert daily.prices_with_sentiment(prices, sentiment).count() == 8
    assert daily.prices_with_sentiment(prices, sentiment, how="inner").count() == 0
