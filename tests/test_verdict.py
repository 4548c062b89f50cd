import datetime as dt

import pytest
from pyspark.sql import functions as F

from newslab.functions import dates, numbers, text
from newslab.operators import events, verdict

MATCH = "query_id long, ticker string, date date, sentiment_score double"
RETURNS = "ticker string, date date, ret_1d double, ret_5d double, ret_10d double"
TODAY = dt.date(2020, 6, 30)


def judge(spark, matches, returns=(), queries=None):
    asked = None if queries is None else spark.createDataFrame(queries, "query_id long, ticker string")
    found = verdict.verdicts(spark.createDataFrame(list(matches), MATCH),
                             spark.createDataFrame(list(returns), RETURNS), asked, TODAY)
    return {r["ticker"]: r.asDict() for r in found.collect()}


def test_without_matches(spark):
    found = judge(spark, [], queries=[(1, "A")])["A"]
    assert (found["verdict"], found["confidence"], found["n_matches"]) == ("NEUTRAL", 0, 0)
    assert found["avg_sentiment"] == 0.0 and found["avg_1d"] is None
    assert found["recency_weighted"] is False


def test_without_prices(spark):
    found = judge(spark, [(1, "A", TODAY, 0.5)] * 20)["A"]
    assert (found["verdict"], found["confidence"]) == ("BULLISH", 50)


def test_one_date_counts_once_for_prices(spark):
    old = TODAY - dt.timedelta(days=180)
    found = judge(spark, [(1, "A", TODAY, 0.0), (1, "A", TODAY, 0.0), (1, "A", old, 0.0)],
                  [("A", TODAY, 3.0, None, None), ("A", old, 0.0, None, None)])["A"]
    assert found["avg_1d"] == pytest.approx(2.0)          # weights 1 and one half
    assert found["avg_5d"] is None
    assert found["verdict"] == "BULLISH" and found["confidence"] == round(0.6 * 40 * 3 / 20)


def test_without_dates_the_mean_is_plain(spark):
    found = judge(spark, [(1, "A", None, 0.4), (1, "A", None, -0.2), (1, "A", None, None)])["A"]
    assert found["avg_sentiment"] == pytest.approx(0.1)
    assert found["pct_bullish"] == pytest.approx(100 / 3) and found["recency_weighted"] is False


@pytest.mark.parametrize("score, label", [(0.1, "NEUTRAL"), (0.11, "BULLISH"), (-0.1, "NEUTRAL"), (-0.2, "BEARISH")])
def test_label_bounds_are_strict(spark, score, label):
    assert judge(spark, [(1, "A", TODAY, score)])["A"]["verdict"] == label


def test_confidence_rounds_half_to_even(spark):
    df = spark.createDataFrame([(25.0, 2), (35.0, 2), (-500.0, 40)], "c double, n int")
    found = [r[0] for r in df.select(verdict.confidence(F.col("c"), F.col("n"))).collect()]
    assert found == [2, 4, 95]


def test_clamp_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(numbers.clamp(F.col("x"), -1.0, 1.0)).collect()] == [None, 1.0, -1.0]


def test_as_of_join(spark, day):
    prices = spark.createDataFrame([("A", day(n), 100.0 + n) for n in (1, 4, 5)],
                                   "ticker string, date date, close double")
    asked = spark.createDataFrame([("A", day(n)) for n in (1, 2, 5, 6)] + [("B", day(1))],
                                  "ticker string, date date")
    found = {r["date"]: r for r in events.forward_returns(asked, prices).collect()}
    assert set(found) == {day(1), day(2), day(5)}
    assert found[day(2)]["base_date"] == day(4)
    assert found[day(2)]["ret_1d"] == pytest.approx(100 / 104)
    assert found[day(5)]["ret_1d"] is None and found[day(1)]["ret_5d"] is None


@pytest.mark.parametrize("headline, expected", [
    ("Apple beats Apple estimates", ["apple", "beats", "estimates"]),
    ("the of and is", []),
    ("A b c 7 x9", ["x9"]),
    ("Café déjà-vu", ["caf", "vu"]),
    ("", []),
    ("U.S. Q3 profit: up 12%", ["q3", "profit", "12"]),
])
def test_keywords(spark, headline, expected):
    df = spark.createDataFrame([(headline,)], "h string")
    found = df.select(text.keywords(F.col("h"))).collect()[0][0]
    assert found == expected


def test_look_back_codes():
    with pytest.raises(ValueError):
        dates.resolve_window("2w")


def test_bounds_of_a_code(spark):
    low, high = dates.resolve_window("1m", until="2020-03-01", as_of="2020-03-31")
    found = spark.range(1).select(low, high).collect()[0]
    assert tuple(found) == (dt.date(2020, 3, 1), dt.date(2020, 3, 1))


def test_month_end_look_back(spark):
    start = dates.lookback_start(F.lit("2020-03-31").cast("date"), "1m")
    assert spark.range(1).select(start).collect()[0][0] == dt.date(2020, 2, 29)
