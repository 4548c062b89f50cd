"""Nothing is left out silently: old headlines, early days, second rows of a day."""

import datetime as dt

import pytest

from newslab.operators.daily import dashboard_sentiment, merge_days
from newslab.operators.search import search, semantic_search


def test_semantic_search_reads_more_than_the_newest(spark):
    n = 200_005
    corpus = spark.range(n).selectExpr(
        "'A' AS ticker", "concat('h', id) AS headline", "date_add(DATE '2000-01-01', int(id % 5000)) AS date",
        "0.0D AS sentiment_score",
        "IF(id = 0, array(1.0F, 0.0F), array(0.0F, 1.0F)) AS embedding")
    asked = spark.sql("SELECT 1L AS query_id, 'A' AS ticker, array(1.0F, 0.0F) AS embedding")
    assert [r.headline for r in semantic_search(corpus, asked, top_n=5).collect()] == ["h0"]


def test_early_days_stay_unless_a_bound_is_given(spark):
    rows = spark.createDataFrame([("A", "h", dt.date(1990, 1, 2), 0.5)], "ticker string, headline string, date date, sentiment_score double")
    assert dashboard_sentiment(rows).count() == 1
    assert dashboard_sentiment(rows, "2000-01-01").count() == 0


def test_two_closes_on_a_day_are_an_error(spark):
    day = dt.date(2020, 1, 2)
    prices = spark.createDataFrame([("A", day, 10.0), ("A", day, 12.0)], "ticker string, date date, close double")
    daily = spark.createDataFrame([("A", day, 0.1)], "ticker string, date date, daily_score double")
    with pytest.raises(Exception, match="two rows of one table"):
        merge_days(prices, daily).collect()
    assert merge_days(prices.limit(1), daily).count() == 1


def test_only_a_missing_model_changes_the_method(spark):
    def broken(queries):
        raise KeyError("a mistake in the caller's code")

    queries = spark.sql("SELECT 1L AS query_id, 'A' AS ticker, 'red blue' AS headline")
    with pytest.raises(KeyError):
        search(queries, queries, "auto", corpus=queries, embed=broken)
