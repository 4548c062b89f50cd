"""Versions of the index, pruned reads, and plans that share their steps."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from catalog.tables import Tables
from newslab.operators import search, validate
from newslab.plans import analysis as A
from newslab.session import new_table_path
from newslab.sources import headlines as H
from newslab.sources import manifest as M

D1 = dt.date(2020, 1, 1)
SCHEMA = "ticker string, headline string, date date, sentiment_score double"


def rows(spark, n, mark="old"):
    return spark.createDataFrame([(f"T{i % 40}", f"{mark} oil news {i}", D1 + dt.timedelta(days=i % 9), 0.1) for i in range(n)], SCHEMA)


def test_a_reader_sees_one_whole_version(spark):
    path = new_table_path(spark, "index")
    H.write_index(rows(spark, 200), path)
    reader = H.scan_headlines(spark, path)  # planned before, run after the overwrite
    H.write_index(rows(spark, 100, "new"), path, overwrite=True)
    assert reader.filter("headline like 'old%'").count() == 200
    assert H.scan_headlines(spark, path).filter("headline like 'new%'").count() == 100
    H.write_index(rows(spark, 50, "newest"), path, overwrite=True)
    assert [v.number for v in M.versions(spark, path)] == [1, 2]  # the first and its folder are gone
    assert H.scan_headlines(spark, path).count() == 50


def test_half_written_versions_are_not_read(spark):
    path = new_table_path(spark, "index")
    rows(spark, 10).write.parquet(f"{path}/{M.new_folder()}")
    assert M.current(spark, path) is None
    H.write_index(rows(spark, 20), path)
    assert H.scan_headlines(spark, path).count() == 20


def test_of_two_writers_one_is_told(spark):
    path = new_table_path(spark, "index")
    H.write_index(rows(spark, 10), path)
    before = M.current(spark, path)
    M.publish(spark, path, before.folder, before)
    with pytest.raises(FileExistsError):
        M.publish(spark, path, M.new_folder(), before)
    assert M.current(spark, path).number == 1


@pytest.fixture(scope="module")
def index(spark):
    path = new_table_path(spark, "index")
    H.write_index(rows(spark, 4000), path)
    return H.scan_headlines(spark, path)


def test_a_constant_ticker_prunes_folders(index, plan):
    one = H.for_ticker(index, " t7 ")
    text = plan(one)
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", text) and "EqualTo(ticker,T7)" in text
    assert one.count() == 100 and one.select("ticker").distinct().count() == 1


def test_asked_tickers_prune_folders_while_the_search_runs(spark, index, plan):
    asked = spark.createDataFrame([(1, "t7", "old oil news today"), (2, "T9", "news on old oil")], "query_id long, ticker string, headline string")
    found = search.lexical_search(index, asked, top_n=150)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", text)
    plain = search.lexical_search(index.drop("bucket"), asked, top_n=150)
    assert "dynamicpruning" not in plan(plain)
    key = lambda r: (r.query_id, r.rank)
    assert sorted(found.collect(), key=key) == sorted(plain.collect(), key=key) and found.count() == 200


def test_prices_before_the_first_match_are_not_read_on(spark):
    matches = spark.createDataFrame([("A", D1 + dt.timedelta(days=3)), ("A", None), ("B", None)], "ticker string, date date")
    prices = spark.createDataFrame([(t, D1 + dt.timedelta(days=i), 1.0) for t in "ABC" for i in range(6)], "ticker string, date date, close double")
    found = A.prices_from(prices, matches).collect()
    assert {r.ticker for r in found} == {"A"} and min(r.date for r in found) == D1 + dt.timedelta(days=3)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_backtests_run_once_per_ticker_and_score_without_a_search(tables, monkeypatch):
    monkeypatch.setattr(A, "search", lambda *a, **b: pytest.fail("nobody asked for matches"))
    ran = []
    join = A.join_many_to_series
    monkeypatch.setattr(A, "join_many_to_series", lambda many, series, on: ran.append(many) or join(many, series, on))
    asked = tables.queries.union(tables.queries.withColumn("query_id", F.col("query_id") + 100_000))
    result = A.unified(asked, tables.index, tables.prices, daily_source=tables.raw, method="lexical")
    metrics = result.metrics.collect()
    levels = ran[0].collect()
    assert len(levels) == len({(r.ticker, r.live_score) for r in levels}) < len(metrics) / 2
    assert len(metrics) == len({(r.query_id, r.ticker) for r in metrics})
    by_level = {}
    for r in metrics:
        by_level.setdefault((r.ticker, r.live_score), set()).add((r.total_return, r.sharpe, r.n_trades))
    assert by_level and all(len(v) == 1 for v in by_level.values())


def test_the_sweep_repeats_no_row_per_variant(tables, plan):
    text = plan(validate.variant_scores(tables.frame, validate.threshold_variants() + validate.mode_variants()))
    places = [m.start() for m in re.finditer("Generate|Expand", text)]
    first_aggregate = min(m.start() for m in re.finditer("HashAggregate|SortAggregate", text))
    assert places and max(places) < first_aggregate  # only the aggregate's rows are unfolded


def test_the_variants_by_day_agree_with_their_scores(tables):
    variants = validate.threshold_variants([0.0, 0.3]) + validate.mode_variants()
    days = validate.variant_returns(tables.frame, variants)
    mean = {(r.ticker, r.mode, r.threshold): r.total for r in days.groupBy("ticker", "mode", "threshold").agg(
        (F.product(1 + F.coalesce("strategy_returns", F.lit(0.0))) - 1).alias("total")).collect()}
    scores = validate.variant_scores(tables.frame, variants).collect()
    assert len(scores) == len(mean) and all(abs(mean[r.ticker, r.mode, r.threshold] - r.total_return) < 1e-9 for r in scores)
