"""What Spark makes of the operators."""

import re

import pytest

from catalog.tables import Tables
from newslab.functions.dates import within
from newslab.operators import events, search, strategy, validate
from newslab.sources import headlines as H


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def exchanges_by(plan_text, key):
    return len(re.findall(rf"Exchange hashpartitioning\({key}#\d+, \d+\)", plan_text))


def test_index_filter_reaches_the_scan(tables, spark, plan):
    path = tables.scratch("index")
    H.write_index(tables.index, path)
    text = plan(within(H.for_ticker(H.scan_headlines(spark, path), "promo"), "1999-01-01"))
    assert "EqualTo(ticker,PROMO)" in text and "GreaterThanOrEqual(date,1999-01-01)" in text


def test_scan_reads_only_needed_columns(tables, plan):
    from catalog.scans import EVENT_COLUMNS

    df = H.scan_headlines(tables.spark, tables.path("events"), EVENT_COLUMNS)
    schema = re.search(r"ReadSchema: (\S+)", plan(df.groupBy("ticker").count())).group(1)
    assert schema == "struct<event_type:string>"


def test_backtest_chain_has_one_exchange_and_one_sort(tables, plan):
    text = plan(strategy.metrics(tables.backtest))
    assert exchanges_by(text, "ticker") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_sweep_adds_no_exchange_to_the_frame(tables, plan):
    text = plan(validate.variant_scores(tables.frame, validate.threshold_variants()))
    assert exchanges_by(text, "ticker") == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_forward_returns_use_no_nested_loop(tables, plan):
    text = plan(events.forward_returns(tables.raw, tables.prices))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_ranks_are_trimmed_before_the_shuffle(tables, plan):
    text = plan(search.lexical_search(tables.index, tables.queries))
    assert text.count("WindowGroupLimit") == 2
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_single_search_is_a_top_k(tables, plan):
    text = plan(search.search_one(tables.index, "PROMO", "urgent red widget"))
    assert "TakeOrderedAndProject" in text


def test_large_ticker_spans_files(tables, spark):
    """A ticker with almost all rows is cut into several sorted files."""
    from pyspark.sql import functions as F

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = tables.scratch("index")
        H.write_index(tables.index.withColumn("ticker", F.lit("HOT")).dropDuplicates(["headline"]), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 2 * sum(r["count"] for r in files) / len(files)
