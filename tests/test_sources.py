import datetime as dt

import pytest
from pyspark.sql import functions as F

from newslab.operators import scoring
from newslab.plans.analysis import analyze
from newslab.plans.index import build_index
from newslab.session import new_table_path
from newslab.sources import embeddings as E
from newslab.sources import headlines as H
from newslab.sources import prices as P

D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
ROWS = [("A", "oil up", D2, 0.2), ("A", "oil up", D1, 0.4), ("B", "gas down", D1, -0.5), ("B", "gas flat", D2, None)]
SCHEMA = "ticker string, headline string, date date, sentiment_score double"


@pytest.fixture
def raw(spark):
    path = new_table_path(spark, "raw")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    return path


def content(df):
    return sorted((r["ticker"], r["headline"], r["date"], r["sentiment_score"]) for r in df.collect()
                  if r["sentiment_score"] is not None)


def test_index_build_is_idempotent_and_guarded(spark, raw):
    path = new_table_path(spark, "index")
    stats = build_index(spark, raw, path).collect()[0]
    assert tuple(stats) == (3, 2, D1, D2)
    first = content(H.scan_headlines(spark, path))
    assert first == [("A", "oil up", D1, pytest.approx(0.3)), ("B", "gas down", D1, -0.5)]
    with pytest.raises(FileExistsError):
        build_index(spark, raw, path)
    build_index(spark, raw, path, overwrite=True)
    assert content(H.scan_headlines(spark, path)) == first


def test_source_choice(spark, raw):
    index = new_table_path(spark, "index")
    assert H.load_headlines(spark, index, raw, "a").count() == 1
    build_index(spark, raw, index)
    assert content(H.load_headlines(spark, index, raw)) == content(H.scan_headlines(spark, index))
    with pytest.raises(FileNotFoundError):
        H.load_headlines(spark, new_table_path(spark, "x"), new_table_path(spark, "y"))
    with pytest.raises(FileNotFoundError):
        build_index(spark, new_table_path(spark, "x"), index)


def test_wide_prices(spark):
    wide = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0, 0), 1.0, None), (dt.datetime(2020, 1, 2, 0, 0), 2.0, 9.0)],
                                 "Date timestamp_ntz, AAPL double, MSFT double")
    found = {tuple(r) for r in P.long_prices(wide, "Date").collect()}
    assert found == {("AAPL", D1, 1.0), ("AAPL", D2, 2.0), ("MSFT", D2, 9.0)}


def test_only_changed_tickers_are_embedded_again(spark):
    path = new_table_path(spark, "vectors")
    one = spark.createDataFrame([r for r in ROWS if r[3] != 0.2], SCHEMA)
    assert E.refresh_embeddings(one, path, "words").count() == 3
    assert E.stale_tickers(one, path, "words").count() == 0
    assert E.stale_tickers(one, path, "other").count() == 2
    grown = one.unionByName(spark.createDataFrame([("B", "gas up", D2, 0.1)], SCHEMA))
    assert [r["ticker"] for r in E.stale_tickers(grown, path, "words").collect()] == ["B"]
    found = E.refresh_embeddings(grown, path, "words")
    assert found.count() == 4 and E.stale_tickers(grown, path, "words").count() == 0
    assert found.select(F.size("embedding")).distinct().collect()[0][0] == 256


def test_model_plug_in(spark):
    def load():
        def logits(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot read")
            return [[float(len(t)), 0.0, 0.0] for t in texts]

        return logits

    df = spark.createDataFrame([("x" * 50,), ("bad",), (None,), ("",)], "headline string").coalesce(1)
    found = [r[0] for r in scoring.score_text(df, load).select("live_score").collect()]
    assert found[0] == pytest.approx(1.0) and found[1] is None and found[2] is None and found[3] == 0.0


def test_vector_plug_in(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "headline string")
    found = scoring.embed_text(df, lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    assert [[round(x, 6) for x in r["embedding"]] for r in found.collect()] == [[0.6, 0.8]] * 2


def test_word_scores(spark):
    df = spark.createDataFrame([("Profit up, record LOSS",), ("nothing",), (None,)], "headline string")
    found = [r[0] for r in scoring.score_text(df).select("live_score").collect()]
    assert found == [0.5, 0.0, None]


def test_rejected_queries_have_no_verdict(spark):
    index = spark.createDataFrame(ROWS, SCHEMA)
    prices = spark.createDataFrame([("A", D1, 1.0)], "ticker string, date date, close double")
    asked = spark.createDataFrame([(1, "a ", "oil up today strongly rising"), (2, "A", " oil "), (3, "A", "the oil was")],
                                  "query_id long, ticker string, headline string")
    result = analyze(asked, index, prices, method="lexical", as_of="2020-02-01")
    reasons = {r["query_id"]: r["reject_reason"] for r in result.queries.collect()}
    assert reasons == {1: None, 2: "headline too short", 3: "too few keywords"}
    assert [(r["query_id"], r["ticker"], r["verdict"]) for r in result.verdicts.collect()] == [(1, "A", "NEUTRAL")]
