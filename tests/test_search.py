"""Search against brute force, with one ticker holding most of the rows."""

import datetime as dt
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslab.constants import STOP_WORDS
from newslab.operators import newest, search, skew

WORDS = "oil gas bank profit loss chip phone cloud deal court launch recall strike the of a".split()
START = dt.date(2015, 1, 1)


@pytest.fixture(scope="module")
def headlines(spark):
    rng = random.Random(7)
    seen = {}
    for _ in range(1500):
        ticker = "HOT" if rng.random() < 0.7 else rng.choice("ABC")
        text = " ".join(rng.choices(WORDS, k=rng.randint(2, 7))) + rng.choice(["", "!", " -"])
        seen[ticker, text] = (ticker, text, START + dt.timedelta(rng.randint(0, 40)), rng.uniform(-1, 1))
    rows = list(seen.values())
    return rows, spark.createDataFrame(rows, "ticker string, headline string, date date, sentiment_score double")


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    rows = [(i, "HOT" if i % 2 else "A", " ".join(rng.choices(WORDS, k=rng.randint(1, 6))).title())
            for i in range(30)]
    return rows, spark.createDataFrame(rows, "query_id long, ticker string, headline string")


def brute_lexical(headlines, ticker, text, top_n, low=None):
    kw = {t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in STOP_WORDS}
    scored = []
    for t, h, d, _ in headlines:
        words = set(re.split("[^a-z0-9]+", h.lower()))
        if t == ticker and len(words & kw) >= 2 and (low is None or d >= low):
            scored.append((-len(words & kw), -len(words & kw) / len(words | kw), -d.toordinal(), h))
    return [(h, -n) for n, _, _, h in sorted(scored)[:top_n]]


def by_query(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["headline"], r["shared_count"]))
    return found


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_batch_search_is_exact(spark, headlines, queries, monkeypatch, limit):
    """Also with shuffled instead of broadcast query blocks."""
    monkeypatch.setattr(search, "_TEXTS_PER_BLOCK", 50)
    monkeypatch.setattr(search, "_KEYWORDS_PER_BLOCK", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = by_query(search.lexical_search(headlines[1], queries[1], top_n=5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {q: brute_lexical(headlines[0], t, h, 5) for q, t, h in queries[0]}
    assert found == {q: m for q, m in want.items() if m}


def test_query_bounds(headlines, queries):
    low = START + dt.timedelta(20)
    asked = queries[1].withColumn("date_from", F.lit(low)).withColumn("date_to", F.lit(None).cast("date"))
    found = by_query(search.lexical_search(headlines[1], asked, top_n=3))
    want = {q: brute_lexical(headlines[0], t, h, 3, low) for q, t, h in queries[0]}
    assert found == {q: m for q, m in want.items() if m}


def test_one_query_equals_batch(headlines, queries):
    query_id, ticker, text = queries[0][3]
    one = search.search_one(headlines[1], f" {ticker.lower()} ", text, top_n=7)
    batch = search.lexical_search(headlines[1], queries[1], top_n=7).filter(F.col("query_id") == query_id)
    assert [r["headline"] for r in one.collect()] == [r["headline"] for r in batch.orderBy("rank").collect()]


def test_newest_equals_sorting(headlines):
    for cap in (1, 37, 200, 10_000):
        want = set()
        for ticker in {r[0] for r in headlines[0]}:
            rows = [r for r in headlines[0] if r[0] == ticker]
            rows.sort(key=lambda r: (-r[2].toordinal(), hashlib.md5(r[1].encode()).hexdigest()))
            want |= {r[:2] for r in rows[:cap]}
        found = newest.newest_per_ticker(headlines[1], cap).collect()
        assert len(found) == len(want) and {(r["ticker"], r["headline"]) for r in found} == want


def test_newest_keeps_headlines_without_a_date(spark):
    rows = [("A", f"h{i}", START if i < 3 else None, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, headline string, date date, sentiment_score double")
    assert newest.newest_per_ticker(df, 10).count() == 6
    found = newest.newest_per_ticker(df, 4).collect()
    assert len(found) == 4 and {r["headline"] for r in found} >= {"h0", "h1", "h2"}


def test_newest_keeps_a_headline_without_text_on_the_last_day(spark):
    rows = [("A", None, START, 0.0), ("A", "x", START, 0.0), ("A", "y", START, 0.0), ("B", None, None, 0.0)]
    df = spark.createDataFrame(rows, "ticker string, headline string, date date, sentiment_score double")
    found = newest.newest_per_ticker(df, 2).collect()
    assert sorted(r["ticker"] for r in found) == ["A", "A", "B"] and sum(r["headline"] is None for r in found) == 2


def test_newest_reads_its_input_twice(spark, tmp_path, monkeypatch):
    """Once to store the order keys, once in the plan that is returned; all else reads stored keys."""
    path, plans = str(tmp_path / "headlines"), []
    spark.range(500).select(
        F.lit("A").alias("ticker"), F.concat(F.lit("h"), "id").alias("headline"), F.lit(START).alias("date")
    ).write.parquet(path)
    store = newest.settle

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(newest, "settle", watched)
    found = newest.newest_per_ticker(spark.read.parquet(path), 100)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert [p.count("headline#") > 0 for p in plans] == [True, False, False, True]
    assert plans[-1].count("Relation") == 2 and found.count() == 100


def test_newest_on_a_single_day(headlines):
    same_day = headlines[1].withColumn("date", F.lit(START))
    counts = newest.newest_per_ticker(same_day, 100).groupBy("ticker").count().collect()
    sizes = {t: sum(r[0] == t for r in headlines[0]) for t in {r[0] for r in headlines[0]}}
    assert {r["ticker"]: r["count"] for r in counts} == {t: min(n, 100) for t, n in sizes.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        v = rng.normal(size=16)
        rows.append(("HOT" if i % 3 else "A", f"h{i}", START + dt.timedelta(i % 30), float(i),
                     (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    rows += [("HOT", f"copy{i}", START, None, rows[1][4]) for i in range(12)]
    return rows, spark.createDataFrame(
        rows, "ticker string, headline string, date date, sentiment_score double, embedding array<float>")


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_semantic_search_is_exact(spark, vectors, monkeypatch, limit):
    monkeypatch.setattr(search, "_ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(search, "_QUERIES_PER_BLOCK", 7)
    rows, corpus = vectors
    asked = [(i, rows[i][0], rows[i][4]) for i in range(0, 900, 31)]
    queries = spark.createDataFrame(asked, "query_id long, ticker string, embedding array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = search.semantic_search(corpus, queries, top_n=8, min_similarity=0.3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["headline"]
    for query_id, ticker, v in asked:
        sims = [(-round(float(np.dot(np.float64(v), np.float64(r[4]))), 12), -r[2].toordinal(), r[1])
                for r in rows if r[0] == ticker]
        want = [h for s, _, h in sorted(sims)[:8] if -s >= 0.3]
        assert [got[query_id][k] for k in sorted(got[query_id])] == want
    assert all(r["sentiment_score"] is None for r in found if r["headline"].startswith("copy"))


def test_search_methods(spark, headlines, queries):
    def broken(_):
        raise search.SemanticUnavailable("no model")

    auto = search.search(queries[1], headlines[1], "auto", corpus=headlines[1], embed=broken)
    assert by_query(auto) == by_query(search.search(queries[1], headlines[1], "lexical"))
    with pytest.raises(search.SemanticUnavailable):
        search.search(queries[1], headlines[1], "semantic", corpus=headlines[1], embed=broken)
    with pytest.raises(search.SemanticUnavailable):
        search.search(queries[1], headlines[1], "semantic")
    with pytest.raises(ValueError):
        search.search(queries[1], headlines[1], "fuzzy")


def test_empty_semantic_result_stays_empty(spark, vectors, headlines):
    asked = spark.createDataFrame([(1, "HOT", "oil gas bank", [0.0] * 16)],
                                  "query_id long, ticker string, headline string, embedding array<float>")
    found = search.search(asked, headlines[1], "auto", corpus=vectors[1], embed=lambda q: q)
    assert found.count() == 0 and "similarity" in found.columns


def test_salted_join_is_complete(spark):
    many = spark.range(5000).select(F.col("id").alias("query_id"),
                                    F.when(F.col("id") % 10 < 9, "HOT").otherwise("B").alias("ticker"))
    series = spark.createDataFrame([(t, n) for t in ("HOT", "B", "C") for n in range(4)], "ticker string, n int")
    found = skew.join_many_to_series(many, series, "ticker", per_salt=100)
    assert found.count() == 20_000
    assert found.distinct().count() == 20_000
