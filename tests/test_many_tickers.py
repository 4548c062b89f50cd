"""Search and refresh over many small tickers, and what they do with bad input."""

import pytest
from pyspark.sql import functions as F

from newslab.operators import scoring, search
from newslab.sources import embeddings, headlines


def _headlines(spark, tickers, rows=3000):
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(30)).cast("string"))
    return spark.range(rows).select(
        F.concat(F.lit("T"), F.pmod("id", F.lit(tickers)).cast("string")).alias("ticker"),
        F.concat_ws(" ", *[word(k) for k in range(6)]).alias("headline"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("date"),
        F.lit(0.5).alias("sentiment_score")).dropDuplicates(["ticker", "headline"])


@pytest.mark.parametrize("tickers, per_part", [(1, 4096), (500, 4096), (500, 5)])
def test_words_equal_a_plain_comparison(spark, monkeypatch, tickers, per_part):
    monkeypatch.setattr(search, "_QUERIES_PER_PART", per_part)  # 5: more parts than form in place
    monkeypatch.setattr(search, "_PAIRS", 500)
    rows = _headlines(spark, tickers)
    stored = rows.collect()
    queries = rows.groupBy(F.lower("ticker").alias("ticker")).agg(F.min("headline").alias("headline")).withColumn(
        "query_id", F.col("headline").substr(2, 1).cast("long") * 0 + F.substring("ticker", 2, 9).cast("long"))
    asked = {r["ticker"].upper(): (r["query_id"], set(r["headline"].split())) for r in queries.collect()}
    want = set()
    for ticker, (number, words) in asked.items():
        found = []
        for r in stored:
            if r["ticker"] == ticker:
                own = set(r["headline"].split())
                if len(own & words) >= 2:
                    found.append((-len(own & words), -len(own & words) / len(own | words),
                                  -r["date"].toordinal(), r["headline"]))
        want |= {(number, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:5])}
    got = search.lexical_search(rows, queries, top_n=5).collect()
    assert {(r["query_id"], r["rank"], r["headline"], r["shared_count"]) for r in got} == want


def test_vectors_of_other_lengths_are_an_error(spark):
    rows = spark.createDataFrame([("A", "h", None, 0.1, [1.0, 0.0])],
                                 "ticker string, headline string, date date, sentiment_score double, embedding array<float>")
    query = spark.createDataFrame([(1, " a ", [1.0, 0.0, 0.0])], "query_id long, ticker string, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        search.semantic_search(rows, query).collect()
    query = spark.createDataFrame([(1, " a ", [1.0, 0.0])], "query_id long, ticker string, embedding array<float>")
    assert [r["headline"] for r in search.semantic_search(rows, query).collect()] == ["h"]


def test_failing_embedder_stores_nothing(spark, tmp_path):
    def broken():
        def embed(texts):
            raise ValueError("no model")
        return embed

    rows = _headlines(spark, 2, 10)
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception, match="no model"):
        embeddings.refresh_embeddings(rows, path, "m", broken)
    embeddings.write_embeddings(scoring.embed_text(rows.limit(0)).withColumn("model", F.lit("m"))
                                .withColumn("source_version", F.lit("")), path)
    assert embeddings.stale_tickers(rows, path, "m").count() == 2


def test_half_written_index_is_not_read_and_is_replaced(spark, tmp_path):
    raw, index = str(tmp_path / "raw"), tmp_path / "index"
    rows = _headlines(spark, 2, 20)
    rows.write.parquet(raw)
    index.mkdir()
    (index / "part-0.parquet").write_bytes(b"half")
    assert headlines.load_headlines(spark, str(index), raw).count() == rows.count()
    headlines.write_index(rows, str(index))
    assert headlines.load_headlines(spark, str(index), "nowhere").count() == rows.count()
    with pytest.raises(FileExistsError):
        headlines.write_index(rows, str(index))
    headlines.write_index(rows.limit(3), str(index), overwrite=True)
    assert headlines.load_headlines(spark, str(index), "nowhere").count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["index", "raw"]
