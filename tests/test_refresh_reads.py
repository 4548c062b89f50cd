"""How often a refresh of stored vectors works its source out, and how often it asks its model."""

import pytest

from catalog import composites
from catalog.tables import Tables
from newslab.session import new_table_path
from newslab.sources import embeddings as E

SCHEMA = "ticker string, headline string, date date, sentiment_score double"
ROWS = [("A", "oil up", None, 0.2), ("A", "oil down", None, None), ("A", None, None, 0.1), ("B", "gas flat", None, -0.5),
        ("B", "gas flat", None, -0.5), ("", "no name", None, 0.3), (None, "no ticker", None, 0.3)]


@pytest.fixture
def counted(spark):
    """Rows, and how many of them have been worked out so far."""
    done = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            done.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(ROWS, SCHEMA).mapInArrow(passed, SCHEMA), done


def found(rows):
    return sorted(((r["ticker"], r["headline"], r["sentiment_score"]) for r in rows.collect()), key=str)


def test_a_refresh_without_stale_tickers_reads_its_source_once(spark, counted):
    rows, done = counted
    named = rows.filter("ticker IS NULL OR ticker <> ''")
    path = new_table_path(spark, "vectors")
    first = found(E.refresh_embeddings(named, path, "words"))
    assert first == sorted([(t, h, s) for t, h, _, s in ROWS if t], key=str)
    before = done.value
    assert found(E.refresh_embeddings(named, path, "words")) == first
    assert done.value - before == len(ROWS)


def test_a_model_sees_each_headline_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def load():
        def vectors(texts):
            asked.add(len(texts))
            return [[1.0 + len(t), 2.0] for t in texts]

        return vectors

    rows, path = spark.createDataFrame(ROWS, SCHEMA), new_table_path(spark, "vectors")
    E.refresh_embeddings(rows, path, "lengths", load)
    texts = [(t, h, s) for t, h, _, s in ROWS if t is not None and h is not None]
    assert asked.value == len(texts)
    stored = E.read_embeddings(spark, path, "lengths")
    assert found(stored) == sorted([(t or None, h, s) for t, h, s in texts], key=str)
    assert stored.filter("embedding IS NULL").isEmpty()


def test_the_refresh_query_builds_its_index_once(spark, counted):
    rows, done = counted
    tables = Tables(spark, "nowhere")
    tables.__dict__["index"] = rows.filter("length(ticker) > 0")
    got = [tuple(r) for r in composites.p3(tables).collect()]
    assert sorted(got, key=str) == sorted([r for r in ROWS if r[0]], key=str)
    assert done.value == len(ROWS)
