"""The trained text network, and the search that embeds what is missing."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslab.operators import text_network as N
from newslab.operators.search import SemanticUnavailable
from newslab.plans.semantic import search_with_refresh
from newslab.sources import embeddings as E

TEXTS = ["Profit rises, again!", "", "...", "loss LOSS loss", "a b c d " * 3000, "Ünïcode 漢字 42"]


def small_network():
    rng = np.random.default_rng(3)
    return N.Network(rng.normal(size=(N.BUCKETS, N.WIDTH)), rng.normal(size=(N.WIDTH, N.WIDTH)),
                     rng.normal(size=N.WIDTH), rng.normal(size=(N.WIDTH, 2)))


def plain_score(network, text):
    """One text, one piece and one cell after the other."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        elif word:
            words.append(word)
            word = ""
    pieces, b = [zlib.crc32(w.encode()) % N.BUCKETS for w in words], text.encode()
    for i in range(len(b) - 2):
        pieces.append((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 40503 // 128 % N.BUCKETS)
    mean = [sum(network.pieces[p][i] for p in pieces) / max(len(pieces), 1) for i in range(N.WIDTH)]
    hidden = [math.tanh(sum(mean[i] * network.hidden[i][j] for i in range(N.WIDTH)) + network.shift[j])
              for j in range(N.WIDTH)]
    up, down = (math.exp(sum(hidden[j] * network.out[j][k] for j in range(N.WIDTH))) for k in (0, 1))
    return (up - down) / (up + down)


def test_network_equals_a_plain_forward_pass(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    network = small_network()
    df = spark.createDataFrame(rows, "id long, headline string").repartition(3)
    got = {r["id"]: r["live_score"] for r in N.score_with_network(network, df).collect()}
    assert got.pop(99) is None and len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(plain_score(network, text), abs=1e-9)
    assert N.score_with_network(network, df.limit(0)).count() == 0


def test_training_fits_a_small_sample():
    """Four texts with words of their own side are all learnt, with finite weights."""
    texts, labels = ["good gain", "bad loss", "gain gain up", "loss down"], np.array([1, 0, 1, 0])
    network = N.train(texts, labels)
    scores = N.logits(network, texts)
    assert ((scores[:, 0] > scores[:, 1]) == (labels == 1)).all()
    assert all(np.isfinite(w).all() for w in network.weights())


def test_network_tells_held_out_documents_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    held = F.col("doc_id") % 5 == 0
    scored = N.score_with_network(N.fit_network(docs.filter(~held)), docs.filter(held), "text").dropna()
    right = scored.agg(F.avg(((F.col("live_score") > 0) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.9  # 0.83 of them have label 1


def test_training_needs_labels(spark):
    with pytest.raises(ValueError):
        N.fit_network(spark.createDataFrame([("x", None)], "text string, label int"))


@pytest.fixture()
def news(spark):
    rows = [(t, f"{w} {i}", "2020-01-01", 0.1) for t in ("A", "B") for i, w in enumerate(("red widget", "blue gadget", "red gadget"))]
    return spark.createDataFrame(rows, "ticker string, headline string, date string, sentiment_score double").withColumn(
        "date", F.to_date("date"))


def asked(spark, *tickers):
    return spark.createDataFrame([(i, t, "Red widget recall") for i, t in enumerate(tickers)],
                                 "query_id long, ticker string, headline string")


def test_only_asked_stale_tickers_are_embedded(spark, news, tmp_path):
    path = str(tmp_path / "vectors")
    stored = lambda: {tuple(r) for r in E.read_embeddings(spark, path, "words").select(
        "ticker", "source_version").distinct().collect()}
    found = search_with_refresh(asked(spark, " a "), news, path, "words", min_similarity=0.1).collect()
    assert {r["method"] for r in found} == {"semantic"} and {r["ticker"] for r in found} == {"A"}
    before = stored()
    assert {t for t, _ in before} == {"A"}
    changed = news.withColumn("sentiment_score", F.when(F.col("ticker") == "A", 0.5).otherwise(F.col("sentiment_score")))
    found = search_with_refresh(asked(spark, "A", "B", "NONE"), changed, path, "words", min_similarity=0.1).collect()
    assert {(r["ticker"], r["sentiment_score"]) for r in found} == {("A", 0.5), ("B", 0.1)}
    assert len(stored()) == 2 and not stored() & before


def test_a_missing_model_means_words_and_stores_nothing(spark, news, tmp_path):
    path = tmp_path / "vectors"

    def missing():
        raise ImportError("no such model")

    def unavailable():
        raise SemanticUnavailable("not downloaded")

    for loader in (missing, unavailable):
        found = search_with_refresh(asked(spark, "A"), news, str(path), "m", loader).collect()
        assert {r["method"] for r in found} == {"lexical"} and not path.exists()
        with pytest.raises((ImportError, SemanticUnavailable)):
            search_with_refresh(asked(spark, "A"), news, str(path), "m", loader, method="semantic")


def test_a_broken_model_ends_the_search(spark, news, tmp_path):
    def broken():
        raise OSError("disk")

    with pytest.raises(OSError):
        search_with_refresh(asked(spark, "A"), news, str(tmp_path / "v"), "m", broken)
    with pytest.raises(ValueError):
        search_with_refresh(asked(spark, "A"), news, str(tmp_path / "v"), "m", method="guess")
    words = search_with_refresh(asked(spark, "A"), news, str(tmp_path / "v"), "m", broken, method="lexical").collect()
    assert {r["method"] for r in words} == {"lexical"}
