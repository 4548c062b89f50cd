"""Scores and embeddings of headline texts as batch inference.

A model is a plug-in: a function without arguments that loads it and returns a callable on a
list of texts. It is loaded once per Python worker. Whole texts are passed; a model with a
length limit applies it itself. Without a model, both jobs run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from newslab.constants import EMBED_BATCH
from newslab.functions.numbers import polarity
from newslab.functions.text import tokens, word_array
from newslab.functions.vectors import unit

POSITIVE_WORDS = """
beat beats gain gains good growth high higher jump jumps profit rally record rise rises
soar soars strong surge surges top tops up upgrade win wins
""".split()

NEGATIVE_WORDS = """
bad crash cut cuts decline drop drops fall falls fear fraud loss losses low lower miss misses
plunge plunges sink sinks slump sue warn warns weak worse
""".split()


# --- scores in [-1, 1] ---------------------------------------------------------


def word_polarity(text: Column, positive: list[str] = POSITIVE_WORDS,
                  negative: list[str] = NEGATIVE_WORDS) -> Column:
    """(positive - negative) / (positive + negative) words; 0 without either."""
    def hits(words: list[str]) -> Column:
        listed = word_array(words)
        found = F.filter(tokens(text), lambda t: F.array_contains(listed, t))
        return F.size(found).cast("double")

    up, down = hits(positive), hits(negative)
    return F.when(
        text.isNotNull(), F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0))
    )


def score_text(df: DataFrame, model: Callable | None = None, text: str = "headline",
               output: str = "live_score", positive: int = 0, negative: int = 1) -> DataFrame:
    """Add a polarity score. ``model()`` must return a callable from texts to class logits and
    ``positive``/``negative`` are its class positions; a text it fails on gets NULL."""
    if model is None:
        return df.withColumn(output, word_polarity(F.col(text)))
    logits = _batched(model, "array<double>")
    return (
        df.withColumn("_logits", logits(F.col(text)))
        .withColumn(output, polarity(F.col("_logits"), positive, negative))
        .drop("_logits")
    )


def _batched(load: Callable, result: str, batch: int = EMBED_BATCH, lenient: bool = True) -> Callable:
    """An Arrow UDF that feeds a model with batches. ``lenient``: rows of a failing batch are tried alone,
    and a text that fails gets NULL; else a failure ends the job."""
    @F.pandas_udf(result)
    def infer(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def run(texts):
            try:
                return [list(map(float, row)) for row in model(texts)]
            except Exception:
                if not lenient:
                    raise
                if len(texts) == 1:
                    return [None]
                return [row for t in texts for row in run([t])]

        for chunk in chunks:
            texts = [t for t in chunk if t is not None]
            done = iter([
                row for start in range(0, len(texts), batch) for row in run(texts[start:start + batch])
            ])
            yield pd.Series([None if t is None else next(done) for t in chunk], dtype=object)

    return infer


def fit_scorer(labelled: DataFrame, text: str = "text", label: str = "label",
               features: int = 1 << 14) -> PipelineModel:
    """A scorer trained on texts labelled 0 and 1."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern="[^a-z0-9]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        LogisticRegression(featuresCol="_idf", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score_with(scorer: PipelineModel, df: DataFrame, output: str = "live_score") -> DataFrame:
    chance = vector_to_array("probability")
    scored = scorer.transform(df).withColumn(output, F.get(chance, F.lit(1)) - F.get(chance, F.lit(0)))
    return scored.select(*df.columns, output)


# --- unit vectors ------------------------------------------------------------------


def embed_text(df: DataFrame, model: Callable | None = None, text: str = "headline",
               size: int = 256) -> DataFrame:
    """Add a unit ``embedding``. Without a model: hashed word counts scaled to length 1. A model that fails
    on a text is an error: a missing vector would look like a headline that nothing resembles."""
    if model is not None:
        raw = _batched(model, "array<double>", lenient=False)
        return df.withColumn("_raw", raw(F.col(text))).withColumn(
            "embedding", unit(F.col("_raw")).cast("array<float>")
        ).drop("_raw")
    words = df.withColumn("_tokens", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size).transform(words)
    scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).select(
        *df.columns, "embedding"
    )
