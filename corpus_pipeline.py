"""A training corpus from `documents`: filter, deduplicate, pack. Part of the llm subpackage.

Each stage reads what the one before it wrote; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslab.llm import language, quality, repeats, simhash
from newslab.llm.queries import GOOD, packed, quality_network
from newslab.session import settle

#: A language that is ambiguous and less sure than this is none.
SURE = 0.4
#: A repeated passage has so many bytes: some 40 words, so that one of 50 short words is found, too. Its windows'
#: sampled suffixes start within the first so many.
REPEAT, REPEAT_REACH = 240, 150


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network gives GOOD or more; empty texts get a score, too."""
    scored = quality.score(docs, quality_network(docs, sf_dir), docs.columns)
    return scored.where(F.col("score") >= GOOD).select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: not `und`, nor ambiguous with a score below SURE."""
    found = language.predict(docs, language.train(docs), docs.columns)
    sure = ~F.col("ambiguous") | (F.col("score") >= SURE)
    return found.where((F.col("lang_pred") != "und") & sure).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, two bits."""
    return simhash.keep_one(docs, words=3, radius=2)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of REPEAT bytes; n_chars counts what is left."""
    found = repeats.remove_repeats(docs, length=REPEAT, reach=REPEAT_REACH)
    kept = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*[kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_copies),
    ("repeats", without_repeats),
    ("packing", into_sequences),
]
#: Trained models, fingerprints and tokenizers have no SQL form. The tests of the operators compare fingerprints, repeats and
#: pieces with plain versions and models by held-out accuracy; the stages' own test looks at columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
