"""Stored headline embeddings and their refresh.

A stored row carries the headline, its vector, the model name and the version of the source
rows it was made from, so a vector can never drift from its headline. Only tickers whose stored
version differs from the source are embedded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslab.operators.newest import newest_per_ticker
from newslab.operators.scoring import embed_text
from newslab.session import settle
from newslab.sources.paths import exists


def source_versions(headlines: DataFrame) -> DataFrame:
    """A fingerprint of each ticker's rows that changes whenever one of them does. Scores count to
    eight places: the last bits of a mean depend on the order in which it was added up."""
    row = F.xxhash64("headline", "date", F.round("sentiment_score", 8))
    return headlines.groupBy("ticker").agg(
        F.concat_ws("-", F.count("*"), F.bit_xor(row), F.max("date")).alias("source_version")
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Ranges are cut on date and headline too, so a large ticker is written by many tasks."""
    return rows.repartitionByRange("ticker", "date", "headline")


def _store(rows: DataFrame, path: str) -> None:
    """One folder per model and ticker; written tickers replace their older rows."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("model", "ticker")
        .parquet(path)
    )


def write_embeddings(rows: DataFrame, path: str) -> None:
    _store(_spread(rows), path)


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    schema = ("headline string, date date, sentiment_score double, embedding array<float>, "
              "source_version string, model string, ticker string")
    return spark.read.schema(schema).parquet(path).filter(F.col("model") == model)


def stale_tickers(headlines: DataFrame, path: str, model: str) -> DataFrame:
    """Tickers without stored vectors of this model and of the present source rows."""
    return _not_stored(source_versions(headlines), path, model)


def _not_stored(versions: DataFrame, path: str, model: str) -> DataFrame:
    spark = versions.sparkSession
    if not exists(spark, path):
        return versions
    stored = read_embeddings(spark, path, model).select("ticker", "source_version").distinct()
    return versions.join(stored, ["ticker", "source_version"], "left_anti")


def refresh_embeddings(headlines: DataFrame, path: str, model: str,
                       loader: Callable | None = None, cap: int | None = None) -> DataFrame:
    """Embed the rows of stale tickers (all, or the newest ``cap`` of each), store them, and return
    what is stored of the tickers that the source still has. If the model fails, nothing is stored
    and the tickers stay stale; rows without a vector (no headline) are not stored.

    The source is read for its versions, and again only if a ticker is stale. Rows are moved and sorted for
    the write before they get their vectors, so no vector is shuffled, sorted or spilled, or made a second time for
    the sample that cuts the ranges."""
    spark = headlines.sparkSession
    versions = settle(source_versions(headlines), "versions")
    # Rows without a ticker are not stored, so they are stale for ever, and no reason to read on.
    stale = settle(_not_stored(versions, path, model).filter(F.col("ticker").isNotNull()), "stale")
    if not exists(spark, path) or not stale.isEmpty():
        rows = headlines.join(stale, "ticker")
        if cap is not None:
            rows = newest_per_ticker(rows, cap)
        if loader is not None:
            rows = rows.filter(F.col("headline").isNotNull())  # a model gives the others no vector
        # The writer takes this order as its own only for a column without nulls; none are left.
        rows = rows.withColumn("ticker", F.coalesce(F.col("ticker").cast("string"), F.lit(""))).withColumn("model", F.lit(model))
        _store(embed_text(_spread(rows).sortWithinPartitions("ticker"), loader), path)
    return read_embeddings(spark, path, model).join(versions.select("ticker"), "ticker", "left_semi")
