"""The raw headline table and the deduplicated index built from it.

The index is laid out in buckets of tickers, one folder each, sorted by ticker within. Its rows carry the
``bucket``, so that a question for few tickers reads their folders only: a constant ticker prunes them while
the plan is made, a table of tickers while it runs (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslab import schemas
from newslab.constants import INDEX_BUCKETS, INDEX_ROW_GROUP
from newslab.functions.dates import day
from newslab.functions.text import ticker_key
from newslab.operators.dedup import dedup_index
from newslab.sources.manifest import current, forget_old, new_folder, publish
from newslab.sources.paths import exists, require

BUCKET = "bucket"


def scan_headlines(spark: SparkSession, path: str, columns: dict[str, str] | None = None,
                   keep_time: bool = False) -> DataFrame:
    """Read only the four headline columns, and the bucket of an index. ``columns`` maps them to the names in the file."""
    require(spark, path, "headline table")
    version = current(spark, path)
    folder = path if version is None else f"{path}/{version.folder}"
    names = {f.name: f.name for f in schemas.HEADLINES} | (columns or {})
    date = F.col(names["date"]) if keep_time else day(F.col(names["date"]))
    bucket = [] if version is None else [F.col(BUCKET).alias(BUCKET, metadata=version.facts)]
    return spark.read.parquet(folder).select(
        F.col(names["ticker"]).cast("string").alias("ticker"),
        F.col(names["headline"]).cast("string").alias("headline"),
        date.alias("date"),
        F.col(names["sentiment_score"]).cast("double").alias("sentiment_score"),
        *bucket,
    )


def bucket_of(ticker: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def buckets_of(df: DataFrame) -> int | None:
    """How many buckets the index has that the rows come from; None for other rows."""
    return df.schema[BUCKET].metadata.get("buckets") if BUCKET in df.columns else None


def for_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """One ticker. The stored column is compared as it is, so that the filter reaches the
    parquet statistics of the sorted index; in an index only the ticker's bucket is listed and read."""
    key, buckets = ticker_key(F.lit(ticker)), buckets_of(df)
    rows = df.filter(F.col("ticker") == key)
    return rows if buckets is None else rows.filter(F.col(BUCKET) == bucket_of(key, buckets))


def for_tickers(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows of the tickers of a small stored table. In an index the join is on the bucket, too: the buckets that are
    wanted are known before the scan begins, and folders of others are not read."""
    buckets = buckets_of(df)
    # Spark prunes for a side that a comparison makes selective; this one drops missing tickers.
    wanted = tickers.select("ticker").filter(F.length("ticker") >= 0)
    if buckets is None:
        return df.join(wanted, "ticker", "left_semi")
    return df.join(wanted.withColumn(BUCKET, bucket_of(F.col("ticker"), buckets)), [BUCKET, "ticker"], "left_semi").select(df.columns)


def for_universe(df: DataFrame, universe: list[str] | DataFrame) -> DataFrame:
    if isinstance(universe, DataFrame):
        return df.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    return df.filter(F.col("ticker").isin([t.strip().upper() for t in universe]))


def load_headlines(spark: SparkSession, index_path: str, raw_path: str,
                   ticker: str | None = None) -> DataFrame:
    """The index if it has been built to its end, else the raw table deduplicated on the fly."""
    if current(spark, index_path) is not None:
        found = scan_headlines(spark, index_path)
        return found if ticker is None else for_ticker(found, ticker)
    if not exists(spark, raw_path):
        raise FileNotFoundError(f"no headlines at {index_path} or {raw_path}")
    raw = scan_headlines(spark, raw_path)
    return dedup_index(raw if ticker is None else for_ticker(raw, ticker))


def cluster_by_ticker(df: DataFrame) -> DataFrame:
    """Order by bucket and ticker. Ranges also cut on date and headline, so a ticker that holds
    a large share of the rows is spread over many files instead of one."""
    keys = [*[BUCKET] * (BUCKET in df.columns), "ticker", "date", "headline"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_index(index: DataFrame, path: str, overwrite: bool = False, buckets: int = INDEX_BUCKETS) -> None:
    """One zstd parquet table in buckets of tickers, in ticker order with bounded row groups. An index that is
    already there is kept unless ``overwrite`` is set; then the new one becomes the present version when it is
    complete, and readers of the old one go on undisturbed. What a failed build left is no version."""
    spark = index.sparkSession
    before = current(spark, path)
    if before is not None and not overwrite:
        raise FileExistsError(f"index already built: {path}")
    folder = new_folder()
    (
        cluster_by_ticker(index.withColumn(BUCKET, bucket_of(F.col("ticker"), buckets)))
        .write.partitionBy(BUCKET)
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", INDEX_ROW_GROUP)
        .parquet(f"{path}/{folder}")
    )
    publish(spark, path, folder, before, {"buckets": buckets})
    forget_old(spark, path)
