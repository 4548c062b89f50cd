"""Daily series: sentiment per day, and its alignment with prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newslab import constants as C
from newslab.functions.dates import day


def by_day(keys=("ticker",)):
    return Window.partitionBy(*keys).orderBy("date")


def all_days(keys=("ticker",)):
    """Every row of the key; the same order as :func:`by_day`, so that one sort serves both."""
    return by_day(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def daily_sentiment(headlines: DataFrame) -> DataFrame:
    """Mean score and number of headlines per ticker and day; articles without a score count."""
    return headlines.groupBy("ticker", day(F.col("date")).alias("date")).agg(
        F.avg("sentiment_score").alias("daily_score"), F.count("*").alias("articles")
    )


def dashboard_sentiment(headlines: DataFrame, since: str | None = None) -> DataFrame:
    """As above, from ``since`` on if it is given; ``articles`` counts scored headlines only and
    ``n_rows`` all of them."""
    recent = headlines
    if since is not None:
        recent = headlines.filter(day(F.col("date")) >= F.lit(since).cast("date"))
    return recent.groupBy("ticker", day(F.col("date")).alias("date")).agg(
        F.avg("sentiment_score").alias("sentiment"),
        F.count("sentiment_score").alias("articles"),
        F.count("*").alias("n_rows"),
    )


def merge_days(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two daily tables on (ticker, date).

    Both sides hold at most one row per ticker and calendar day. They are stacked and
    exchanged once by ticker; the grouping and every later window by ticker then reuse
    that partitioning, where a join on both keys would need further exchanges. A second row of
    one side for a ticker and day stops the job: there is no telling which one is meant.
    """
    columns = {f.name: f.dataType for s in (left.schema, right.schema) for f in s}
    values = [c for c in columns if c not in ("ticker", "date")]

    def padded(df: DataFrame, side: int) -> DataFrame:
        have = set(df.columns)
        return df.select(
            "ticker", "date", F.lit(1 << 32 * side).cast("long").alias("_side"),
            *[F.col(c) if c in have else F.lit(None).cast(columns[c]).alias(c) for c in values],
        )

    stacked = padded(left, 0).unionByName(padded(right, 1)).repartition("ticker")
    # The rows of both sides are counted in the halves of one number, and looked at once for a day.
    rows = F.sum("_side").alias("_rows")
    once = (F.col("_rows") < 1 << 33) & (F.col("_rows") % (1 << 32) < 2)
    error = F.raise_error(F.lit("two rows of one table for one ticker and day")).cast("boolean")
    return stacked.groupBy("ticker", "date").agg(rows, *[F.max(c).alias(c) for c in values]).filter(
        F.when(once, True).otherwise(error)).drop("_rows")


def prices_with_sentiment(prices: DataFrame, daily: DataFrame, how: str = "left",
                          lead_days: int | None = None) -> DataFrame:
    """Prices joined to daily sentiment on the day. Sentiment of days without trading is
    dropped. ``how='inner'`` keeps only days with both. With ``lead_days``, prices start that
    many calendar days before the ticker's first sentiment day, and tickers without any
    sentiment drop out."""
    rows = merge_days(
        prices.select("ticker", "date", "close"),
        daily.select("ticker", "date", "daily_score", "articles"),
    )
    if lead_days is not None:
        first = F.min(F.when(F.col("articles").isNotNull(), F.col("date"))).over(all_days())
        rows = rows.withColumn("_first", first).filter(
            F.col("date") >= F.date_sub("_first", lead_days)
        ).drop("_first")
    rows = rows.filter(F.col("close").isNotNull())
    return rows.dropna(subset=["daily_score"]) if how == "inner" else rows


def sentiment_days(frame: DataFrame) -> DataFrame:
    return frame.groupBy("ticker").agg(F.count("daily_score").alias("sentiment_days"))


def usable_tickers(frame: DataFrame, more_than: int = C.MIN_SENTIMENT_DAYS) -> DataFrame:
    """Rows of tickers with enough days that carry sentiment after the fill; counted in the
    frame's own partitioning, without a join."""
    return (
        frame.withColumn("_days", F.count("daily_score").over(all_days()))
        .filter(F.col("_days") > more_than)
        .drop("_days")
    )
