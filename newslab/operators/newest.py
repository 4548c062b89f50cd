"""The newest N headlines of every ticker, without moving or sorting a ticker's headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab.session import settle

_SLICE = 4  # hex digits: 65,536 slices of one day's headlines


def _cut(groups: DataFrame, order: Column, need: Column) -> DataFrame:
    """The group of each ticker in which its ``need``-th row falls, and how many rows are
    wanted from that group."""
    running = (
        Window.partitionBy("ticker").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.sum("_n").over(running) - F.col("_n")
    return (
        groups.withColumn("_before", before)
        .filter((F.col("_before") < need) & (F.col("_before") + F.col("_n") >= need))
        .withColumn("_want", need - F.col("_before"))
    )


def newest_per_ticker(headlines: DataFrame, cap: int) -> DataFrame:
    """Rows by date descending, equal dates by the md5 of the headline, first ``cap``.
    Headlines must be deduplicated.

    The input is read twice. The first read stores what the order depends on, without the texts: ticker, day and
    md5. All counting is done there. Counts per day, added up from the newest, give the day on which a
    crowded ticker's limit falls; counts of that day's md5 slices give the slice, and only its rows are
    ranked, for the last md5 that stays. These limits are one row per crowded ticker, and the second read of the
    headlines is a filter by them that moves no headline while they are small.
    """
    # headlines without a date come after all others, one without a text before all of its day
    day = F.coalesce("date", F.lit("0001-01-01").cast("date"))
    code = F.coalesce(F.unhex(F.md5("headline")), F.lit(b""))
    rows = headlines.withColumns({"_day": day, "_code": code})
    keys = settle(rows.select("ticker", "_day", "_code"), "order-keys")

    per_day = keys.groupBy("ticker", "_day").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("ticker"))
    crowded = per_day.withColumn("_total", total).filter(F.col("_total") > cap)
    day_cuts = settle(
        _cut(crowded, F.col("_day").desc(), F.lit(cap)).select("ticker", "_day", F.col("_want").alias("_need")),
        "day-cuts",
    )
    on_day = keys.join(day_cuts, ["ticker", "_day"]).withColumn(
        "_slice", F.substring(F.hex("_code"), 1, _SLICE)
    )
    slices = on_day.groupBy("ticker", "_day", "_need", "_slice").agg(F.count("*").alias("_n"))
    slice_cuts = _cut(slices, F.col("_slice").asc(), F.col("_need")).select("ticker", "_slice", "_want")
    order = Window.partitionBy("ticker").orderBy("_code")
    limits = settle(
        on_day.join(slice_cuts, ["ticker", "_slice"])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_want"))
        .select("ticker", F.col("_day").alias("_last_day"), F.col("_code").alias("_last_code")),
        "limits",
    )

    stays = (
        F.col("_last_day").isNull()
        | (F.col("_day") > F.col("_last_day"))
        | ((F.col("_day") == F.col("_last_day")) & (F.col("_code") <= F.col("_last_code")))
    )
    return rows.join(limits, "ticker", "left").filter(stays).select(*headlines.columns)
