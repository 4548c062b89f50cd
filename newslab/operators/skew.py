"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_many_to_series(many: DataFrame, series: DataFrame, on: str,
                        per_salt: int = 1000) -> DataFrame:
    """Inner join where every row of ``many`` meets the whole series of its key.

    The output of a hot key is its row count times the series length, which byte-based skew
    handling does not see coming. Keys with more than ``per_salt`` rows are therefore cut into
    as many salts as they need, and only their series is repeated, once per salt.
    """
    salts = many.groupBy(on).agg(
        F.ceil(F.count("*") / F.lit(per_salt)).cast("int").alias("_salts")
    )
    salted = many.join(salts, on).withColumn(
        "_salt", F.pmod(F.xxhash64(*many.columns), F.col("_salts")).cast("int")
    ).drop("_salts")
    repeated = series.join(salts, on).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts")
    return salted.join(repeated, [on, "_salt"]).drop("_salt")
