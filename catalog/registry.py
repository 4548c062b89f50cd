from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from catalog.oracle import with_ctes
from catalog.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""

    def add(build: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return build

    return add


def rounded(name: str, places: int = 6) -> Column:
    """Sums differ between engines in the last bits. Adding 0 turns -0.0 into 0.0."""
    return (F.round(name, places) + F.lit(0.0)).alias(name)


def tidy(df: DataFrame, *plain: str, r: str = "", r8: str = "") -> DataFrame:
    """The plain columns, ``r`` rounded to 6 places and ``r8`` to 8 (scores, whose averages
    fall on halves of the sixth place)."""
    return df.select(
        *plain, *[rounded(c) for c in r.split()], *[rounded(c, 8) for c in r8.split()]
    )
