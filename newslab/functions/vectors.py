"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scale to length 1; a zero vector stays as it is. The length is bound once by an
    outer one-element transform instead of being worked out again per element."""

    def scaled(length: Column) -> Column:
        divisor = F.when(length > 0, length).otherwise(1.0)
        return F.transform(a, lambda x: x.cast("double") / divisor)

    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))
