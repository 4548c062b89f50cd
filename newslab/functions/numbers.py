"""Weights, clamps, labels and scores. Missing is always NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from newslab import constants as C


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """``least`` and ``greatest`` skip NULL, so a missing value is kept apart."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def recency_weight(date: Column, as_of: Column, half_life: float = C.HALF_LIFE_DAYS) -> Column:
    """1 today, one half after ``half_life`` days; days ahead of ``as_of`` count as today."""
    age = F.greatest(F.datediff(as_of, date), F.lit(0))
    return F.when(date.isNotNull(), F.exp(F.lit(-math.log(2) / half_life) * age))


def sizing_weight(volatility: Column) -> Column:
    """Target over realised volatility, at most fully invested, 0 where undefined."""
    return F.when(
        volatility > 0,
        F.least(F.try_divide(F.lit(C.TARGET_VOLATILITY), volatility), F.lit(C.MAX_WEIGHT)),
    ).otherwise(0.0)


def net_return(position: Column, returns: Column, turnover: Column) -> Column:
    return position * returns - turnover * F.lit(C.COST)


def verdict_label(composite: Column) -> Column:
    return (
        F.when(composite > C.LABEL_CUT, "BULLISH")
        .when(composite < -C.LABEL_CUT, "BEARISH")
        .otherwise("NEUTRAL")
    )


def sign_class(score: Column, cut: float = 0.0) -> Column:
    return (
        F.when(score > cut, "positive")
        .when(score < -cut, "negative")
        .when(score.isNotNull(), "flat")
    )


def polarity(logits: Column, positive: int = 0, negative: int = 1) -> Column:
    """P(positive) - P(negative) of class logits; the model names its class order."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return (F.get(weights, F.lit(positive)) - F.get(weights, F.lit(negative))) / total


def score_delta(live: Column, historical: Column) -> Column:
    return live - historical


def sharpe(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, mean / sd * math.sqrt(C.TRADING_DAYS))
