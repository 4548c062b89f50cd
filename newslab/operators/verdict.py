"""Matches and the returns after them, reduced to one verdict per query and ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslab import constants as C
from newslab.functions.dates import DateLike, as_date, day, format_day
from newslab.functions.numbers import (
    clamp, half_even, recency_weight, score_delta, sign_class, verdict_label,
)
from newslab.functions.text import display_text
from newslab.operators.events import with_forward_returns

PERIODS = [f"{n}d" for n in C.HORIZONS]
KEY = ["query_id", "ticker"]


def date_weights(matches: DataFrame, as_of: DateLike = None,
                 half_life: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """One recency weight per query, ticker and date."""
    weight = recency_weight(day(F.col("date")), as_date(as_of), half_life)
    return matches.groupBy(*KEY, "date").agg(F.max(weight).alias("weight"))


def _weighted(value: Column, weight: Column) -> Column:
    present = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(present, weight * value)), F.sum(F.when(present, weight)))


def weighted_sentiment(matches: DataFrame, as_of: DateLike = None,
                       half_life: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """Recency-weighted mean score; the plain mean where no match has a date."""
    weight = recency_weight(day(F.col("date")), as_date(as_of), half_life)
    score = F.col("sentiment_score")
    return matches.groupBy(*KEY).agg(
        F.when(F.count("date") > 0, _weighted(score, weight)).otherwise(F.avg(score))
        .alias("avg_sentiment")
    )


def class_shares(matches: DataFrame) -> DataFrame:
    """Percent of matches above and below the class cut; unscored ones stay in the base."""
    score = F.col("sentiment_score")
    return matches.groupBy(*KEY).agg(
        (F.avg(F.when(score > C.CLASS_CUT, 1.0).otherwise(0.0)) * 100).alias("pct_bullish"),
        (F.avg(F.when(score < -C.CLASS_CUT, 1.0).otherwise(0.0)) * 100).alias("pct_bearish"),
    )


def _per_date(matches: DataFrame, returns: DataFrame, as_of: DateLike,
              half_life: float) -> DataFrame:
    """Matches added up per date, with the weight and the returns of that date."""
    score = F.col("sentiment_score")
    per_date = matches.groupBy(*KEY, "date").agg(
        F.count("*").alias("n"),
        F.count(score).alias("n_scored"),
        F.sum(score).alias("score_sum"),
        F.count(F.when(score > C.CLASS_CUT, 1)).alias("bullish"),
        F.count(F.when(score < -C.CLASS_CUT, 1)).alias("bearish"),
    )
    weight = recency_weight(day(F.col("date")), as_date(as_of), half_life)
    return with_forward_returns(per_date, returns).withColumn("weight", weight)


def _average_returns() -> dict[str, Column]:
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    return {p: _weighted(F.col(f"ret_{p}"), weight) for p in PERIODS}


def weighted_returns(matches: DataFrame, returns: DataFrame, as_of: DateLike = None,
                     half_life: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """Weighted mean return per horizon; each distinct date counts once."""
    return _per_date(matches, returns, as_of, half_life).groupBy(*KEY).agg(
        *[c.alias(f"avg_{p}") for p, c in _average_returns().items()]
    )


def composite_score(sentiment: Column, averages: list[Column]) -> Column:
    """40 parts sentiment and 60 parts price, or sentiment alone without any price."""
    known = sum((F.when(a.isNotNull(), 1).otherwise(0) for a in averages), F.lit(0))
    total = sum((F.coalesce(a, F.lit(0.0)) for a in averages), F.lit(0.0))
    sentiment_part = clamp(sentiment, -1.0, 1.0) * 100
    price_part = clamp(F.try_divide(total, known) * C.PRICE_SCALE, -100.0, 100.0)
    return F.when(
        known > 0, C.SENTIMENT_SHARE * sentiment_part + C.PRICE_SHARE * price_part
    ).otherwise(sentiment_part)


def confidence(composite: Column, n_matches: Column) -> Column:
    sample = clamp(n_matches / F.lit(float(C.FULL_SAMPLE)), None, 1.0)
    return half_even(clamp(F.abs(composite), None, C.MAX_CONFIDENCE) * sample)


def verdicts(matches: DataFrame, returns: DataFrame, queries: DataFrame | None = None,
             as_of: DateLike = None, half_life: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """One row per query and ticker. With ``queries`` given, those without any match are
    neutral with confidence 0."""
    dated = F.col("date").isNotNull()
    per_date = _per_date(matches, returns, as_of, half_life)
    sums = per_date.groupBy(*KEY).agg(
        F.sum("n").alias("n_matches"),
        F.when(
            F.count("date") > 0,
            F.try_divide(
                F.sum(F.when(dated, F.col("weight") * F.col("score_sum"))),
                F.sum(F.when(dated, F.col("weight") * F.col("n_scored"))),
            ),
        ).otherwise(F.try_divide(F.sum("score_sum"), F.sum("n_scored"))).alias("avg_sentiment"),
        (F.sum("bullish") / F.sum("n") * 100).alias("pct_bullish"),
        (F.sum("bearish") / F.sum("n") * 100).alias("pct_bearish"),
        *[c.alias(f"avg_{p}") for p, c in _average_returns().items()],
        (F.count("date") > 0).alias("recency_weighted"),
    )
    if queries is not None:
        sums = queries.select(*KEY).join(sums, KEY, "left")
    empty = F.col("n_matches").isNull()
    composite = composite_score(F.col("avg_sentiment"), [F.col(f"avg_{p}") for p in PERIODS])
    scored = sums.withColumn("composite", composite)
    return scored.select(
        *KEY,
        verdict_label(F.col("composite")).alias("verdict"),
        F.when(empty, F.lit(0).cast("long"))
        .otherwise(confidence(F.col("composite"), F.col("n_matches"))).alias("confidence"),
        F.when(empty, 0.0).otherwise(F.col("avg_sentiment")).alias("avg_sentiment"),
        F.coalesce("pct_bullish", F.lit(0.0)).alias("pct_bullish"),
        F.coalesce("pct_bearish", F.lit(0.0)).alias("pct_bearish"),
        *[f"avg_{p}" for p in PERIODS],
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.coalesce("recency_weighted", F.lit(False)).alias("recency_weighted"),
    )


def report_rows(matches: DataFrame, returns: DataFrame) -> DataFrame:
    """Ranked matches as a user reads them, with the returns after each."""
    return with_forward_returns(matches, returns).select(
        *KEY, "rank",
        format_day(F.col("date")).alias("date"),
        display_text(F.col("headline")).alias("headline"),
        "similarity", "sentiment_score",
        sign_class(F.col("sentiment_score"), C.CLASS_CUT).alias("sentiment_class"),
        *[f"ret_{p}" for p in PERIODS],
    )


def comparison(verdict: DataFrame, scored_queries: DataFrame) -> DataFrame:
    """One row per ticker of a query, with the live score beside the historical mean."""
    live = scored_queries.select(*KEY, "live_score")
    return verdict.join(live, KEY).select(
        *KEY, "verdict", "confidence", "avg_sentiment", "n_matches",
        *[f"avg_{p}" for p in PERIODS], "live_score",
        score_delta(F.col("live_score"), F.col("avg_sentiment")).alias("score_delta"),
        sign_class(F.col("avg_sentiment"), 0.05).alias("sentiment_class"),
    )
