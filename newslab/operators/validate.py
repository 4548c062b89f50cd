"""Does the sentiment threshold hold out of sample?

All thresholds and signal components are scored in one pass. The position of a day depends
only on the day before, so the frame is windowed once, and each variant is worked out per row
from the lagged inputs after that: no variant needs a window, a sort or an exchange of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab import constants as C
from newslab.functions.numbers import net_return, sharpe, sizing_weight
from newslab.operators.daily import by_day, usable_tickers
from newslab.operators.strategy import strategy_frame, uptrend
from newslab.session import settle
from newslab.sources.headlines import for_universe

BUY_AND_HOLD = "buyhold"
MODES = ("trend", "sentiment", "combined")


def universe_frames(headlines: DataFrame, prices: DataFrame,
                    universe: list[str] | DataFrame | None = None,
                    min_days: int = C.MIN_SENTIMENT_DAYS, stored: bool = False) -> DataFrame:
    """Strategy frames of the universe, without tickers that have too little sentiment. A
    universe given as a table is stored first, unless it is, so that Spark joins it by its true size."""
    if isinstance(universe, DataFrame) and not stored:
        universe = settle(universe.select("ticker").distinct(), "universe")
    if universe is not None:
        headlines = for_universe(headlines, universe)
        prices = for_universe(prices, universe)
    return usable_tickers(strategy_frame(headlines, prices), min_days)


# --- split ---------------------------------------------------------------------


def alternating_split(universe: DataFrame) -> DataFrame:
    """Even positions of the sorted tickers train, odd ones test. Positions are counted
    within each leading character and shifted by the characters before, so the tickers are
    not sorted in one task."""
    tickers = universe.select("ticker").distinct().withColumn("_head", F.substring("ticker", 1, 1))
    heads = tickers.groupBy("_head").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    shifts = heads.select(
        "_head", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    place = F.row_number().over(Window.partitionBy("_head").orderBy("ticker")) - 1
    return (
        tickers.withColumn("_place", place)
        .join(shifts, "_head")
        .select(
            "ticker",
            F.when((F.col("_place") + F.col("_shift")) % 2 == 0, "train")
            .otherwise("test").alias("split"),
        )
    )


# --- variants ----------------------------------------------------------------------


@dataclass(frozen=True)
class Variant:
    mode: str
    threshold: float
    uses_sentiment: bool = True
    uses_trend: bool = True


def threshold_variants(thresholds=C.THRESHOLDS) -> list[Variant]:
    return [Variant("threshold", float(t)) for t in thresholds]


def mode_variants(modes=MODES) -> list[Variant]:
    return [Variant(m, 0.0, uses_sentiment=m != "trend", uses_trend=m != "sentiment") for m in modes]


def _signal_inputs() -> Column:
    sentiment = F.col("smooth_sentiment")
    return F.struct(
        sentiment.alias("sentiment"), uptrend().alias("up"),
        F.when(uptrend(), sentiment).alias("gated"),
        sizing_weight(F.col("volatility_20d")).alias("weight"),
    )


def _position(inputs: str, variant: Variant) -> Column:
    """Position taken from one day's inputs; 0 before the first day."""
    held = f"{inputs}.up"
    if variant.uses_sentiment:
        held = f"{inputs}.{'gated' if variant.uses_trend else 'sentiment'} > {variant.threshold!r}D"
    return F.expr(f"CASE WHEN {held} THEN {inputs}.weight ELSE 0.0D END")  # an unknown condition is none


def _variant_return(variant: Variant) -> Column:
    now, before = _position("_day1", variant), _position("_day2", variant)
    return net_return(now, F.col("returns"), F.abs(now - before))


def lagged_inputs(frame: DataFrame) -> DataFrame:
    """A day's return with the signal inputs of the two days before."""
    return frame.select(
        "ticker", "date", "returns",
        F.lag(_signal_inputs(), 1).over(by_day()).alias("_day1"),
        F.lag(_signal_inputs(), 2).over(by_day()).alias("_day2"),
    )


def variant_returns(frame: DataFrame, variants: list[Variant]) -> DataFrame:
    """The daily returns of every variant, one row per ticker, day and variant."""
    each = [F.struct(F.lit(v.mode).alias("mode"), F.lit(v.threshold).alias("threshold"), _variant_return(v).alias("strategy_returns"))
            for v in variants]
    return lagged_inputs(frame).select("ticker", "date", "returns", F.inline(F.array(*each))).select(
        "ticker", "date", "mode", "threshold", "returns", "strategy_returns")


def variant_scores(frame: DataFrame, variants: list[Variant]) -> DataFrame:
    """Sharpe ratio and total return per ticker and variant, and of holding the ticker.

    Each variant is a column of its own beside the others, and its mean, deviation and growth are added up in the one
    aggregate by ticker; a row is not repeated per variant. Only the finished rows, one per ticker, are unfolded.
    """
    held = F.col("returns")
    days = lagged_inputs(frame).select("ticker", "returns", *[_variant_return(v).alias(f"_r{i}") for i, v in enumerate(variants)])
    scores = [
        F.struct(
            F.lit(v.mode).alias("mode"), F.lit(v.threshold).alias("threshold"),
            sharpe(F.avg(f"_r{i}"), F.stddev_samp(f"_r{i}")).alias("sharpe"),
            (F.product(1 + F.coalesce(f"_r{i}", F.lit(0.0))) - 1).alias("total_return"),
        ).alias(f"_v{i}")
        for i, v in enumerate(variants)
    ]
    sums = days.groupBy("ticker").agg(sharpe(F.avg(held), F.stddev_samp(held)).alias("bh_sharpe"), *scores)
    return sums.select("ticker", "bh_sharpe", F.inline(F.array(*[f"_v{i}" for i in range(len(variants))]))).select(
        "ticker", "mode", "threshold", "sharpe", "total_return", "bh_sharpe")


def sharpe_at(frame: DataFrame, threshold: float) -> DataFrame:
    return variant_scores(frame, threshold_variants([threshold])).select(
        "ticker", "threshold", "sharpe", "total_return"
    )


# --- reductions of the scores ----------------------------------------------------


def mean_sharpe(scores: DataFrame, split: DataFrame) -> DataFrame:
    """Mean over the tickers of each split; undefined ratios are left out."""
    return (
        scores.filter(F.col("mode") == "threshold")
        .join(split, "ticker")
        .groupBy("split", "threshold")
        .agg(F.avg("sharpe").alias("mean_sharpe"))
    )


def mark_best(sweep: DataFrame) -> DataFrame:
    """Flag the threshold with the highest mean of each split; the lowest of equals."""
    value = F.coalesce("mean_sharpe", F.lit(C.UNSCORED))
    order = Window.partitionBy("split").orderBy(value.desc(), F.asc("threshold"))
    return sweep.withColumn("is_best", F.row_number().over(order) == 1)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The best threshold of each split, as one arg-max aggregate."""
    value = F.coalesce("mean_sharpe", F.lit(C.UNSCORED))
    return sweep.groupBy("split").agg(
        F.max_by(F.struct("threshold", "mean_sharpe"), F.struct(value, -F.col("threshold")))
        .alias("best")
    ).select("split", "best.threshold", "best.mean_sharpe")


def decomposition(scores: DataFrame) -> DataFrame:
    """Mean ratio of each signal component and of buy-and-hold, once per ticker."""
    parts = scores.filter(F.col("mode").isin(*MODES)).select("mode", "sharpe")
    held = scores.filter(F.col("mode") == MODES[-1]).select(
        F.lit(BUY_AND_HOLD).alias("mode"), F.col("bh_sharpe").alias("sharpe")
    )
    return parts.unionByName(held).groupBy("mode").agg(F.avg("sharpe").alias("mean_sharpe"))


def held_out_rows(scores: DataFrame, split: DataFrame, best: DataFrame) -> DataFrame:
    """Test tickers at the threshold picked on the train tickers."""
    picked = best.filter(F.col("split") == "train").select("threshold")
    test = split.filter(F.col("split") == "test").select("ticker")
    return (
        scores.filter(F.col("mode") == "threshold")
        .join(test, "ticker")
        .join(picked, "threshold")
        .select("ticker", "threshold", "sharpe", "total_return")
    )


def generalisation(sweep: DataFrame, best: DataFrame) -> DataFrame:
    """One row: the picks of both splits, the gap between them on test, and a label."""
    def pick(name: str) -> Column:
        return F.max(F.when(F.col("split") == name, F.col("threshold")))

    picks = best.agg(
        pick("train").alias("train_threshold"), pick("test").alias("test_threshold"),
        F.max(F.when(F.col("split") == "test", F.col("mean_sharpe"))).alias("test_optimum"),
    )
    at_pick = sweep.filter(F.col("split") == "test").select(
        F.col("threshold").alias("train_threshold"), F.col("mean_sharpe").alias("test_at_train")
    )
    gap = F.col("test_optimum") - F.col("test_at_train")
    return picks.join(at_pick, "train_threshold", "left").withColumn("gap", gap).withColumn(
        "label",
        F.when(F.col("train_threshold") == F.col("test_threshold"), "agree")
        .when(F.col("gap") < C.ROBUST_GAP, "robust")
        .otherwise("curve-fit"),
    )


def edge_label(components: DataFrame) -> DataFrame:
    """Whether the sentiment gate adds return for its risk."""
    def mean(mode: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col("mean_sharpe")))

    means = components.agg(
        *[mean(m).alias(m) for m in (*MODES, BUY_AND_HOLD)]
    )
    none = (F.col("sentiment") < C.EDGE_SHARPE) & (F.col("combined") < F.col("trend"))
    return means.withColumn("edge", F.when(none, "no edge").otherwise("contributes"))
