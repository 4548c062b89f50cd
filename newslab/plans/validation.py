"""The out-of-sample study of the strategy's threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from newslab import constants as C
from newslab.operators import validate as V
from newslab.session import settle


def threshold_sweep(headlines: DataFrame, prices: DataFrame, universe: DataFrame,
                    thresholds=C.THRESHOLDS, min_days: int = C.MIN_SENTIMENT_DAYS) -> DataFrame:
    """Mean Sharpe ratio per split and threshold, the best of each split flagged. The split, a row per ticker, is
    stored, and limits the frames to its tickers, too."""
    split = settle(V.alternating_split(universe), "split")
    frame = V.universe_frames(headlines, prices, split, min_days, stored=True)
    scores = V.variant_scores(frame, V.threshold_variants(thresholds))
    return V.mark_best(V.mean_sharpe(scores, split))


@dataclass(frozen=True)
class Validation:
    scores: DataFrame          # per ticker and variant
    sweep: DataFrame           # per split and threshold
    best: DataFrame            # per split
    test_tickers: DataFrame
    generalisation: DataFrame
    components: DataFrame
    edge: DataFrame


def out_of_sample(headlines: DataFrame, prices: DataFrame, universe: DataFrame,
                  thresholds=C.THRESHOLDS, min_days: int = C.MIN_SENTIMENT_DAYS,
                  stored: bool = True) -> Validation:
    """Pick the threshold on every second ticker, test it on the others. The universe is
    split before tickers with too little data drop out.

    Thresholds and components are scored in one job. The scores, a dozen rows per ticker, are
    stored once (``stored``) and every table of the report reads them.
    """
    split = settle(V.alternating_split(universe), "split")
    frame = V.universe_frames(headlines, prices, split, min_days, stored=True)
    variants = V.threshold_variants(thresholds) + V.mode_variants()
    scores = V.variant_scores(frame, variants)
    if stored:
        scores = settle(scores)
    sweep = V.mean_sharpe(scores, split)
    best = V.best_threshold(sweep)
    components = V.decomposition(scores)
    return Validation(
        scores=scores, sweep=sweep, best=best,
        test_tickers=V.held_out_rows(scores, split, best),
        generalisation=V.generalisation(sweep, best),
        components=components, edge=V.edge_label(components),
    )
