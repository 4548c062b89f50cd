"""Search by vectors that are made when they are first needed."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from newslab.functions.text import ticker_key
from newslab.operators.scoring import embed_text
from newslab.operators.search import METHODS, SemanticUnavailable, of_asked_tickers, search
from newslab.sources.embeddings import refresh_embeddings

log = logging.getLogger(__name__)


def search_with_refresh(queries: DataFrame, headlines: DataFrame, path: str, model: str,
                        loader: Callable | None = None, method: str = "auto", cap: int | None = None,
                        **options) -> DataFrame:
    """Search whose vectors are stored at ``path`` under the name ``model``. Only headlines of asked tickers are looked
    at, and of these only tickers whose stored vectors are missing or were made from other rows are embedded, before the
    search; ``cap`` keeps each ticker's newest rows. ``loader()`` gives the model (None: hashed words).

    ``auto`` takes shared words where the loader says that there is no model (:class:`SemanticUnavailable` or
    ImportError, asked once on the driver); then nothing is embedded or stored. Any other failure, and one while
    headlines are embedded, ends the search. The result's ``method`` tells which was taken; ``options`` are those of
    :func:`newslab.operators.search.search`.
    """
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}")
    if method != "lexical" and loader is not None:
        try:
            loader()
        except (SemanticUnavailable, ImportError) as error:
            if method == "semantic":
                raise
            log.warning("semantic search unavailable (%s), using shared words", error)
            method = "lexical"
    if method == "lexical":
        bounds = {k: v for k, v in options.items() if k in ("top_n", "date_from", "date_to")}
        return search(queries, headlines, "lexical", **bounds)
    queries = queries.withColumn("ticker", ticker_key(F.col("ticker")))
    corpus = refresh_embeddings(of_asked_tickers(headlines, queries), path, model, loader, cap)
    return search(queries, headlines, "semantic", corpus=corpus, embed=lambda q: embed_text(q, loader), **options)
