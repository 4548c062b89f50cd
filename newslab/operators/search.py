"""Similar past headlines by shared words or by embedding cosine.

Queries are a table ``(query_id, ticker, headline)``; one headline for many tickers is that
headline on several rows (:func:`for_tickers`).
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslab import constants as C
from newslab import schemas
from newslab.functions import text
from newslab.functions.dates import DateLike, within
from newslab.operators.newest import newest_per_ticker
from newslab.session import settle
from newslab.sources.headlines import for_tickers as tickers_only

log = logging.getLogger(__name__)

# --- queries ---------------------------------------------------------------


def for_tickers(queries: DataFrame, tickers: Column) -> DataFrame:
    """Each query once per ticker of an array column."""
    return queries.withColumn("ticker", F.explode(tickers))


def check_queries(queries: DataFrame, method: str = "auto") -> DataFrame:
    """Add the trimmed headline, keywords and, for queries that cannot run, the reason."""
    lexical = F.lit(method == "lexical")
    headline = F.trim("headline")
    return (
        queries.withColumn("ticker", text.ticker_key(F.col("ticker")))
        .withColumn("headline", headline)
        .withColumn("keywords", text.keywords(F.col("headline")))
        .withColumn(
            "reject_reason",
            F.when(F.coalesce(F.length("headline"), F.lit(0)) < C.MIN_HEADLINE_CHARS,
                   "headline too short")
            .when(lexical & (F.size("keywords") < C.MIN_SHARED), "too few keywords"),
        )
    )


def asked_tickers(queries: DataFrame) -> DataFrame:
    """The tickers that queries ask for, with their number of queries. They are stored, so that Spark sees their
    size and sends them to every task while they are few."""
    return settle(queries.groupBy("ticker").agg(F.count("*").alias("n_queries")), "tickers")


def of_asked_tickers(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Only rows of tickers that some query asks for; of an index, only their buckets are read."""
    return tickers_only(rows, asked_tickers(queries))


def _match_rows(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.MATCHES
    ])


def ranked(df: DataFrame, order: list[Column], top_n: int) -> DataFrame:
    """The best rows of each query and ticker. Up to the trim limit each task first keeps
    its own best rows, so a query with very many candidates does not fill one task."""
    window = Window.partitionBy("query_id", "ticker").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_n)


def _newest() -> list[Column]:
    return [F.desc("date"), F.asc("headline")]


def rank_lexical(scored: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    return ranked(scored, [F.desc("shared_count"), F.desc("jaccard"), *_newest()], top_n)


def rank_semantic(scored: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    return ranked(scored, [F.desc("similarity"), *_newest()], top_n)


# --- blocks ----------------------------------------------------------------------

_QUERIES_PER_PART = 4096
_PARTS_IN_PLACE = 64


def part_count(tickers: DataFrame) -> int:
    """Asked tickers are dealt to so many parts; a part holds the queries of many small tickers."""
    return max(1, -(-(tickers.agg(F.sum("n_queries")).first()[0] or 0) // _QUERIES_PER_PART))


def blocks(df: DataFrame, rows_per_block: int, parts: int = 1) -> DataFrame:
    """Rows of one part of the tickers side by side, in ticker order, however few rows a ticker has.

    A column becomes an array; of a column of arrays, ``<name>`` holds the flat values and ``<name>_n``
    the length of each. Blocks form inside each task, without a shuffle, while a batch has
    enough rows of each part; with more parts than that, rows are first brought together by part
    and a hash of the row, so that no large ticker fills one task.
    """
    names = df.columns
    nested = {f.name: f.dataType.elementType.simpleString() for f in df.schema
              if f.dataType.typeName() == "array"}
    schema = "part int, " + ", ".join(
        f"{f.name} binary, {f.name}_n array<int>" if f.name in nested
        else f"{f.name} array<{f.dataType.simpleString()}>" for f in df.schema)
    rows = df.select(F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int").alias("part"), *names)
    if parts > _PARTS_IN_PLACE:
        salt = F.pmod(F.xxhash64(*names), F.lit(16))
        rows = rows.repartition("part", salt).sortWithinPartitions("part")

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch, sort_keys=[("part", "ascending"), ("ticker", "ascending")])
            table = pa.Table.from_batches([batch]).take(order).combine_chunks()
            part = table["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                for start in range(first, last, rows_per_block):
                    n = min(rows_per_block, last - start)
                    columns = [pa.array([part[start]], pa.int32())]
                    ends = pa.array([0, n], pa.int32())
                    for name in names:
                        cut = table[name].slice(start, n).combine_chunks()
                        if isinstance(cut, pa.ChunkedArray):
                            cut = cut.chunk(0)
                        if name in nested:
                            lengths = pc.fill_null(pc.list_value_length(cut), 0).cast(pa.int32())
                            flat = cut.flatten().to_numpy(zero_copy_only=False)
                            columns += [pa.array([flat.tobytes()], pa.binary()),
                                        pa.ListArray.from_arrays(ends, lengths)]
                        else:
                            columns.append(pa.ListArray.from_arrays(ends, cut))
                    yield pa.RecordBatch.from_arrays(
                        columns, ["part", *(m for n_ in names for m in ([n_, f"{n_}_n"] if n_ in nested else [n_]))])

    return rows.mapInArrow(pack, schema)


# --- shared words ------------------------------------------------------------


def score_overlap(rows: DataFrame, kw: Column, min_shared: int = C.MIN_SHARED) -> DataFrame:
    words = text.stored_words(F.col("headline"))
    return (
        rows.withColumn("shared_count", text.shared_count(words, kw))
        .filter(F.col("shared_count") >= min_shared)
        .withColumn("jaccard", text.jaccard(words, kw))
    )


def search_one(headlines: DataFrame, ticker: str, headline: str | None = None,
               keywords: list[str] | None = None, top_n: int = C.TOP_N,
               date_from: DateLike = None, date_to: DateLike = None,
               min_shared: int = C.MIN_SHARED) -> DataFrame:
    """One headline against one ticker: a pushed filter on the sorted index, the keywords as
    a constant, and a top-k sort."""
    if keywords is None:
        kw = text.keywords(F.lit(headline))
    else:
        kw = F.array(*[F.lit(k) for k in keywords])
    rows = within(
        headlines.filter(F.col("ticker") == text.ticker_key(F.lit(ticker))), date_from, date_to
    )
    return (
        score_overlap(rows, kw, min_shared)
        .orderBy(F.desc("shared_count"), F.desc("jaccard"), *_newest())
        .limit(top_n)
    )


_TEXTS_PER_BLOCK = 10_000
_KEYWORDS_PER_BLOCK = 4096  # queries
_NO_DAY = -(1 << 21)        # stands for a missing date, before every other day
_PAIRS = 2_000_000          # equal words of texts and queries that are counted at once


def _shared_counts(text_words, text_sizes, query_words, query_sizes, at_least: int):
    """Yields arrays (text, query, count) of pairs that share ``at_least`` words, for whole texts at a time.
    The words are numbers, and distinct within a text and within a query."""
    import numpy as np

    asked = len(query_sizes)
    order = np.argsort(query_words, kind="stable")
    known, askers = query_words[order], np.repeat(np.arange(asked), query_sizes)[order]
    left = np.searchsorted(known, text_words, "left")
    fan = np.searchsorted(known, text_words, "right") - left
    hit = fan > 0
    text, left, fan = np.repeat(np.arange(len(text_sizes)), text_sizes)[hit], left[hit], fan[hit]
    ends = np.cumsum(fan)
    start = 0
    while start < len(text):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right"))
        if stop < len(text):
            stop = int(np.searchsorted(text, text[stop]))
            stop = stop if stop > start else int(np.searchsorted(text, text[start], "right"))
        some = fan[start:stop]
        place = np.arange(some.sum()) + np.repeat(left[start:stop] - np.cumsum(some) + some, some)
        base = int(text[start])
        code = np.repeat(text[start:stop] - base, some) * asked + askers[place]
        cells = (int(text[stop - 1]) - base + 1) * asked
        if cells <= 4 * len(code):
            counts = np.bincount(code, minlength=cells)
            code = np.flatnonzero(counts >= at_least)
            counts = counts[code]
        else:
            code, counts = np.unique(code, return_counts=True)
            code, counts = code[counts >= at_least], counts[counts >= at_least]
        yield code // asked + base, code % asked, counts
        start = stop


def lexical_search(headlines: DataFrame, queries: DataFrame, top_n: int = C.TOP_N,
                   date_from: DateLike = None, date_to: DateLike = None,
                   min_shared: int = C.MIN_SHARED) -> DataFrame:
    """Many queries at once; the queries may carry their own ``date_from`` and ``date_to``.

    Headlines and queries meet as blocks of many tickers, as in :func:`similar_pairs`. Words travel as
    64-bit hashes of ticker and word, made in the JVM, so rows of different tickers share none. Per pair
    of blocks equal words are looked up and counted for all its headlines and queries together,
    and only matches that can be among a query's best ``top_n`` leave the task.
    """
    queries = queries.withColumn("ticker", text.ticker_key(F.col("ticker")))
    tickers = asked_tickers(queries)
    parts = part_count(tickers)
    own = F.array_distinct("keywords") if "keywords" in queries.columns else text.keywords(
        F.col("headline"))

    def numbers(words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(F.col("ticker"), w))

    def bound(name: str, otherwise: int) -> Column:
        if name not in queries.columns:
            return F.lit(otherwise)
        return F.coalesce(F.unix_date(name), F.lit(otherwise))

    asked = blocks(
        queries.filter(F.size(own) > 0).select(
            "ticker", "query_id", numbers(own).alias("keywords"),
            bound("date_from", _NO_DAY).alias("low"), bound("date_to", -_NO_DAY).alias("high")),
        _KEYWORDS_PER_BLOCK, parts,
    ).withColumnRenamed("ticker", "asked_ticker")
    stored = blocks(
        within(tickers_only(headlines, tickers), date_from, date_to)
        .filter(F.col("headline").isNotNull())
        .select("ticker", "headline", "sentiment_score",
                numbers(F.array_distinct(text.stored_words(F.col("headline")))).alias("words"),
                F.coalesce(F.unix_date("date"), F.lit(_NO_DAY)).alias("day")),
        _TEXTS_PER_BLOCK, parts,
    ).drop("ticker")
    schema = ("query_id long, ticker string, headline string, day int, sentiment_score double, "
              "shared_count long, all_words long")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def one(b):
            sizes, asked_sizes = (b[c].values.to_numpy().astype(np.int64) for c in ("words_n", "keywords_n"))
            words, keywords = (np.frombuffer(b[c].as_py(), np.int64) for c in ("words", "keywords"))
            days, low, high = (b[c].values.to_numpy().astype(np.int64) for c in ("day", "low", "high"))
            found = []
            for r, q, n in _shared_counts(words, sizes, keywords, asked_sizes, min_shared):
                inside = (days[r] >= low[q]) & (days[r] <= high[q])
                found.append(best(*(x[inside] for x in (r, q, n)), days, sizes, asked_sizes))
            if not found:
                return None
            r, q, n, union = best(*(np.concatenate(x) for x in list(zip(*found, strict=True))[:3]),
                                  days, sizes, asked_sizes)
            rows, asks = pa.array(r), pa.array(q)
            return pa.RecordBatch.from_arrays(
                [b["query_id"].values.take(asks).cast(pa.int64()), b["asked_ticker"].values.take(asks),
                 b["headline"].values.take(rows), b["day"].values.take(rows),
                 b["sentiment_score"].values.take(rows).cast(pa.float64()),
                 pa.array(n.astype(np.int64)), pa.array(union)],
                ["query_id", "ticker", "headline", "day", "sentiment_score", "shared_count", "all_words"])

        def best(r, q, n, days, sizes, asked_sizes):
            union = sizes[r] + asked_sizes[q] - n
            # at equal counts the smaller union has the larger ratio
            order = np.lexsort((-days[r], union, -n, q))
            r, q, n, union = r[order], q[order], n[order], union[order]
            last = np.minimum(np.searchsorted(q, q) + top_n, np.searchsorted(q, q, side="right")) - 1
            keys = np.stack([-n, union, -days[r]])
            # rows that tie with the last place stay: the headline text decides later
            keep = (np.arange(len(q)) <= last) | (keys == keys[:, last]).all(axis=0)
            return r[keep], q[keep], n[keep], union[keep]

        for batch in batches:
            for i in range(batch.num_rows):
                out = one({n: batch.column(n)[i] for n in batch.schema.names})
                if out is not None:
                    yield out

    found = stored.join(asked, "part").mapInArrow(count, schema)
    scored = found.select(
        "query_id", "ticker", "headline", "shared_count",
        F.when(F.col("day") != _NO_DAY, F.date_from_unix_date("day")).alias("date"),
        F.nanvl("sentiment_score", F.lit(None)).alias("sentiment_score"),
        (F.col("shared_count") / F.col("all_words")).alias("jaccard"),
    )
    return _match_rows(rank_lexical(scored, top_n))


# --- embedding cosine ----------------------------------------------------------

_ROWS_PER_BLOCK = 2048
_QUERIES_PER_BLOCK = 1024


def similar_pairs(corpus: DataFrame, queries: DataFrame, top_n: int | None,
                  min_similarity: float, parts: int | None = None) -> DataFrame:
    """Candidates of each query with their cosine: every headline of the query's ticker is
    compared, and only those at or above the floor that can still be among the query's
    best ``top_n`` leave the task (None: all of them).

    Both sides are joined as blocks of vectors of many tickers; within a pair of blocks, each ticker
    is one matrix product. Query blocks go to every task when Spark finds them small enough; otherwise
    blocks are shuffled, and a part with very many of them is split (adaptive skew join).
    Vectors of different lengths in both tables are an error.
    """
    parts = part_count(asked_tickers(queries)) if parts is None else parts
    known = F.col("embedding").isNotNull()
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    stored = blocks(
        corpus.filter(known).select("ticker", "headline", "date", "sentiment_score", vector),
        _ROWS_PER_BLOCK, parts,
    )
    asked = blocks(queries.filter(known).select("ticker", "query_id", vector), _QUERIES_PER_BLOCK, parts)
    asked = asked.select("part", *[F.col(c).alias(f"asked_{c}") for c in asked.columns if c != "part"])
    schema = ("query_id long, ticker string, headline string, date date, "
              "sentiment_score double, similarity double")

    def best(batches):
        import numpy as np
        import pyarrow as pa

        def side(b, prefix):
            """The vectors as a matrix, and the rows of each ticker."""
            dims = set(b[f"{prefix}embedding_n"].values.to_pylist())
            tickers = b[f"{prefix}ticker"].values.to_pylist()
            cuts = [0, *(i for i in range(1, len(tickers)) if tickers[i] != tickers[i - 1]), len(tickers)]
            flat = np.frombuffer(b[f"{prefix}embedding"].as_py(), np.float32)
            return dims, flat, {tickers[a]: slice(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True)}

        def one(b):
            dims, rows, own = side(b, "")
            asked_dims, asks, asking = side(b, "asked_")
            if len(dims | asked_dims) > 1:
                raise ValueError(f"vectors of different lengths: {sorted(dims | asked_dims)}")
            dim = dims.pop()
            left, right = (x.reshape(-1, dim).astype(np.float64) for x in (asks, rows))
            found = []
            for ticker, at in own.items():
                to = asking.get(ticker)
                if to is None:
                    continue
                sims = np.round(left[to] @ right[at].T, 12)
                floor = np.full(len(sims), min_similarity)
                if top_n is not None and sims.shape[1] > top_n:
                    # the top_n-th value; rows equal to it stay for the tie-break
                    floor = np.maximum(floor, np.partition(sims, -top_n, axis=1)[:, -top_n])
                q, r = np.nonzero(sims >= floor[:, None])
                found.append((q + to.start, r + at.start, sims[q, r]))
            if not found:
                return None
            q, r, sims = (np.concatenate(x) for x in zip(*found, strict=True))
            rows, asks = pa.array(r), pa.array(q)
            return pa.RecordBatch.from_arrays(
                [b["asked_query_id"].values.take(asks).cast(pa.int64()), b["ticker"].values.take(rows),
                 b["headline"].values.take(rows), b["date"].values.take(rows),
                 b["sentiment_score"].values.take(rows).cast(pa.float64()), pa.array(sims)],
                ["query_id", "ticker", "headline", "date", "sentiment_score", "similarity"])

        for batch in batches:
            for i in range(batch.num_rows):
                out = one({n: batch.column(n)[i] for n in batch.schema.names})
                if out is not None:
                    yield out

    found = stored.join(asked, "part").mapInArrow(best, schema)
    return found.withColumn("sentiment_score", F.nanvl("sentiment_score", F.lit(None)))


def semantic_search(corpus: DataFrame, queries: DataFrame, top_n: int = C.TOP_N,
                    date_from: DateLike = None, date_to: DateLike = None,
                    min_similarity: float = C.MIN_SIMILARITY,
                    cap: int | None = None) -> DataFrame:
    """``corpus``: headlines with unit ``embedding`` vectors; ``queries``: the same plus
    ``query_id``. All headlines are compared, unless ``cap`` asks for each ticker's newest rows
    only; those are taken before the date bounds apply."""
    queries = queries.withColumn("ticker", text.ticker_key(F.col("ticker")))
    tickers = asked_tickers(queries)
    rows = tickers_only(corpus, tickers)
    if cap is not None:
        rows = newest_per_ticker(rows, cap)
    pairs = similar_pairs(within(rows, date_from, date_to), queries, top_n, min_similarity, part_count(tickers))
    return _match_rows(rank_semantic(pairs, top_n))


# --- choice of method ------------------------------------------------------------

METHODS = ("auto", "lexical", "semantic")


class SemanticUnavailable(RuntimeError):
    """There is no model, or nothing that it has embedded."""


def search(queries: DataFrame, headlines: DataFrame, method: str = "auto",
           corpus: DataFrame | None = None, embed=None, top_n: int = C.TOP_N,
           date_from: DateLike = None, date_to: DateLike = None, **options) -> DataFrame:
    """``auto`` takes embeddings where a corpus and an embedder are given and shared words
    otherwise; ``lexical`` and ``semantic`` force one. An empty semantic result stays empty.
    The choice is made while the plan is built, and stands in the column ``method``. Only a missing model changes
    it: an embedder says so by :class:`SemanticUnavailable` or ImportError; any other failure ends the search."""
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}")
    bounds = {"top_n": top_n, "date_from": date_from, "date_to": date_to}
    if method != "lexical":
        try:
            if corpus is None or embed is None:
                raise SemanticUnavailable("no embedded corpus or no embedder")
            asked = embed(queries)
        except (SemanticUnavailable, ImportError) as error:
            if method == "semantic":
                raise
            log.warning("semantic search unavailable (%s), using shared words", error)
        else:
            return semantic_search(corpus, asked, **bounds, **options).withColumn("method", F.lit("semantic"))
    return lexical_search(headlines, queries, **bounds).withColumn("method", F.lit("lexical"))
