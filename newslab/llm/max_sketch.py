"""Ranked lexical search: hashed max-sketches bound every document's score from above, exact rescoring ranks."""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslab.llm.common import text_bytes
from newslab.session import settle

K = 20
#: Queries of one block, and the bytes of their different terms: what is sent to all tasks at once.
QUERIES, QUERY_BYTES = 256, 4 << 20
#: Coordinates of a sketch: the first of these that is at least FREE times the document's different terms, else the last.
WIDTHS = (512, 2048, 8192, 32768)
FREE = 6
#: Cells of the sketches that are looked up at once.
CELLS = 1 << 21
#: The scale of an impact, and the share of the mean length in it.
UNIT, TF, LENGTH = 1_000_000_000, 1000, 12

#: Separators are the ASCII characters that are neither letters nor digits; only A to Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def norm(n: int, docs: int, total: int) -> int:
    """A document's m, from its terms and the corpus' documents and terms."""
    return 100 - 25 + (25 * n * docs) // total


def impact(tf, m: int):
    """tf may be an array; it rises with tf."""
    return (UNIT * tf) // (TF * tf + LENGTH * m)


class Block:
    """A block of queries: for each its different terms with how often it has them."""

    def __init__(self, queries: list[tuple[int, Counter]]):
        self.queries = queries
        self.terms = sorted({t for _, counts in queries for t in counts})

    def weigh(self, weight: dict[bytes, int]) -> None:
        self.weights = [{t: n * weight[t] for t, n in counts.items() if t in weight} for _, counts in self.queries]
        self.tables: dict[int, np.ndarray] = {}

    def table(self, width: int) -> np.ndarray:
        """The queries' weights by coordinate of a sketch: (width, queries)."""
        if width not in self.tables:
            table = np.zeros((width, len(self.weights)))
            for q, weights in enumerate(self.weights):
                for term, weight in weights.items():
                    table[zlib.crc32(term) % width, q] += weight
            self.tables[width] = table
        return self.tables[width]


class Best:
    """The k best of one query so far, as rising ``(-score, id)``."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, name: int) -> None:
        if score >= self.least:
            insort(self.rows, (-score, name))
            del self.rows[self.k:]


class Sketched:
    """Documents with sketches of one width that wait for their lookup."""

    def __init__(self, width: int):
        self.width, self.docs = width, []
        self.cells = np.zeros((max(1, CELLS // width), width))

    def add(self, name: int, counts: Counter, m: int) -> bool:
        """Fold the document's impacts into coordinatewise maxima; whether no more has room."""
        at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % self.width
        np.maximum.at(self.cells[len(self.docs)], at, impact(np.fromiter(counts.values(), np.int64, len(counts)), m))
        self.docs.append((name, counts, m))
        return len(self.docs) == len(self.cells)

    def search(self, block: Block, best: list[Best]) -> None:
        """One lookup for all queries gives upper bounds; each query then rescores by falling bound until none can enter."""
        if not self.docs:
            return
        bounds = (self.cells[:len(self.docs)] @ block.table(self.width)).T * (1 + 1e-9)
        least = np.array([b.least for b in best])
        for q in np.flatnonzero((bounds >= least[:, None]).any(axis=1)).tolist():
            weights, top = block.weights[q], best[q]
            at = np.flatnonzero(bounds[q] >= least[q])
            at = at[np.argsort(-bounds[q][at], kind="stable")]
            for i, bound in zip(at.tolist(), bounds[q][at].tolist(), strict=True):
                if bound < top.least:
                    break
                name, counts, m = self.docs[i]
                top.add(sum(w * impact(counts[t], m) for t, w in weights.items() if t in counts), name)
        self.cells[:len(self.docs)] = 0
        self.docs = []


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, bounds = text_bytes(batch.column(column))
    data, ends = data.tobytes(), bounds.tolist()
    return (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _statistics(block: Block):
    """Documents with terms and terms, and the documents that hold each of the block's terms."""
    index = {t: i for i, t in enumerate(block.terms)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        held = np.zeros(len(index), np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                found = terms(text)
                docs, total = docs + bool(found), total + len(found)
                held[[index[t] for t in index.keys() & found]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()),
                                          pa.array([docs, total, *held[some].tolist()], pa.int64())], ["term", "n"])

    return work


def _search(block: Block, docs: int, total: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block.queries]
        waiting = {width: Sketched(width) for width in WIDTHS}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                width = next((w for w in WIDTHS if w >= FREE * len(counts)), WIDTHS[-1])
                if waiting[width].add(name, counts, norm(len(found), docs, total)):
                    waiting[width].search(block, best)
        for rest in waiting.values():
            rest.search(block, best)
        rows = [(number, name, -score) for (number, _), b in zip(block.queries, best, strict=True) for score, name in b.rows]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "id", "score"])

    return work


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The numbered queries' texts in blocks; the driver holds one block."""
    held, size = [], 0
    for row in queries.select("number", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if held and (len(held) == QUERIES or size + len(text) > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append((row["number"], text))
        size += len(text)
    if held:
        yield held


def search(queries: DataFrame, docs: DataFrame, k: int = K, query_key: str = "item_id", key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Rows ``(query, rank int, doc, score long)``: for each query the ``k`` documents of the highest score above 0, equal
    scores by ascending key.

    Terms are the maximal runs of letters, digits and characters beyond ASCII, A to Z lower-cased. A term's weight is
    ``floor(1000 ln((2N + 2) / (2 df + 1)))``, its impact in a document ``(10^9 tf) div (1000 tf + 12 m)`` with
    ``m = 75 + (25 n N) div L``, a score the sum of weight times impact over the query's terms, repeats included.

    Two passes over the documents for each block of queries: one counts documents, terms, and the documents that hold the
    block's terms; the other folds each document's impacts into a sketch of coordinatewise maxima over hashed
    terms. A matrix product looks the sketches up for all queries of the block at once: a bound that no score
    exceeds, as no collision lowers a maximum. Each query rescores exactly by falling bound until its k-th score is
    higher. A task gives k rows for a query; the best of them are ranked in a last step. Nothing is dropped: a
    saturated sketch (a very long text) costs rescoring only.

    Queries are a stated set; the driver holds one block of up to QUERIES of them (QUERY_BYTES of text, or one longer
    query), and the counts of its terms. Null queries and documents have no terms. Queries that are
    repeated rows are answered each; rows of one query key share ranks from 1 each on their own. Documents
    without a key come last among equal scores; repeated documents are documents of their own. Empty tables give no rows.
    """
    largest = (1 << 63) - 1
    numbered = settle(queries.select(F.col(query_key).alias("query"), F.col(text).cast("string").alias("text"))
                      .withColumn("number", F.monotonically_increasing_id()), "queries")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(largest)).alias("id"), F.col(text).cast("string").alias("text"))
    found = None
    for texts in _blocks(numbered):
        block = Block([(number, Counter(terms(t))) for number, t in texts])
        counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_statistics(block), "term long, n long")
                  .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, total = counts.get(-2, 0), counts.get(-1, 0)
        block.weigh({t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[i] + 1)))
                     for i, t in enumerate(block.terms) if i in counts})
        if total:
            part = settle(rows.mapInArrow(_search(block, n_docs, total, k), "number long, id long, score long"), "found")
            found = part if found is None else found.union(part)
    if found is None:
        found = numbered.select("number", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered, "number").select("query", "rank", F.nullif("id", F.lit(largest)).alias("doc"), "score")
