"""SimHash near-duplicates: fingerprints, then shards of BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newslab.llm.common import spread
from newslab.llm.components import connected_components
from newslab.session import settle

#: Fingerprints in one tree; a larger shard is cut into several trees, each searched by all of its shard.
TREE_SIZE = 4096
#: Blocks of 16 bits; two of four are equal in any pair that differs in up to two bits.
BLOCKS = tuple(combinations(range(4), 2))


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the shingles of ``words`` words; no words: zero."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    line, starts = b" ".join(found), [0, *ends[:-1]]
    last = ends[min(words, len(found)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b - 1], 42) for a, b in zip(starts[:n], last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], words: int = 3, text: str = "text") -> DataFrame:
    """Rows ``(row struct of the columns in keep, fp long)`` of whole texts: A-Z lower-cased, words between
    ASCII white space, shingles of ``words`` words with repeats (fewer words: one shingle of all), XXH64 with
    seed 42; a bit is set if it is set in over half of them. Null and blank texts have the fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["row", "fp"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, StructType([rows.schema["row"]]).add("fp", "long"))


class BKTree:
    """A BK-tree over distinct 64-bit words: a child hangs from its parent by their Hamming distance."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.children: list[dict[int, int]] = [{} for _ in words]
        plain = words.tolist()
        for i in range(1, len(plain)):
            at = 0
            while True:
                edge = (plain[i] ^ plain[at]).bit_count()
                after = self.children[at].get(edge)
                if after is None:
                    self.children[at][edge] = i
                    break
                at = after
        self._plain = plain

    def within(self, word: int, radius: int) -> list[int]:
        """Places of the words at most ``radius`` bits away; only edges that can hold one are followed."""
        if not self._plain:
            return []
        found, open_ = [], [0]
        while open_:
            at = open_.pop()
            far = (word ^ self._plain[at]).bit_count()
            if far <= radius:
                found.append(at)
            open_ += [c for edge, c in self.children[at].items() if far - radius <= edge <= far + radius]
        return found


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """The smallest place each of n places is joined to."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_links(fps: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``(a, b)`` that join exactly the distinct words ``fp`` whose chains of neighbours at most
    ``radius`` (0 to 2) bits apart meet.

    Any such pair agrees in two of four 16-bit blocks. So every word goes to six shards, one per
    pair of blocks, keyed by their 32 bits; shards with one word fall away before anything moves.
    A shard is served by a BK-tree, which the shard's own words search. A shard of more than
    ``tree_size`` words becomes several trees, and a task holds one tree and one lot of searching
    words, so no task grows with a shard. A task returns one link per word to the
    smallest word it is joined to, not all pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks serve distances 0 to 2")
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.explode(F.array(*[
        F.struct(F.lit(n).alias("pair"), (block(i) * 65536 + block(j)).alias("value"))
        for n, (i, j) in enumerate(BLOCKS)])).alias("shard")
    words = fps.select("fp").where("fp is not null").distinct().select("fp", keys)
    shards = (words.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
              .withColumn("lots", F.ceil(F.col("n") / tree_size).cast("int")))
    lot = F.pmod(F.xxhash64("fp"), F.col("lots"))
    held = words.join(shards, "shard").withColumn("lot", lot)
    other = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    tasks = (held.select("shard", "fp", F.col("lot").alias("tree"), other.alias("query"),
                         F.lit(True).alias("in_tree"))
             .union(held.where("lots > 1").select("shard", "fp", other, "lot", F.lit(False))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            tree = group["fp"][group["in_tree"]]
            asks = group["fp"][~group["in_tree"]]
            own = group["tree"][0] == group["query"][0]
            every = np.unique(np.concatenate([tree, asks]))
            place = {w: i for i, w in enumerate(every.tolist())}
            bk = BKTree(np.unique(tree).view(np.uint64))
            pairs = ((place[w], place[t])
                     for w in (np.unique(tree) if own else asks).tolist()
                     for t in bk.words[bk.within(w & (1 << 64) - 1, radius)].view(np.int64).tolist())
            roots = np.array(_roots(len(every), pairs))
            moved = roots != np.arange(len(every))
            if moved.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[moved]), pa.array(every[roots[moved]])], ["a", "b"])

    cols = ["shard", "tree", "query"]
    return (tasks.repartition(spread(fps), *cols).sortWithinPartitions(*cols)
            .select("shard.pair", "shard.value", "tree", "query", "fp", "in_tree")
            .mapInArrow(search, "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal first four columns, over batch bounds; a run is two lots at most."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest is not None:
            cols = {n: np.concatenate([rest[n], v]) for n, v in cols.items()}
        keys = np.stack([cols[n].astype(np.int64) for n in ("pair", "value", "tree", "query")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        start = 0
        for cut in cuts.tolist():
            yield {n: v[start:cut] for n, v in cols.items()}
            start = cut
        rest = {n: v[start:] for n, v in cols.items()}
    if rest is not None and len(rest["fp"]):
        yield rest


def _grouped(docs: DataFrame, keep: list[str], words: int, radius: int, text: str) -> DataFrame:
    """Rows ``(row, fp, group)``: group is the smallest fingerprint reachable."""
    fps = settle(fingerprints(docs, keep, words, text), "fingerprints")
    groups = settle(connected_components(near_links(fps, radius)), "groups")
    named = fps.select("fp").distinct().join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    return fps.join(named.select("fp", F.coalesce("component", "fp").alias("group")), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Rows ``(doc_id, fp long, component_id)``, one per input row: component_id is the smallest
    doc_id reachable over fingerprints at most ``radius`` bits apart.

    Equal fingerprints are one word before anything is compared, whatever their number. Null and
    blank texts share the fingerprint zero and are linked like any other. A null doc_id is kept as a
    row and never is a component's name unless all its members lack one. Repeated rows stay.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = settle(_grouped(docs, [key], words, radius, text).select(F.col("row").getField(key).alias("doc_id"), "fp", "group"),
                  "grouped")
    first = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "group").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one left of each group of near-duplicates, the one of smallest doc_id
    (null last; of rows that share it, the one whose text's hash is least). All columns are kept."""
    identity = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.xxhash64(text).alias("h1"),
                        F.xxhash64(F.lit(29), text).alias("h2"))
    marked = docs.select(F.struct("*").alias("row"), identity.alias("who"), F.col(text).alias("text"))
    grouped = _grouped(marked, ["who"], words, radius, "text")
    first = settle(grouped.groupBy("group").agg(F.min("row.who").alias("first")).select("first"), "kept")
    same = (F.col("who.key").eqNullSafe(F.col("first.key")) & (F.col("who.h1") == F.col("first.h1"))
            & (F.col("who.h2") == F.col("first.h2")))
    # Rows that agree in id and text are one document stored several times.
    return (marked.join(first, same, "left_semi").dropDuplicates(["who"]).select("row.*"))
