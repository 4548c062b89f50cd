"""Removal of repeated byte strings by fixed rounds of fingerprints of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslab.llm.common import by_slice, spread, text_bytes
from newslab.session import settle

LENGTH = 400
#: A window's sampled suffix starts at the least 8-byte string among its first so many places.
REACH = 200
#: Contexts of one suffix class that are compared at once in a task (some 200 MB with what is worked out
#: from them); a larger class goes by its windows.
CLASS_ROWS = 8000
#: Bytes of text whose suffixes are sampled at once (some 70 bytes of arrays for each).
SAMPLED_BYTES = 1 << 20

_MIX, _B1, _B2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Fingerprints:
    """Polynomial fingerprints (mod 2**64) of all substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        n, base = len(data), (_B1, _B2)[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        steps = lambda x: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, x, np.uint64))])
        self.back = steps(inverse)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[which][data] * steps(base)[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * self.back[start]
        return (x ^ (x >> np.uint64(31))) * _MIX


def suffixes(data: np.ndarray, bounds: np.ndarray, length: int, reach: int):
    """Sampled suffixes ``(row, place, first, last)``: place is the leftmost least of ``reach`` 8-byte strings
    for the windows that start ``first`` to ``last`` (all in the document, ``first <= last <= place``)."""
    n = len(data)
    starts, ends = bounds[:-1], bounds[1:]
    amount = np.maximum(ends - starts - length + 1, 0)
    if n < length or not amount.any():
        return (np.zeros(0, np.int64),) * 4
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()
    gram = (gram ^ (gram >> np.uint64(29))) * _MIX
    least = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < reach:
        step = min(done, reach - done)
        after = least.copy()
        np.minimum(least[:n - step], least[step:], out=after[:n - step])
        least, done = after, done + step
    row = np.repeat(np.arange(len(starts)), amount)
    window = np.arange(len(row)) - np.repeat(np.cumsum(amount) - amount, amount) + starts[row]
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return row[new], place[new], window[new], window[last]


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, work, most: int) -> Iterator[pa.RecordBatch]:
    """Work on runs of rows with up to ``most`` bytes of text (a longer text is alone)."""
    for batch in batches:
        lengths = np.diff(text_bytes(batch.column(column))[1])
        start, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and size + n > most:
                yield work(batch.slice(start, i - start))
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield work(batch.slice(start))


def _sampled(length: int, reach: int):
    """Rows of ranks for sampled suffixes: of the two halves of the first ``length - reach + 1`` bytes, and of all
    windows of the suffix together; low and high tell how far before the suffix its windows start."""
    names = ["h1", "h2", "place", "high", "low", "rank1", "rank2", "block"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = text_bytes(batch.column(2))
        row, place, first, last = suffixes(data, bounds, length, reach)
        sure = length - reach + 1
        half = sure // 2
        prints = Fingerprints(data, 0)
        high, low = place - first, place - last
        block = Fingerprints(data, 1)(first, last + length) ^ (high * 1024 + low).astype(np.uint64) * _MIX
        h1, h2 = (batch.column(i).to_numpy()[row] for i in (0, 1))
        ranks = (prints(place, place + half), prints(place + half, place + sure), block)
        return pa.RecordBatch.from_arrays(
            [pa.array(h1), pa.array(h2), pa.array((place - bounds[:-1][row]).astype(np.int32)),
             pa.array(high.astype(np.int16)), pa.array(low.astype(np.int16)),
             *(pa.array(x.view(np.int64)) for x in ranks)], names)

    return lambda batches: by_bytes(batches, 2, one, SAMPLED_BYTES)


def _contexts(length: int):
    """One row per marked suffix that must be looked at more closely: the bytes of all its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h1, h2, text, marks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = (text or "").encode()
                out += [(m["rank"], m["rows"], h1, h2, m["place"], m["high"], m["low"], m["asks"],
                         data[m["place"] - m["high"]:m["place"] - m["low"] + length])
                        for m in marks if not m["sure"]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["rank", "rows", "h1", "h2", "place", "high", "low", "asks", "bytes"])

    return work


def _windows(table: dict, length: int):
    """All windows of context rows: (row, how far before the suffix it starts, two fingerprints)."""
    high, low = table["high"].astype(np.int64), table["low"].astype(np.int64)
    data = np.frombuffer(b"".join(table["bytes"]), np.uint8)
    sizes = np.array([len(b) for b in table["bytes"]], np.int64)
    amount = high - low + 1
    row = np.repeat(np.arange(len(high)), amount)
    step = np.arange(len(row)) - np.repeat(np.cumsum(amount) - amount, amount)
    start = (np.cumsum(sizes) - sizes)[row] + step
    return row, high[row] - step, *(Fingerprints(data, k)(start, start + length).view(np.int64) for k in (0, 1))


_NAMES = ["rank", "rows", "h1", "h2", "place", "high", "low", "asks", "bytes"]


def _as_table(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of rows with equal rank, in which a batch's end makes no cut."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        rank = table["rank"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(rank[1:] != rank[:-1]) + 1] if len(rank) else np.zeros(1, np.int64)
        if cuts[-1]:
            yield _plain(table.slice(0, cuts[-1]))
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield _plain(rest)


def _plain(table: pa.Table) -> dict:
    return {n: table[n].to_pylist() if n == "bytes" else table[n].to_numpy() for n in _NAMES}


def _compared(length: int):
    """Runs of repeated window starts for asking rows, by comparing all windows of each class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _as_table(batches):
            row, before, a, b = _windows(t, length)
            order = np.lexsort((b, a, before, t["rank"][row]))
            keys = np.stack([t["rank"][row], before, a, b])[:, order]
            group = np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))]
            weight = np.where(t["asks"][row], 1, 2)[order]
            again = (np.bincount(group, weight)[group] >= 2) & t["asks"][row][order]
            hit = order[again]
            hit = hit[np.lexsort((-before[hit], row[hit]))]
            yield _starts(row[hit], t["place"][row[hit]] - before[hit], t)

    return work


def _starts(row: np.ndarray, start: np.ndarray, t: dict) -> pa.RecordBatch:
    if not len(row):
        first = last = row
    else:
        cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1))
        first, last = np.r_[0, cut + 1], np.r_[cut, len(row) - 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(t["h1"][row[first]], pa.int64()), pa.array(t["h2"][row[first]], pa.int64()),
         pa.array(start[first], pa.int64()), pa.array(start[last], pa.int64())], ["h1", "h2", "first", "last"])


def _listed(length: int):
    """Windows of classes too large for one task, one row each."""
    names = ["rank", "before", "a", "b", "h1", "h2", "start", "asks"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            t = _plain(pa.Table.from_batches([batch]))
            row, before, a, b = _windows(t, length)
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (t["rank"][row], before, a, b, t["h1"][row], t["h2"][row],
                                       t["place"][row] - before, t["asks"][row])], names)
        return by_slice(batches, one)

    return work


def spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that windows starting in the runs cover; spans that touch are one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _cut(length: int):
    """What is left of a text, and what went."""
    names = ["h1", "h2", "n_removed", "spans", "kept_text", "kept_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, sure, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                data = (text or "").encode()
                runs = [(m["place"] - m["high"], m["place"] - m["low"]) for m in sure if m["sure"]]
                gone = spans(runs + [(r["first"], r["last"]) for r in found or []], length)
                ends = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(data) - len(kept), [{"start": a, "stop": b} for a, b in gone],
                            kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return work


_MARK = "place int, high smallint, low smallint, rank long, rows long, sure boolean, asks boolean"


def identity(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(29), text, F.lit(31)).alias("h2")


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                     reach: int = REACH, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Rows ``(h1, h2, n_removed, spans, kept_text, kept_sha256)`` for each different text of which bytes
    go: those covered by a string of ``length`` bytes that also starts elsewhere, in any text or the same.
    ``h1, h2`` are ``identity`` of the text; texts that lose nothing have no row.

    Fixed rounds of fingerprints stand in for prefix doubling: suffixes leave once theirs is unique. Not every place is a suffix: a window of ``length`` bytes is looked after by the leftmost
    least 8-byte string among its first ``reach`` places, which is the same in every copy of the window.
    Round 1 groups the pairs of ranks of the suffix's two quarter prefixes (first and second half of the
    ``length - reach + 1`` bytes that all its windows share); unique suffixes leave. Round 2 ranks those
    left by the block of all their windows: a block that stands twice makes all its windows repeated.
    Only suffixes whose classes hold different blocks (near the ends of a repeated passage) go on to round 3,
    where their windows of the full length are compared, by task for classes of up to ``class_rows``
    blocks, and by an exchange of windows for larger ones. Ranks are 128 bits of fingerprint, so equal means
    equal.

    Hot groups: counts are summed before the exchange; equal blocks of one text and equal texts are one
    row with a count after round 1; a text is fetched once however many rows hold it. Null is
    empty; texts below the length lose nothing; documents never run into each other.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hashed = rows.select("key", *identity(F.col("text")), "text")
    long = hashed.where(F.octet_length("text") >= length)
    all_ = settle(long.select("h1", "h2", "text").mapInArrow(
        _sampled(length, reach), "h1 long, h2 long, place int, high smallint, low smallint, rank1 long, rank2 long, block long"),
        "suffixes")
    # Written, so that the join's sides come straight from their exchanges and a hot pair's task can be split.
    twice = settle(all_.groupBy("rank1", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank1", "rank2"),
                   "twice")
    live = settle(
        all_.join(twice, ["rank1", "rank2"], "left_semi")
        .withColumn("rank", F.xxhash64("rank1", "rank2"))
        .groupBy("h1", "h2", "place", "high", "low", "rank", "block").agg(F.count("*").alias("n")), "suffixes")
    blocks = live.groupBy("rank", "block").agg(
        F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "place")).alias("head"))
    classes = (blocks.groupBy("rank").agg(F.count("*").alias("rows"), F.min("n").alias("least")))
    ranked = settle(blocks.join(classes, "rank"), "blocks")
    marks = (live.drop("n").join(ranked, ["rank", "block"])
             .withColumn("sure", F.col("n") > 1)
             .withColumn("head", F.struct("h1", "h2", "place") == F.col("head"))
             .withColumn("open", (F.col("rows") > 1) & (F.col("least") == 1)))
    wanted = marks.where("sure or open").select(
        "h1", "h2", F.struct("place", "high", "low", "rank", "rows", "sure", (~F.col("sure")).alias("asks"),
                             (F.col("open") & (~F.col("sure") | F.col("head"))).alias("compare")).alias("m"))
    # A sure block that is its class's example is there twice: as a run of its own, and to be compared with.
    listed = wanted.groupBy("h1", "h2").agg(F.collect_list("m").alias("m"))
    one = lambda m, sure: F.struct(*(m[c].alias(c) for c in ("place", "high", "low", "rank", "rows")),
                                   F.lit(sure).alias("sure"), m["asks"].alias("asks"))
    listed = listed.select("h1", "h2", F.concat(
        F.transform(F.filter("m", lambda m: m["sure"]), lambda m: one(m, True)),
        F.transform(F.filter("m", lambda m: m["compare"]), lambda m: one(m, False))).alias("marks"))
    owners = long.groupBy("h1", "h2").agg(F.min("key").alias("key"))
    named = listed.join(owners, ["h1", "h2"]).withColumnRenamed("key", "owner")
    texts = settle(
        long.join(named, (long["h1"] == named["h1"]) & (long["h2"] == named["h2"]) & long["key"].eqNullSafe(named["owner"]))
        .select(long["h1"], long["h2"], long["text"], "marks"), "texts")
    contexts = settle(texts.mapInArrow(
        _contexts(length), "rank long, rows long, h1 long, h2 long, place int, high smallint, low smallint, asks boolean, bytes binary"),
        "contexts")
    small = (contexts.where(F.col("rows") <= class_rows).repartition(spread(docs), "rank").sortWithinPartitions("rank")
             .mapInArrow(_compared(length), "h1 long, h2 long, first long, last long"))
    windows = contexts.where(F.col("rows") > class_rows).mapInArrow(
        _listed(length), "rank long, before long, a long, b long, h1 long, h2 long, start long, asks boolean")
    same = ["rank", "before", "a", "b"]
    again = (windows.groupBy(*same).agg(F.sum(F.when(F.col("asks"), 1).otherwise(2)).alias("weight"))
             .where("weight > 1").select(*same))
    large = (windows.where("asks").join(again, same, "left_semi")
             .select("h1", "h2", F.col("start").alias("first"), F.col("start").alias("last")))
    found = (small.union(large).groupBy("h1", "h2")
             .agg(F.collect_set(F.struct("first", "last")).alias("found")))
    # Rows of one text under one key are alike here; one of them is cut.
    return (texts.join(found, ["h1", "h2"], "left").dropDuplicates(["h1", "h2"])
            .select("h1", "h2", "text", "marks", "found")
            .mapInArrow(_cut(length), "h1 long, h2 long, n_removed long, spans array<struct<start:long,stop:long>>, "
                                      "kept_text string, kept_sha256 string")
            .where("n_removed > 0"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   reach: int = REACH) -> DataFrame:
    """Rows ``(row struct of all columns, n_bytes, n_removed, spans, kept_sha256, kept_text)``, one per input row.

    ``kept_text`` is what is left, without the rest of a character that was cut in two; the digest is of the bytes. Repeated rows stay, and, being each
    other's copies, lose all from ``length`` bytes on. The input's columns stand in a struct of their own, so no
    name can clash. An empty table gives no rows. Texts are joined by their 128-bit identity.
    """
    h1, h2 = identity(F.coalesce(F.col(text).cast("string"), F.lit("")))
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), h1, h2, F.octet_length(plain).cast("long").alias("n_bytes"),
                       F.sha2(plain, 256).alias("whole"))
    found = settle(repeated_strings(docs, key, text, length, reach), "repeats")
    return (rows.join(found, ["h1", "h2"], "left")
            .select("row", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("spans", F.array()).alias("spans"),
                    F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
                    F.coalesce("kept_text", F.col("row").getField(text).cast("string"), F.lit("")).alias("kept_text")))
