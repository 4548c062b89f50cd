"""Removal of repeated word windows: super-k-mers travel to their minimiser's bucket, where windows are sorted."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newslab.llm.common import spread
from newslab.session import settle

WINDOW = 20
#: Words of a minimiser.
MER = 3
#: Windows in one packed string at most (a text that repeats one word has one minimiser throughout).
LONGEST = 64
#: Bytes of text that are worked on at once; longer texts are cut into pieces that share WINDOW - 1 words.
PIECE = 6 << 20
#: Buckets for each partition of the exchange; a bucket is sorted in memory.
BUCKETS = 4

_MIX, _K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_BACK = np.uint64(pow(int(_K2), -1, 1 << 64))
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def one_space(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    data = (text or "").encode().translate(_BLANKS)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of words that single spaces part."""
    stops = np.append(np.flatnonzero(data == 32), len(data))
    return np.concatenate([[0], stops[:-1] + 1]), stops


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word from its length and its first and last eight bytes. Equal words have equal numbers; the
    numbers only steer, bytes decide."""
    grams = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    size = stops - starts
    first = grams[starts].view("<u8").ravel() & _MASKS[np.minimum(size, 8)]
    last = grams[np.maximum(stops - 8, starts)].view("<u8").ravel() & _MASKS[np.where(size > 8, 8, 0)]
    return _mixed(first * _K1 ^ _mixed(last + size.astype(np.uint64) * _K3))


class Prints:
    """Polynomial fingerprints (mod 2**64) of runs of words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        steps = lambda x: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, x, np.uint64))])
        self.back = steps(_BACK)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * steps(_K2)[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def minimisers(words: np.ndarray, window: int, mer: int) -> np.ndarray:
    """The least hash of ``mer`` words in each window of ``window`` words."""
    n = len(words) - mer + 1
    least = np.zeros(n, np.uint64)
    for i in range(mer):
        least += words[i:i + n] * (_K1, _K2, _K3)[i % 3] ** np.uint64(i // 3 + 1)
    least, done, reach = _mixed(least), 1, window - mer + 1
    while done < reach:
        step = min(done, reach - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    return least


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of ``(id, h, first word's place, words)`` of up to PIECE bytes; texts below a window are left out."""
    held, size = [], 0
    for batch in batches:
        ids, prints, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, h, text in zip(ids, prints, texts, strict=True):
            words = one_space(text.as_py())
            if 2 * window - 1 > len(words):
                continue
            at = [0]
            if len(words) > PIECE:
                starts, _ = word_bounds(np.frombuffer(words, np.uint8))
                while len(words) - starts[at[-1]] > PIECE:
                    end = int(np.searchsorted(starts, starts[at[-1]] + PIECE))
                    if end + 1 >= len(starts):
                        break
                    at.append(max(end - window + 1, at[-1] + 1))
                cuts = [(a, int(starts[a]), int(starts[b + window - 1]) - 1 if b + window - 1 < len(starts) else len(words))
                        for a, b in zip(at, at[1:])] + [(at[-1], int(starts[at[-1]]), len(words))]
            else:
                cuts = [(0, 0, len(words))]
            for first, a, b in cuts:
                if size and size + b - a > PIECE:
                    yield held
                    held, size = [], 0
                held.append((i, h, first, words[a:b]))
                size += b - a
    if held:
        yield held


class Runs:
    """The super-k-mers of some pieces: runs of windows ``first`` to ``last`` that share a minimiser (``value``)."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], window: int, mer: int):
        self.bytes = b" ".join(p[3] for p in pieces)
        self.window = window
        data = np.frombuffer(self.bytes, np.uint8)
        self.starts, self.stops = word_bounds(data)
        words = word_hashes(data, self.starts, self.stops)
        self.prints = Prints(words)
        amount = np.array([p[3].count(b" ") + 1 for p in pieces], np.int64)
        self.base = np.cumsum(amount) - amount
        self.ids, self.h, self.place = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        windows = np.maximum(amount - window + 1, 0)
        piece = np.repeat(np.arange(len(pieces)), windows)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + self.base[piece]
        value = minimisers(words, window, mer)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])])[:len(at)]
        inside = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        first = np.flatnonzero(inside % LONGEST == 0)
        last = np.append(first[1:], len(at))[:len(first)] - 1
        self.take(piece[first], at[first], at[last], value[first])

    def take(self, piece: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> None:
        self.piece, self.first, self.last, self.value = piece, first, last, value

    def split(self, hot: np.ndarray) -> None:
        """Runs of hot minimisers become single windows with the window's own fingerprint for a minimiser."""
        is_hot = np.isin(self.value, hot)
        if not is_hot.any():
            return
        cold = ~is_hot
        n = (self.last - self.first + 1)[is_hot]
        piece = np.repeat(self.piece[is_hot], n)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[is_hot], n)
        self.take(np.concatenate([self.piece[cold], piece]), np.concatenate([self.first[cold], at]),
                  np.concatenate([self.last[cold], at]),
                  np.concatenate([self.value[cold], self.prints(at, at + self.window)]))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the runs' words."""
        return self.starts[self.first], self.stops[self.last + self.window - 1]

    def where(self) -> np.ndarray:
        """The runs' first words, counted in their texts."""
        return self.first - self.base[self.piece] + self.place[self.piece]

    def names(self) -> np.ndarray:
        """Fingerprints of the runs' words."""
        return self.prints(self.first, self.last + self.window)


def _hot(window: int, mer: int, share: float):
    """Minimisers that have ``share`` of the different super-k-mers of a slice, and (named null) all of the slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, window):
            runs = Runs(pieces, window, mer)
            _, one = np.unique(runs.names(), return_index=True)
            value, n = np.unique(runs.value[one], return_counts=True)
            much = n >= max(2.0, share * len(one))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*value[much].view(np.int64).tolist(), None], pa.int64()),
                 pa.array([*n[much].tolist(), len(one)], pa.int64())], ["value", "n"])

    return work


def _same_bytes(data: bytes, *bounds: np.ndarray) -> np.ndarray:
    """Whether the bytes from a to b are those from c to d, row by row."""
    return np.fromiter((data[a:b] == data[c:d] for a, b, c, d in zip(*(x.tolist() for x in bounds), strict=True)),
                       bool, len(bounds[0]))


def _merged(key: tuple[np.ndarray, ...], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text that follow each other, joined: (a row of each, first, last)."""
    order = np.lexsort((first, *key))
    first, last = first[order], last[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != last[:-1] + 1
    for k in key:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], first[at], last[np.append(at[1:], len(order))[:len(at)] - 1]


_EXCHANGED = "bucket int, packed binary, id long, h long, first long, last long"
_FOUND = "id long, h long, first long, last long"


def _gone(ids: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> pa.RecordBatch:
    row, first, last = _merged((ids, h), first, last)
    columns = [pa.array((h[row] % buckets).astype(np.int32)), pa.nulls(len(row), pa.binary()), *map(pa.array, (ids[row], h[row], first, last))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "packed", "id", "h", "first", "last"])


def _packed(window: int, mer: int, hot: np.ndarray, buckets: int):
    """Blocks of packed super-k-mers for each bucket, and windows that are known to be repeated at once.

    Of equal packed strings in a slice only the one of the least (id, place) travels: all windows of the others start
    earlier there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for pieces in _pieces(batches, window):
            runs = Runs(pieces, window, mer)
            runs.split(hot)
            if not len(runs.first):
                continue
            a, b = runs.spans()
            ids, h, place, names = runs.ids[runs.piece], runs.h[runs.piece], runs.where(), runs.names()
            amount = runs.last - runs.first + 1
            order = np.lexsort((h, place, ids, amount, names))
            new = np.concatenate([[True], np.diff(names[order]) != 0])
            start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            many = np.flatnonzero(~new)
            later, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
            if len(many):
                x, y = order[many], order[start[many]]
                same = _same_bytes(runs.bytes, a[x], b[x], a[y], b[y])
                there = (ids[x] == ids[y]) & (place[x] == place[y])
                later[x] = same & ~there
                again[x] = same & there & (h[x] == h[y])
            if later.any():
                yield _gone(ids[later], h[later], place[later], (place + amount - 1)[later], buckets)
            bucket = (runs.value % np.uint64(buckets)).astype(np.int32)
            sent = np.flatnonzero(~later & ~again)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            texts = [runs.bytes[i:k] for i, k in zip(a[sent].tolist(), b[sent].tolist(), strict=True)]
            cuts = np.flatnonzero(np.diff(bucket[sent], prepend=-1)).tolist()
            blocks = []
            for lo, hi in zip(cuts, [*cuts[1:], len(sent)], strict=True):
                at = sent[lo:hi]
                blocks.append(pack(b"".join([struct.pack("<I", hi - lo), ids[at].tobytes(), h[at].tobytes(), place[at].tobytes(),
                                             amount[at].astype("<u2").tobytes(), b" ".join(texts[lo:hi])])))
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[sent[cuts]]), pa.array(blocks, pa.binary()), none, none, none, none],
                                             ["bucket", "packed", "id", "h", "first", "last"])

    return work


def repeated_windows(blocks: list[bytes], window: int):
    """Sort the windows of a bucket's super-k-mers; ``(id, h, first, last)`` of those that start earlier elsewhere."""
    parts = []
    for block in blocks:
        data = zstandard.ZstdDecompressor().decompress(block)
        n, = struct.unpack_from("<I", data)
        columns = [np.frombuffer(data, "<i8", n, 4 + 8 * n * k) for k in range(3)]
        parts.append((*columns, np.frombuffer(data, "<u2", n, 4 + 24 * n), data[4 + 26 * n:]))
    ids, h, place, amount = (np.concatenate([p[k] for p in parts]) for k in range(4))
    amount = amount.astype(np.int64)
    text = b" ".join(p[4] for p in parts)
    data = np.frombuffer(text, np.uint8)
    starts, stops = word_bounds(data)
    words = amount + window - 1
    run = np.repeat(np.arange(len(amount)), amount)
    step = np.arange(len(run)) - np.repeat(np.cumsum(amount) - amount, amount)
    at = (np.cumsum(words) - words)[run] + step
    names = Prints(word_hashes(data, starts, stops))(at, at + window)
    # Only windows whose fingerprints meet can be equal; those are sorted by their bytes.
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], np.diff(names[order]) != 0])
    alone = new & np.append(new[1:], True)
    order, new = order[~alone], new[~alone]
    if not len(order):
        return (np.zeros(0, np.int64),) * 4
    a, b = starts[at[order]], stops[at[order] + window - 1]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    same = _same_bytes(text, a, b, a[head], b[head])
    if not same.all():  # fingerprints that met by chance
        odd = np.flatnonzero(np.isin(group, group[~same]))
        kinds: dict[bytes, int] = {}
        for i in odd.tolist():
            group[i] = kinds.setdefault(text[a[i]:b[i]], len(order) + len(kinds))
    who, where = ids[run[order]], (place[run] + step)[order]
    rank = np.lexsort((where, who, group))
    order, group, who, where = order[rank], group[rank], who[rank], where[rank]
    head = np.concatenate([[True], np.diff(group) != 0])
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (who != who[first]) | (where != where[first])
    row, low, high = _merged((who[later], h[run[order]][later]), where[later], where[later])
    return who[later][row], h[run[order]][later][row], low, high


def _sorted_buckets(window: int):
    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "h", "first", "last"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            known = batch.filter(batch.column(1).is_null())
            if known.num_rows:
                yield known.select(["id", "h", "first", "last"])
            batch = batch.filter(batch.column(1).is_valid())
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and blocks:
                    yield rows(*repeated_windows(blocks, window))
                    blocks = []
                now = bucket
                blocks.append(block)
        if blocks:
            yield rows(*repeated_windows(blocks, window))

    return work


def _cut(window: int, texts: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = one_space(text.as_py())
                n = data.count(b" ") + 1 if data else 0
                gone: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in found or []):
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], last + window)
                    else:
                        gone.append([first, last + window])
                if gone:
                    starts, stops = word_bounds(np.frombuffer(data, np.uint8))
                    ends = [0, *(x for span in gone for x in span), n]
                    data = b" ".join(data[starts[a]:stops[b - 1]] for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b)
                out.append((n, sum(b - a for a, b in gone), [{"start": a, "stop": b} for a, b in gone],
                            hashlib.sha256(data).hexdigest(), data.decode() if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["row", "n_words", "n_removed", "spans", "kept_sha256", "kept_text"])

    return work


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, key: str = "doc_id", text: str = "text",
                   window: int = WINDOW, mer: int = MER, texts: bool = True, hot_share: float | None = None) -> DataFrame:
    """Rows ``(row struct of the columns ``keep`` (all), n_words, n_removed, spans, kept_sha256, kept_text)``, one per row.

    Words are the maximal runs without ASCII white space. A word goes if a window of ``window`` words covers it whose
    words also start earlier: under a smaller ``key``, or in the same document at a smaller place. ``spans`` are
    what goes, in words; ``kept_text`` is the rest, joined by one space (null with ``texts=False``).

    Windows in a row that share a minimiser (the least hash of ``mer`` words) travel as one packed string to the
    minimiser's bucket, in blocks of a slice of the input; there all windows are sorted, by fingerprint and, where
    these meet, by bytes: the result is exact. Only runs of windows come back, and meet the texts again.

    Hot groups: of equal packed strings in a slice one travels, as the others are known to be later; so a bucket gets
    one for each slice, not one for each copy. A minimiser with a large share of all different strings (the edges of a
    very common passage) is found in a pass over all documents, and its windows travel one by one, each to the bucket of
    its own words. Its share is ``hot_share``, an eighth of a partition's; so there are at most eight times as many
    such minimisers as partitions.

    Null texts are empty. Rows of one key are one document in several parts: equal places of them are not earlier
    than each other, so equal rows are cut alike. A null key counts as the largest number. Columns outside ``keep``
    are ignored; kept ones stand in a struct, so no name can clash. An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    largest = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), largest).alias("id"), F.xxhash64(plain, F.col(key).isNull()).alias("h"),
                       plain.alias("text"), F.struct(*keep).alias("row"))
    n = spread(docs)
    share = 1 / (8 * n) if hot_share is None else hot_share
    slim = rows.select("id", "h", "text")
    counts = slim.mapInArrow(_hot(window, mer, share), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    counts = settle(counts, "minimisers")
    total = counts.where("value is null").agg(F.max("n")).first()[0] or 0
    hot = counts.where("value is not null").where(F.col("n") >= max(2.0, share * total)).select("value").collect()
    buckets = n * BUCKETS
    hot_values = np.array([r[0] for r in hot], np.int64).view(np.uint64)
    exchanged = (slim.mapInArrow(_packed(window, mer, hot_values, buckets), _EXCHANGED)
                 .repartition(n, "bucket").sortWithinPartitions("bucket"))
    found = (exchanged.mapInArrow(_sorted_buckets(window), _FOUND)
             .groupBy("id", "h").agg(F.collect_set(F.struct("first", "last")).alias("found")))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(
        "n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string, kept_text string")])
    return rows.join(found, ["id", "h"], "left").select("row", "text", "found").mapInArrow(_cut(window, texts), schema)
