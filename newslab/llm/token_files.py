"""Token id segments with Elias-Fano coded document bounds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newslab.llm.common import by_size, spread
from newslab.llm.memo import library_encoder
from newslab.session import settle

#: A segment is closed when it holds so many ids or documents; a longer document is one of its own.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 14
#: Fixed values of the format: four letters, then version, id width, documents, ids, and length of the bounds.
MAGIC, VERSION = b"EFTK", 2
HEADER = struct.Struct("<4sBBxxIQI")
#: Ones between two samples of the select structure.
SAMPLE = 512


class EliasFano:
    """A rising sequence of n numbers below u in about n * (2 + log2(u / n)) bits.

    The low bits of all numbers stand side by side; the high parts are unary gaps in one bit string,
    in which the i-th one is at high + i. ``select`` finds it from the place of the last of every SAMPLE-th
    ones, which are stored, by counting bits from there: no table of offsets is kept or built.
    """

    HEAD = struct.Struct("<III")

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        n, top = len(numbers), int(numbers[-1]) + 1 if len(numbers) else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (numbers[:, None] >> np.arange(low_bits)) & 1
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (numbers >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low_bits, lows, np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.lows)) + b"".join(
            x.tobytes() for x in (self.samples, self.lows, self.highs))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, size = cls.HEAD.unpack_from(data)
        samples = np.frombuffer(data, "<u8", -(-n // SAMPLE), cls.HEAD.size)
        body = np.frombuffer(data, np.uint8, offset=cls.HEAD.size + samples.nbytes)
        return cls(n, low_bits, body[:size], body[size:], samples)

    def select(self, i: int) -> int:
        """The place of the i-th one among the high bits."""
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE + 1
        byte = start >> 3
        stretch = self.highs[byte:byte + SAMPLE].copy()
        stretch[0] &= 0xFF << (start & 7) & 0xFF
        while True:
            ones = np.cumsum(np.bitwise_count(stretch), dtype=np.int64)
            if ones[-1] >= left:
                break
            left, byte = left - int(ones[-1]), byte + len(stretch)  # a gap longer than the stretch
            stretch = self.highs[byte:byte + SAMPLE]
        at = int(np.searchsorted(ones, left))
        inside = np.flatnonzero(np.unpackbits(stretch[at:at + 1], bitorder="little"))
        return (byte + at) * 8 + int(inside[left - 1 - (int(ones[at - 1]) if at else 0)])

    def __getitem__(self, i: int) -> int:
        first, stop = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.lows[first >> 3:(stop + 7) >> 3].tobytes(), "little") >> (first & 7)
        return (self.select(i) - i) << self.low_bits | low & (1 << self.low_bits) - 1


def to_segment(documents: list[bytes], width: int) -> bytes:
    """A segment: header, Elias-Fano bounds (n + 1 numbers), ids of ``width`` bytes one after another."""
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum([len(d) // 4 for d in documents], dtype=np.int64)])).to_bytes()
    ids = np.frombuffer(b"".join(documents), "<u4")
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError("an id is too large for the format's width")
    return HEADER.pack(MAGIC, VERSION, width, len(documents), len(ids), len(bounds)) + bounds + ids.astype(f"<u{width}").tobytes()


class Segment:
    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_ids, size = HEADER.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token segment")
        self.bounds = EliasFano.from_bytes(data[HEADER.size:HEADER.size + size])
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, HEADER.size + size)

    def span(self, i: int) -> tuple[int, int]:
        """Where a document's ids start and stop, by two selects."""
        return self.bounds[i], self.bounds[i + 1]

    def document(self, i: int) -> np.ndarray:
        start, stop = self.span(i)
        return self.ids[start:stop]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, width: int = 2,
                      key: str = "doc_id", text: str = "text") -> None:
    """Encode documents and write them as segments, in ascending ``key`` order over all files.

    One exchange sorts the documents into ranges of (key, hash of the text, place of the row), so one
    key with very many rows is spread, too. Each task encodes its range and closes a segment every
    SEGMENT_IDS ids. A row of the table at ``path``: ``shard`` (ascending ranges), ``segment``,
    ``shard_start`` (ids of the shard before it), ``n_ids``, the keys, and the segment's bytes;
    Spark's committer writes it, so any file system serves and a lost executor leaves no half file.

    Null keys come first; equal keys are ordered by hash, repeated rows stay. A null text is
    empty: the end id alone. Other columns are ignored. An empty table makes a table without rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = ["key", "tie", "place"]
    ranged = (rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
              .repartitionByRange(spread(docs), *order).sortWithinPartitions(*order).select("key", "text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["shard", "segment", "shard_start", "n_ids", "keys", "data"]
    schema = "shard int, segment int, shard_start long, n_ids long, keys array<long>, data binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer_path, spaced=False)
        shard, segment, start, n = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        keys: list[int | None] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([to_segment(held, width)], pa.binary())], names)

        for batch in by_size(batches, 1):
            ids, bounds = encode(batch.column(1))
            ends = bounds.tolist()
            for k, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                held.append(ids[a:b].tobytes() + end)
                keys.append(k)
                n += len(held[-1]) // 4
                if n >= SEGMENT_IDS or len(held) >= SEGMENT_DOCS:
                    yield closed()
                    segment, start, n, held, keys = segment + 1, start + n, 0, [], []
        if held:
            yield closed()

    ranged.mapInArrow(work, schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the written segments alone.

    ``start`` counts the ids of all documents before. A shard's first id comes from the sums of
    the shards before it: one row per shard, which is one per task that wrote.
    """
    table = spark.read.parquet(path)
    sums = settle(table.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards")
    rows = table.join(base, "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "keys", "data")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column(2)[row].as_py())
                spans = np.array([segment.span(i) for i in range(segment.n_docs)], np.int64)
                cut = [segment.ids[a:b].astype("<u4").tobytes() for a, b in spans.tolist()]
                columns = [batch.column(1)[row].values, pa.array(spans[:, 0] + batch.column(0)[row].as_py()),
                           pa.array(spans[:, 1] - spans[:, 0]), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                columns += [pa.array(cut, pa.binary())] * ids
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return rows.mapInArrow(work, schema.add("ids", "binary") if ids else schema)
