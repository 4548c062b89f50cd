"""Packing of documents into training sequences, balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newslab.llm.common import by_size
from newslab.llm.memo import library_encoder

CAPACITY = 1024
#: Document remainders that are packed together; their ids are what a task holds.
WINDOW = 4096
#: Estimated cost of a piece: LINEAR * length + QUADRATIC * length ** 2 (attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def balance(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of items no longer than ``capacity``.

    As many sequences as the tokens need are opened. Items go in descending cost to the sequence
    of lowest cost so far that has room. An item without room anywhere is cut: what is left of
    it goes to the sequences of lowest cost that are not full, so in all less than ``capacity``
    tokens stay free. Equal costs: the earlier item and the lower sequence first.
    """
    opened = -(-sum(lengths) // capacity)
    free = np.full(opened, capacity, np.int64)
    costs = np.zeros(opened)
    out = []

    def put(item: int, start: int, length: int, to: int) -> None:
        out.append((item, start, length, to, capacity - int(free[to])))
        free[to] -= length
        costs[to] += cost(length)

    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, start = lengths[item], 0
        while left:
            room = np.where(free >= left, costs, np.inf)
            to = int(room.argmin())
            if not free[to] >= left:
                to = int(np.where(free > 0, costs, np.inf).argmin())
            some = min(left, int(free[to]))
            put(item, start, some, to)
            start, left = start + some, left - some
    return out


def pack(docs: DataFrame, tokenizer_path: str, keep: list[str], end_id: int = 0, text: str = "text",
         capacity: int = CAPACITY, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """Rows ``(row struct of the columns in keep, start, length, ids_crc32, doc_tokens, sequence_id,
    offset[, ids])``, one per piece of a document; ids as little-endian unsigned 32-bit integers.

    A document's ids are the tokenizer's and ``end_id``. Whole sequences' worth of a long document
    are sequences of their own; its rest is packed with those of the same task, ``window`` at
    a time. So nothing is exchanged between tasks, a task holds ``window`` remainders, and less than
    ``capacity`` tokens per window (of several thousand sequences) are padding. A sequence id is the task's number
    and a count in it: the same if a task is run again over the same rows. Sequences shorter
    than ``capacity`` are to be padded to it, unless their length is a power of two.

    A null or empty text is the end id alone. Repeated rows are packed like any others. The kept
    columns stand in a struct of their own, so no name can clash. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    names = ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]
    kinds = [pa.int64()] * 6 + [pa.binary()] * ids
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer_path, spaced=True)
        base, opened = TaskContext.get().partitionId() << 36, 0

        def packed(held: list[tuple[bytes, int]], kept: pa.Array) -> pa.RecordBatch:
            """One window: (ids from the place on that is packed, that place), and the kept columns."""
            nonlocal opened
            source, out = [], []
            for i, (data, start, total) in enumerate(held):
                for at in range(0, start, capacity):
                    source.append(i)
                    out.append((at, capacity, data[4 * at:4 * (at + capacity)], total, base + opened, 0))
                    opened += 1
            rest = [total - start for _, start, total in held]
            last = -1
            for i, at, length, sequence, offset in balance(rest, capacity):
                data, start, total = held[i]
                source.append(i)
                out.append((start + at, length, data[4 * (start + at):4 * (start + at + length)], total,
                            base + opened + sequence, offset))
                last = max(last, sequence)
            opened += last + 1
            columns = [[o[0] for o in out], [o[1] for o in out], [zlib.crc32(o[2]) for o in out],
                       [o[3] for o in out], [o[4] for o in out], [o[5] for o in out]]
            columns += [[o[2] for o in out]] * ids
            return pa.RecordBatch.from_arrays(
                [kept.take(pa.array(source, pa.int64())),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

        return _windows(by_size(batches, 1), encode, end, window, capacity, packed)

    schema = StructType([rows.schema["row"]])
    for name in names[1:7]:
        schema = schema.add(name, "long")
    return rows.mapInArrow(work, schema.add("ids", "binary") if ids else schema)


def _windows(batches: Iterator[pa.RecordBatch], encode: Callable, end: bytes, window: int, capacity: int, packed: Callable) -> Iterator[pa.RecordBatch]:
    """Encode documents and hand them on by windows of ``window`` documents or 64 MB of ids."""
    held: list[tuple[bytes, int, int]] = []
    kept: list[pa.Array] = []
    size = 0
    for batch in batches:
        done = 0
        ids, bounds = encode(batch.column(1))
        ends = bounds.tolist()
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            data = ids[a:b].tobytes() + end
            total = len(data) // 4
            held.append((data, total // capacity * capacity, total))
            size += len(data)
            if len(held) >= window or size >= 64 << 20:
                kept.append(batch.column(0).slice(done, i + 1 - done))
                yield packed(held, pa.concat_arrays(kept))
                held, kept, size, done = [], [], 0, i + 1
        if done < batch.num_rows:
            kept.append(batch.column(0).slice(done))
    if held:
        yield packed(held, pa.concat_arrays(kept))
