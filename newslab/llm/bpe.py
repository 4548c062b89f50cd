"""Byte-level BPE by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newslab.llm.common import by_size
from newslab.llm.memo import KEPT, ChunkedEncoder, Memory

#: Greater than any rank.
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """BPE of one piece of bytes by the last token of each of its prefixes.

    The BPE of a prefix is the BPE of a shorter prefix and one last token, and a token sequence is
    the BPE of its bytes if and only if each two neighbours are the BPE of theirs. So for every
    prefix exactly one last token fits: its bytes end the prefix, and it goes with the last token
    of what stands before it. Prefixes never change by what follows, so a table is extended at its
    end (``append``) and an edit keeps the table up to its place (``edit``).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._goes: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """BPE by its definition: merge the neighbours of least rank, leftmost first, while any merge."""
        parts, rank_of = [piece[i:i + 1] for i in range(len(piece))], self.ranks.get
        pairs = [rank_of(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < NONE:
            i = pairs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], NONE)
        return [self.ranks[p] for p in parts]

    def goes(self, a: int, b: int) -> bool:
        """Whether the BPE of two tokens' bytes is these two tokens."""
        found = self._goes.get((a, b))
        if found is None:
            if len(self._goes) >= KEPT:
                self._goes.clear()
            found = self._goes[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def append(self, piece: bytes, more: bytes, table: list[int]) -> list[int]:
        """The table of ``piece + more`` from the table of ``piece``: a last token for each prefix."""
        piece, table, ranks = piece + more, list(table), self.ranks
        for end in range(len(table) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (start == 0 or self.goes(table[start - 1], token)):
                    table.append(token)
                    break
            else:
                raise ValueError("the ranks lack a single byte")
        return table

    def table(self, piece: bytes) -> list[int]:
        return self.append(b"", piece, [])

    def edit(self, piece: bytes, table: list[int], start: int, stop: int,
             new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``piece[start:stop]``; only prefixes that reach beyond ``start`` are worked out again."""
        kept = piece[:start]
        return kept + new + piece[stop:], self.append(kept, new + piece[stop:], table[:start])

    def ids(self, piece: bytes, table: list[int]) -> list[int]:
        """The tokens of the whole piece, read back from its end."""
        out, end = [], len(piece)
        while end:
            out.append(table[end - 1])
            end -= len(self.tokens[table[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a token is its own BPE, as the rank libraries have it
        return [whole] if whole is not None else self.ids(piece, self.table(piece))


class Codec:
    """Texts to ids and back: each match of the pattern is encoded by itself."""

    def __init__(self, ranks_path: str, pattern: str):
        self.encoder = PrefixEncoder(read_ranks(ranks_path))
        self.pattern = regex.compile(pattern)
        self._pieces = Memory(lambda piece: self.encoder.encode(piece.encode()))
        self.encode = ChunkedEncoder(self._text, spaced=True)
        size = max(self.encoder.tokens) + 1
        self.bytes_of = np.array([self.encoder.tokens.get(i, b"") for i in range(size)], object)

    def _text(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self._pieces[piece]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """A worker process keeps its codec, and what that remembers, from task to task."""
    return Codec(ranks_path, pattern)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str],
                      text: str = "text", outputs: bool = True) -> DataFrame:
    """Rows ``(row struct of the columns in keep, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])``.

    ids are little-endian unsigned 32-bit integers, decoded the bytes that the ids stand for; without
    ``outputs`` only their digests leave the task. Special tokens' strings are ordinary text. A null
    text is empty; an empty one has no ids and the digests of nothing. Repeated rows stay. The kept
    columns stand in a struct of their own, so no name can clash. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * outputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in by_size(batches, 1):
            every, bounds = own.encode(batch.column(1))
            ids = [every[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            back = [own.decode(np.frombuffer(x, "<u4")) for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            if outputs:
                columns += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (StructType([rows.schema["row"]]).add("n_tokens", "long").add("ids_sha256", "string")
              .add("decoded_sha256", "string"))
    if outputs:
        schema = schema.add("ids", "binary").add("decoded", "binary")
    return rows.mapInArrow(work, schema)
