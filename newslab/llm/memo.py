"""Token ids of whole texts, put together from the ids of their space-separated chunks."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in one generation of a worker's memory (some 250 bytes each); it holds two generations.
KEPT = 400_000
#: Longer chunks are encoded each time.
LONG = 64
#: How byte-level vocabularies write a byte: as itself if it is a visible Latin-1 character, else as the
#: next letter from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTER = [chr(b if b in _VISIBLE else 256 + b - sum(v < b for v in _VISIBLE)) for b in range(256)]
MARKS = frozenset(".,!?;:")


class Memory(dict):
    """Results of ``work`` by text. Once KEPT are held, they become the old generation, from which
    those asked for again are taken over; the generation before is forgotten. What ``joined`` puts together from
    other texts' results is not held."""

    def __init__(self, work: Callable, joined: Callable = lambda text: None):
        super().__init__()
        self.work, self.joined = work, joined
        self.old: dict = {}

    def __missing__(self, text: str):
        found = self.old.get(text)
        if found is None:
            found = self.joined(text)
            if found is not None:
                return found
            found = self.work(text)
        if len(text) <= LONG:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkedEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``encode(text)`` gives the ids of a text. No word of the pre-tokenizers used here reaches over a space from
    the left; so the text is cut before each space, and each chunk is encoded once per worker. A text with one of
    ``specials`` (strings that are tokens of their own) goes to ``encode`` whole.

    ``spaced``: whether a space belongs to the word after it. Then white space before a space joins into one run: a
    chunk that is empty or ends in white space sends its text to ``encode`` whole; a line break inside a chunk is a word of
    its own. Otherwise white space only parts words.
    A word of Latin-1 letters and one mark after it are words of their own, too. ``word`` encodes Latin-1 letters (after
    the space, if spaced), which need no splitting; without it they are encoded like others. Other letters go with their whole chunk, as lower-casing may part
    them in ways that depend on what follows.
    """

    def __init__(self, encode: Callable[[str], list[int]], spaced: bool, word: Callable[[str], list[int]] | None = None,
                 lowers: bool = False, specials: Iterable[str] = ()):
        self.whole = lambda text: pack(encode(text))
        self.spaced, self.lowers, self.specials = spaced, lowers, tuple(specials)

        def work(chunk: str, lead: str) -> bytes | None:
            if spaced and (not chunk or chunk[-1].isspace()):
                return None
            return pack((word if word and latin(chunk) else encode)(lead + chunk))

        def joined(chunk: str, same: Memory) -> bytes | None:
            if chunk[-1:] in MARKS and latin(chunk[:-1]):  # an empty chunk is in no set
                return same[chunk[:-1]] + self._first[chunk[-1]]
            if "\n" in chunk and (parts := chunk.split("\n")) == chunk.split():
                first, *lines = parts
                return same[first] + b"".join(self._break + self._first[line] for line in lines)

        self._break = pack(encode("\n"))
        self._first = Memory(lambda chunk: work(chunk, ""), lambda chunk: joined(chunk, self._first))
        self._later = Memory(lambda chunk: work(chunk, " "), lambda chunk: joined(chunk, self._later)) if spaced else self._first

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one text after another, and their n + 1 bounds; null is empty.

        Arrow splits the column and finds its different chunks; each is looked up once, and ids are gathered by offsets.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        flat = texts if self.spaced else pc.replace_substring(texts, "\n", " ")
        flat = pc.ascii_lower(flat) if self.lowers else flat
        split = pc.split_pattern(flat, " ")
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        ends = np.diff(split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py(), prepend=0).cumsum()
        parts = [self._later[chunk] for chunk in coded.dictionary.to_pylist()]
        if self.spaced:  # a text's first chunk has no space before it
            first, place = np.unique(index[ends[:-1]], return_inverse=True)
            index[ends[:-1]] = len(parts) + place
            parts += [self._first[chunk] for chunk in coded.dictionary.take(pa.array(first)).to_pylist()]
        whole = np.zeros(len(texts), bool)
        for special in self.specials:
            whole |= pc.match_substring(flat, special).to_numpy(zero_copy_only=False)
        missing = np.array([p is None for p in parts], bool)
        if missing.any():
            whole |= np.add.reduceat(missing[index], ends[:-1]) > 0
        keep = np.repeat(~whole, np.diff(ends))
        size = np.array([len(p or b"") // 4 for p in parts], np.int64)
        data = np.frombuffer(b"".join(p or b"" for p in parts), "<u4")
        own = size[index] * keep
        bounds = np.concatenate([[0], np.cumsum(own)])[ends]
        index, own = index[own > 0], own[own > 0]
        before = np.cumsum(own) - own
        ids = data[np.repeat((np.cumsum(size) - size)[index] - before, own) + np.arange(own.sum())]
        if not whole.any():
            return ids, bounds
        apart = [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(whole).tolist():
            apart[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        return np.concatenate(apart), np.concatenate([[0], np.cumsum([len(x) for x in apart])])


def latin(chunk: str) -> bool:
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0100")


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool) -> ChunkedEncoder:
    """The ids of the tokenizers library with ``add_special_tokens=False``: strings of special tokens in a text are these
    tokens. A worker process keeps its encoder, and what that remembers, from task to task."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize, lowers = tokenizer.model.tokenize, tokenizer.normalizer is not None

    def word(text: str) -> list[int]:
        """The library's merges alone: what its normalizer and splitter do to Latin-1 letters is these lines."""
        text = text.lower() if lowers else text
        if text.isascii():
            text = BYTE_LETTER[32] + text[1:] if text[0] == " " else text
        else:
            text = "".join(map(BYTE_LETTER.__getitem__, text.encode()))
        return [t.id for t in tokenize(text)]

    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return ChunkedEncoder(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, spaced, word, lowers, specials)
