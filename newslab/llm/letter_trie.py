"""Spelling variants: a trie over letter-group counts finds words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslab.llm.common import spread
from newslab.session import settle

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Letter groups, and how many of their counts name a word's shard: SHARD up to SHARD_WORDS words, one more for every
#: four times as many.
GROUPS, SHARD, SHARD_WORDS = 14, 4, 1_000_000
#: Words of one trie, and words that ask in it at once.
TREE, ASK = 16384, 65536
#: Words that a task counts before it hands them on.
HELD = 400_000
#: A node of so many words is a leaf; pairs that are verified at once; longer words are compared one by one.
LEAF, PAIRS, LONG = 24, 1 << 17, 48

#: Latin letters by falling frequency, dealt to the groups in turn; other letters by code point.
_ORDER = "etaoinsrhldcumfpgwybvkxjqz"
_GROUP = np.arange(1 << 16) % GROUPS
_GROUP[[ord(c) for c in _ORDER]] = np.arange(len(_ORDER)) % GROUPS
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str, key: int | None, least: int = LEAST_LENGTH, slip: int = 31) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts: runs of letters, of which some lack a letter (by the hash of key and run)."""
    name = "" if key is None else key
    for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % least, text)).items():
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(f"{name}:{word}".encode())
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        yield word, n


def _counted(least: int, slip: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(text.as_py() or "", key, least, slip):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return work


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the words' bounds in them."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return data, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts: (words, GROUPS)."""
    data, bounds = letters(words)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    return np.bincount(row * GROUPS + _GROUP[data], minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _shard(counts: np.ndarray) -> np.ndarray:
    """A number for rows of counts; equal rows have equal numbers."""
    name = np.zeros(len(counts), np.int64)
    for column in counts.T:
        name = name * 1_000_003 + column
    return name


def _moves(levels: int) -> np.ndarray:
    """What one edit can do to the first counts: nothing, one more, one less, or one of each."""
    unit = np.eye(levels, dtype=np.int64)
    return np.array([np.zeros(levels, np.int64), *unit, *-unit, *(a - b for a in unit for b in unit if (a != b).any())])


def _dealt(levels: int):
    """Every word once as a trie's word, in its own shard, and once in each shard that an edit may lead to.

    Links are found from one side: in a shard of a larger number, or in the own one.
    """
    moves = _moves(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = vectors(words)[:, :levels]
            own = _shard(counts)
            rows, shards = [np.arange(len(words))], [own]
            for move in moves:
                there = counts + move
                name = _shard(there)
                at = np.flatnonzero((there >= 0).all(axis=1) & (name >= own))
                rows.append(at)
                shards.append(name[at])
            row = pa.array(np.concatenate(rows))
            asks = np.repeat([False, True], [len(words), len(row) - len(words)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(asks), batch.column(0).take(row),
                                              batch.column(1).take(row)], ["shard", "asks", "word", "n"])

    return work


def search_trie(trie: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``asked``, row of ``trie``) whose counts differ by at most one surplus and one deficit.

    The trie is the sorted rows: a node is a range of rows that agree in their first counts, its children are the
    runs of equal next counts. The depth-first search takes all asking rows down together; a child keeps
    those with its count, and those one above or below that still have their surplus or deficit.
    """
    order = np.lexsort(trie.T[::-1])
    trie = trie[order]
    n = np.arange(len(asked))
    stack = [(0, 0, len(trie), n, np.zeros(len(n), bool), np.zeros(len(n), bool))]
    while stack:
        level, low, high, who, more, less = stack.pop()
        if not len(who):
            continue
        if high - low <= LEAF or level == trie.shape[1]:
            step = max(1, PAIRS // (high - low))
            for at in range(0, len(who), step):
                part = slice(at, at + step)
                apart = asked[who[part], None, level:] - trie[None, low:high, level:]
                good = ((np.maximum(apart, 0).sum(axis=2) + more[part, None] <= 1)
                        & (np.maximum(-apart, 0).sum(axis=2) + less[part, None] <= 1))
                a, b = np.nonzero(good)
                yield who[part][a], order[low + b]
            continue
        column, mine = trie[low:high, level], asked[who, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low], strict=True):
            apart = mine - column[a]
            keep = (apart == 0) | ((apart == 1) & ~more) | ((apart == -1) & ~less)
            if keep.any():
                stack.append((level + 1, low + a, low + b, who[keep], (more | (apart == 1))[keep], (less | (apart == -1))[keep]))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[low + (len(a) == len(b)):] == b[low + 1:]


class Words:
    """Words as a matrix of code points, to verify many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        short = [w if len(w) <= LONG else "" for w in words]
        data, bounds = letters(short)
        sizes = np.diff(bounds)
        self.cells = np.zeros((len(words), LONG + 1), np.int32)
        row = np.repeat(np.arange(len(words)), sizes)
        self.cells[row, np.arange(len(data)) - bounds[row]] = data

    def verify(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows with lengths at most one apart: whether one edit parts them."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        x, y, short, long = self.cells[a], self.cells[b], self.size[a], self.size[b]
        differ = x != y
        low = np.where(differ.any(axis=1), differ.argmax(axis=1), LONG + 1)
        # After the first difference: the rest agrees in place, or one place on.
        beyond = np.arange(LONG + 1) > low[:, None]
        same = ~(differ & beyond).any(axis=1) & (short == long) & (low <= LONG)
        moved = np.zeros_like(differ)
        moved[:, 1:] = x[:, :-1] != y[:, 1:]
        inserted = ~(moved & beyond).any(axis=1) & (long == short + 1)
        out = same | inserted
        for i in np.flatnonzero(long > LONG).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def _linked(levels: int):
    """For the words of a trie and those asking in it: how many are near, and the most frequent of these."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            words, n, asks = group["word"], group["n"], group["asks"]
            if not asks.any() or asks.all():
                continue
            counts, table = vectors(words), Words(words)
            own = _shard(counts[:, :levels]) == group["shard"]
            rank = {w: i for i, w in enumerate(sorted(set(words)))}
            place = np.array([rank[w] for w in words], np.int64)
            tree, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in search_trie(counts[tree], counts[asking]):
                a, b = asking[a], tree[b]
                once = ~own[a] | (place[a] < place[b])
                a, b = a[once], b[once]
                good = table.verify(a, b)
                ends.append((a[good], b[good]))
            if not sum(len(a) for a, _ in ends):
                continue
            x = np.concatenate([np.concatenate(e) for e in ends])
            y = np.concatenate([np.concatenate(e[::-1]) for e in ends])
            order = np.lexsort((place[y], -n[y], place[x]))
            x, y = x[order], y[order]
            cut = np.flatnonzero(np.diff(place[x], prepend=-1))
            near = np.diff(cut, append=len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in x[cut]], pa.string()), pa.array(near, pa.int64()), pa.array(n[y[cut]], pa.int64()),
                 pa.array([words[i] for i in y[cut]], pa.string())], ["word", "near", "best_n", "best"])

    return work


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of rows with equal shard, tree and lot, over batch bounds."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([table[c].to_numpy() for c in ("shard", "tree", "lot")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _plain(table.slice(a, b - a))
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield _plain(rest)


def _plain(table: pa.Table) -> dict:
    return {"word": table["word"].to_pylist(), **{c: table[c].to_numpy() for c in ("shard", "n", "asks")}}


def near_words(words: DataFrame, tree: int = TREE, ask: int = ASK) -> DataFrame:
    """Rows ``(word, n_near, best, best_n)`` for each of ``words(word, n)`` with a word one edit away: how many there are, and the
    most frequent one (ties: the least in code-point order).

    An edit adds one to at most one letter-group count and takes one from at most one. The first SHARD counts (more
    for more words) name a shard; a word is in one trie, and asks in every shard that an edit can lead to (of a pair only one side asks).
    A shard of more than ``tree`` words is several tries, and what asks in it comes in lots of ``ask``; each trie meets
    each lot in a task of its own, so no shard is a hot key.
    """
    levels = SHARD
    amount = words.count()
    while levels < GROUPS and amount > SHARD_WORDS << 2 * (levels - SHARD):
        levels += 1
    dealt = settle(words.mapInArrow(_dealt(levels), "shard long, asks boolean, word string, n long"), "dealt")
    size = dealt.groupBy("shard").agg(F.count(F.when(~F.col("asks"), 1)).alias("held"), F.count(F.when(F.col("asks"), 1)).alias("asked"))
    lots = size.where("held > 0").select("shard", F.ceil(F.col("held") / tree).cast("int").alias("trees"),
                                         F.ceil(F.col("asked") / ask).cast("int").alias("lots"))
    rows = dealt.join(lots, "shard")
    h = F.xxhash64("word")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = rows.where("not asks and lots > 0").withColumn("tree", F.pmod(h, "trees").cast("int")).withColumn("lot", each(F.col("lots")))
    asked = rows.where("asks").withColumn("lot", F.pmod(h, "lots").cast("int")).withColumn("tree", each(F.col("trees")))
    cols = ["shard", "tree", "lot"]
    columns = [*cols, "asks", "word", "n"]
    met = kept.select(columns).union(asked.select(columns)).repartition(spread(words), *cols).sortWithinPartitions(*cols)
    found = met.mapInArrow(_linked(levels), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` for ``forms(word, form)``: the last word that forms lead to. Each round doubles the steps; as
    a form is ten times as frequent as its word, there are 18 steps at most."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = settle(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").limit(1).count() == 0:
            return now.select("word", "root")
        now = now.select("word", "root")


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, slip: int = 31) -> DataFrame:
    """Rows ``(word, n)``: words of whole texts that occur ``least_count`` times. Tasks count before the exchange."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return (rows.mapInArrow(_counted(least_length, slip), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO,
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = 31) -> DataFrame:
    """Rows ``(word, n, n_near, form, form_n, root)``, one per word.

    Words are runs of Latin letters of whole texts, A to Z lower-cased; a run whose crc32 of ``<key>:<run>`` the number ``slip``
    divides loses one letter. Two words are near if one inserted, deleted or replaced code point parts them. ``form`` is the
    near word that occurs most (ties: least in code-point order), if ``ratio`` times as often as the word; ``root`` is
    where forms lead to in the end, the word itself if it has none.

    Null texts have no words, a null key is written as nothing, repeated rows count again, other columns are ignored. An empty
    table gives no rows.
    """
    words = settle(count_words(docs, key, text, least_length, least_count, slip), "words")
    near = settle(near_words(words), "near")
    forms = near.join(words, "word").where(F.col("best_n") >= ratio * F.col("n")).select("word", F.col("best").alias("form"))
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    form_n = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n"))
    return (words.join(near, "word", "left").join(roots(forms), "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
                    form_n.alias("form_n"), F.coalesce("root", "word").alias("root")))
