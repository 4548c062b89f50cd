"""Ranked search, spelling variants and word-window dedup against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from newslab.llm import letter_trie, max_sketch, super_kmers
from tests.llm.test_text_operators import docs, ids_of, prose

random.seed(11)
SYLLABLES = ["the", "an", "tion", "ing", "er", "ou", "é", "le", "Ñ", "qu", "ÿ", "on"]


def sentence(n):
    return " ".join("".join(random.choices(SYLLABLES, k=random.randrange(1, 6))) for _ in range(n))


def corpus():
    """Null, empty and long texts, copies, shared passages, odd blanks, repeated words, other scripts."""
    passage = [sentence(60) for _ in range(3)]
    out = [None, "", " \t\n ", "Word", "und " * 300, "a b " * 40, "x y " * 30, "日本語 текст", sentence(4000), "!?" * 50]
    for _ in range(60):
        t = sentence(random.randrange(1, 90)).split(" ")
        for _ in range(random.randrange(3)):
            p = random.choice(passage).split(" ")
            a = random.randrange(30)
            t += p[a:a + random.randrange(5, 40)] + sentence(random.randrange(1, 30)).split(" ")
        out.append(random.choice([" ", "  ", "\n", "\x0b\x1c "]).join(t))
    return [*out, out[20], out[20], out[21], out[22] + " end", "pre " + out[23], prose(50)]


TEXTS = corpus()


def plain_windows(rows, n=20):
    """rows: (id, text); a null id is the largest."""
    first = {}
    split = [(math.inf if i is None else i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - n + 1):
            w = tuple(words[at:at + n])
            first[w] = min(first.get(w, (math.inf, math.inf)), (i, at))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - n + 1):
            if first[tuple(words[at:at + n])] < (i, at):
                gone[at:at + n] = [True] * n
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((None if i == math.inf else i, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


KEY = lambda x: tuple((v is None, v) for v in x)


def found_windows(df, **parameters):
    return sorted([(r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)
                   for r in super_kmers.remove_repeats(df, **parameters).collect()], key=KEY)


@pytest.mark.parametrize("hot", [False, True])
def test_windows_equal_all_windows(spark, hot):
    got = found_windows(docs(spark, TEXTS), hot_share=0.0 if hot else None)  # 0: every minimiser that stands twice
    assert got == sorted(plain_windows(list(zip(ids_of(TEXTS), TEXTS))), key=KEY)
    assert sum(r[2] for r in got) > 500


def test_pieces_of_a_long_text_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(super_kmers, "PIECE", 500)
    text = sentence(3000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["id", "h", "text"])
    starts = []
    for pieces in super_kmers._pieces([batch], 20):
        for _, _, first, words in pieces:
            n = words.count(b" ") + 1
            assert words.split() == text.encode().split()[first:first + n]
            starts += range(first, first + n - 19)
    assert starts == list(range(len(text.split()) - 19)) and len(text) > 5000


def test_rows_of_one_key_and_other_columns(spark):
    same = sentence(40)
    rows = [(5, same), (5, same), (5, "first " + same), (5, same + " x"), (None, same), (None, "q " + same), (3, "w w " + same)]
    table = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, row string, h string, id string")
    assert found_windows(table) == sorted(plain_windows(rows), key=KEY)
    assert super_kmers.remove_repeats(table).select("row.*").columns == table.columns
    assert super_kmers.remove_repeats(table.limit(0)).count() == 0
    assert super_kmers.remove_repeats(table, ["id"], texts=False).select("kept_text").distinct().collect()[0][0] is None


def test_windows_whose_prints_meet_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(super_kmers, "word_hashes", lambda data, starts, stops: np.full(len(starts), 7, np.uint64))
    rows = [(i, " ".join(random.choices("ab", k=26))) for i in range(6)]
    rows += [(6, rows[1][1]), (7, "c " + rows[2][1])]
    ids, texts = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([100 + i for i in ids]), pa.array(texts)], ["id", "h", "text"])
    blocks, gone = [], []
    for out in super_kmers._packed(20, 3, np.zeros(0, np.uint64), 1)([batch]):
        for r in out.to_pylist():
            blocks += [r["packed"]] if r["packed"] else []
            gone += [] if r["packed"] else [(r["id"], r["first"], r["last"])]
    gone += [(i, a, b) for i, _, a, b in zip(*(x.tolist() for x in super_kmers.repeated_windows(blocks, 20)))]
    first = {}
    for i, t in rows:
        for at in range(len(t.split()) - 19):
            first.setdefault(tuple(t.split()[at:at + 20]), []).append((i, at))
    want = {x for places in first.values() for x in places if x != min(places)}
    assert {(i, at) for i, a, b in gone for at in range(a, b + 1)} == want and want


def plain_search(items, rows, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                 re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(split(t)), len(split(t))) for i, t in rows]
    docs, total = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, counts, n in found:
            score = 0
            for t in split(text):
                if t in counts:
                    m = 100 - 25 + (25 * n * docs) // total
                    w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=KEY)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_everything(spark, small, monkeypatch):
    if small:  # saturated sketches, several lookups in a task, several query blocks
        for name, value in (("WIDTHS", (4, 16)), ("CELLS", 64), ("QUERIES", 3)):
            monkeypatch.setattr(max_sketch, name, value)
    items = [(0, None), (1, ""), (2, "the an"), (3, TEXTS[20]), (4, TEXTS[25]), (5, "日本語 the The THE"), (6, "nowhere-else!"),
             (7, TEXTS[8]), (None, TEXTS[22]), (9, "und"), (10, "und")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    rows = list(zip(ids_of(TEXTS), TEXTS))
    got = sorted([tuple(r) for r in max_sketch.search(table, docs(spark, TEXTS)).collect()], key=KEY)
    assert got == plain_search(items, rows)
    assert max_sketch.search(table.limit(0), docs(spark, TEXTS)).count() == 0
    assert max_sketch.search(table, docs(spark, [])).count() == 0


def test_bounds_are_bounds():
    block = max_sketch.Block([(0, Counter(max_sketch.terms(TEXTS[30].encode()))), (1, Counter([b"the"] * 5))])
    block.weigh({t: 1 + len(t) * 300 for t in block.terms})
    for text in TEXTS:
        counts = Counter(max_sketch.terms((text or "").encode()))
        sketched = max_sketch.Sketched(32)
        sketched.add(1, counts, 90)
        bound = sketched.cells[0] @ block.table(32)
        for q, weights in enumerate(block.weights):
            assert bound[q] >= sum(w * max_sketch.impact(counts[t], 90) for t, w in weights.items() if t in counts)


def plain_variants(rows, least=7, slip=31, ratio=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = defaultdict(set)
    for w in n:
        for v in n:
            if w != v and edit_one(w, v):
                near[w].add(v)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slips(rows):
    """Texts in which words recur with single edits, some very long."""
    base = ["edoution", "threlyes", "Àionerque", "zzzzzzzz", "q" * 60, "ab" * 30, "onharent"]
    out = list(rows)
    for w in base:
        for times in (1, 2, 30):
            for _ in range(4):
                v = list(w)
                at = random.randrange(len(v))
                if times < 30:
                    v[at:at + 1] = random.choice([[], [random.choice("aeqzÿ")], [v[at], random.choice("aeqz")]])
                out.append(" ".join(["".join(v)] * times))
    return out


@pytest.mark.parametrize("tree, ask", [(16384, 65536), (5, 7)])
def test_variants_equal_all_pairs(spark, tree, ask, monkeypatch):
    monkeypatch.setattr(letter_trie, "near_words", lambda words, f=letter_trie.near_words: f(words, tree, ask))
    if tree == 5:
        for name, value in (("LEAF", 1), ("PAIRS", 50), ("SHARD_WORDS", 20), ("HELD", 50)):
            monkeypatch.setattr(letter_trie, name, value)
    texts = slips(TEXTS)
    got = letter_trie.spelling_variants(docs(spark, texts))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == plain_variants(zip(ids_of(texts), texts))
    assert sum(r[3] is not None for r in got) > 10
    assert letter_trie.spelling_variants(docs(spark, [])).count() == 0


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w3"), ("y", "z")]
    got = {r.word: r.root for r in letter_trie.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w17" for i in range(17)}, "x": "w17", "y": "z"}
