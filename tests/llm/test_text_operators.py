"""Text operators against plain versions, with nulls, empty and repeated rows, ties and clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newslab.llm import bpe, chat, language, memo, packing, quality, queries, repeats, simhash, token_files
from newslab.session import new_table_path
from tests.check_catalog import difference

SCHEMA = "doc_id long, text string, lang string, row string, fp string, score string, h1 string, v string"
random.seed(5)
BITS = ["ab", "é", "the", "und", "x" * 9, "löng", "q", "and", "1", "of", "\n", "ing", "tion", "\t", "  ", "'s", "Σ", "語"]


def prose(n):
    return " ".join(random.choice(BITS) + random.choice(BITS) for _ in range(n))


def texts():
    shared = [prose(150) for _ in range(3)]
    out = [None, "", "   ", "abc", "und " * 300, "und " * 130, "ab" * 500, "<|endoftext|> a", "a \n b", " \n", prose(9000)]
    for _ in range(40):
        t = prose(random.randrange(5, 120))
        for _ in range(random.randrange(3)):
            t += " " + random.choice(shared)[20:20 + random.randrange(300, 600)] + " " + prose(random.randrange(5, 50))
        out.append(t)
    near = list(out[15])
    near[-20] = "#"
    return [*out, out[20], out[20], out[21], "".join(near)]


TEXTS = texts()


def docs(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame(
        [(None if i == 7 else 12 if i == 13 else i, t, ("en", "de")[i % 2], "r", "f", "s", "h", "v") for i, t in enumerate(rows)], SCHEMA)


def ids_of(d):
    return [None if i == 7 else 12 if i == 13 else i for i in range(len(d))]


def test_every_operator_takes_an_empty_table(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json"), ["doc_id"]).count() == 0
    assert bpe.encode_and_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"]).count() == 0
    model = language.train(none)
    assert language.predict(docs(spark), model, ["doc_id"]).where("lang_pred = 'und'").count() == len(TEXTS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.train(none, labels)
    assert net == 0.5 and quality.score(none, net, ["doc_id"]).count() == 0
    path = new_table_path(spark, "tokens")
    token_files.write_token_files(none, path, P.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, path).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rotation_gives_each_speaker_a_view(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "ann", "two"),
            (1, 2, "ann", "two"), (1, None, None, "first"), (None, 0, "ann", "lost"), (2, 0, "system", "alone"), (3, 300, "cy", "late")]
    t = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(t).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "cy")}
    ann = got[1, "ann"]
    assert ann.rendered == ("<|user|>\nunknown: first<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n"
                            "<|assistant|>\ntwo<|end|>\n<|user|>\nbob: <|end|>\n")
    assert [ann.rendered[m.start:m.stop] for m in ann.mask] == ["hi < |end|><|end|>", "two<|end|>"]
    assert ann.n_turns == 5 and ann.n_learnt == sum(m.stop - m.start for m in ann.mask)
    assert got[3, "cy"].part == 1


def test_rotation_cuts_parts_with_very_many_rows(spark):
    """200,000 rows without a turn number, and some turns before and after it, come in bounded rows that make up the dialogue."""
    hot = spark.range(200_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "ann").otherwise("bob").alias("role"),
                                      F.concat(F.lit("t"), "id").alias("text"))
    later = spark.createDataFrame([(1, i, "ann", "late") for i in range(300)] + [(2, 0, "ann", "x"), (2, 0, "bob", "y")],
                                  "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(hot.unionByName(later))
    ann = got.where("conv_id = 1 and perspective = 'ann'").orderBy("part", "section", "slice").collect()
    assert len({(r.part, r.section, r.slice) for r in ann}) == len(ann) > 40
    assert max(r.n_turns for r in ann) < 2 * chat.PART_ROWS and sum(r.n_turns for r in ann) == 200_300
    first, late = [r for r in ann if r.section == 0 and r.part == 0], [r for r in ann if r.part or r.section]
    lines = [x for r in first for x in re.findall(r"t([0-9]+)<", r.rendered)]
    assert sorted(map(int, lines)) == list(range(200_000))
    assert "".join(r.rendered for r in late).count("late") == 300 and late[-1].part == 1
    assert all(r.rendered[m.start:m.stop].endswith("<|end|>") for r in ann[:2] for m in r.mask[:5])
    assert {(r.section, r.slice) for r in got.where("conv_id = 2").collect()} == {(0, 0)}
    small = chat.rotate_perspectives(later, part_rows=7).where("conv_id = 1").orderBy("part", "section").collect()
    assert [r.n_turns for r in small] == [7] * 36 + [4] + [7] * 6 + [2]


def test_rotation_of_crowded_parts_equals_the_sql(spark, tmp_path):
    rows = spark.range(30_000).select(
        (F.col("id") % 3).alias("conv_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).when(F.col("id") % 7 < 6, 5).alias("turn"),
        F.when(F.col("id") % 2 == 0, "ann").otherwise("").alias("role"), F.concat(F.lit("t"), F.col("id") % 9000).alias("text"))
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["op1_perspective_rotation"](spark, str(tmp_path)).toPandas()
    assert got.slice.max() > 0 and got.section.max() > 0
    assert difference(got, con.execute(queries.ORACLES["op1_perspective_rotation"]).df()) is None


def plain_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(words, radius):
    """Smallest place reachable over words at most radius bits apart."""
    label = list(range(len(words)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_equals_all_pairs(spark):
    want = [plain_fingerprint(t) for t in TEXTS]
    ids = ids_of(TEXTS)
    groups = plain_groups(want, 2)
    least = {g: min((i for i, k in zip(ids, groups) if k == g and i is not None), default=None) for g in set(groups)}
    got = simhash.near_duplicates(docs(spark)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got], key=key) == sorted(
        [(i, w, least[g]) for i, w, g in zip(ids, want, groups)], key=key)
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(set(groups))


@pytest.mark.parametrize("tree_size", [4096, 8])
def test_trees_link_what_all_pairs_link(spark, tree_size):
    r = np.random.default_rng(2)
    base = [int(x) for x in r.integers(0, 2 ** 64, 30, np.uint64)]
    words = sorted({b ^ sum(1 << int(k) for k in r.choice(64, int(r.integers(0, 4)), replace=False)) for b in base for _ in range(6)})
    fps = spark.createDataFrame([(w - 2 ** 64 if w >> 63 else w,) for w in words], "fp long")
    from newslab.llm.components import connected_components
    found = {r.node % 2 ** 64: r.component for r in connected_components(simhash.near_links(fps, 2, tree_size)).collect()}
    label = plain_groups(words, 2)
    assert set(found) == {w for w, g in zip(words, label) if label.count(g) > 1}
    mine = {}
    for w, g in zip(words, label):
        mine.setdefault(g, set()).add(found.get(w, w))
    assert all(len(v) == 1 for v in mine.values()) and len({min(v) for v in mine.values()}) == len(mine)


def plain_repeats(all_texts, n=400):
    seen = {}
    for t in all_texts:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            seen[b[i:i + n]] = seen.get(b[i:i + n], 0) + 1
    out = []
    for t in all_texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((t, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("class_rows", "length", "reach"), [(8000, 400, 200), (2, 400, 200), (8000, 240, 150)])
def test_repeats_equal_all_windows(spark, class_rows, length, reach, monkeypatch):
    whole = repeats.repeated_strings
    monkeypatch.setattr(repeats, "repeated_strings", lambda *a: whole(*a, class_rows=class_rows))
    got = repeats.remove_repeats(docs(spark), length=length, reach=reach).collect()
    key = lambda x: (x[0] or "", x[0] is None)
    assert sorted([(r.row.text, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got],
                  key=key) == sorted(plain_repeats(TEXTS, length), key=key)


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids_equal_the_library(file, spaced):
    library = Tokenizer.from_file(P.path(file))
    encode = memo.library_encoder(P.path(file), spaced)
    marks = [*BITS, " ", " ", "\x85", "\x1c", "İ", "é", " ́", "<|endoftext|>", ".", "Straße,", "ª", "B", " "]
    def letter():
        return chr(random.choice([random.randrange(32, 127), random.randrange(160, 592), random.randrange(768, 880),
                                  random.randrange(880, 1424), random.randrange(0x1E00, 0x2070), random.randrange(0x3040, 0x3100)]))

    made = ["".join(random.choice(marks) for _ in range(random.randrange(25))) for _ in range(3000)]
    made += ["".join(random.choice([" ", "\n", ".", "İ", "a", letter(), letter()]) for _ in range(random.randrange(25)))
             for _ in range(8000)]
    made += ["x İ!", "TARİHİ, SERİ.", "a <|endoftext|> b", "a<|endoftext|>.\nb", "a\n\nb \n c\n", "one.\nTwo,\nthree", "a\r\nb"]
    ids, bounds = encode(pa.array([None, "", *made])[1:])
    assert bounds[0] == bounds[1] == 0 and len(bounds) == len(made) + 2 and bounds[-1] == len(ids)
    for t, a, b in zip(made, bounds[1:-1], bounds[2:], strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert [len(x) for x in encode(pa.array([], pa.string()))] == [0, 1] and encode(pa.array([None, "a"]))[1].tolist() == [0, 0, 1]


def test_prefix_tables_append_and_edit():
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, codec = bpe.PrefixEncoder(ranks), bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(200):
        a, b = (bytes(random.choice(b"abeilnrstuth") for _ in range(random.randrange(12))) for _ in range(2))
        table = own.append(a, b, own.table(a))
        assert table == own.table(a + b)
        if a + b:
            assert own.ids(a + b, table) == own.merged(a + b) == library.encode_ordinary((a + b).decode())
        at = random.randrange(len(a + b) + 1)
        new, edited = own.edit(a + b, table, at, min(at + 2, len(a + b)), b"ing")
        assert edited == own.table(new)
    every, bounds = codec.encode(pa.array(TEXTS))
    for t, a, b in zip(TEXTS, bounds, bounds[1:], strict=False):
        ids = every[a:b]
        assert ids.tolist() == library.encode_ordinary(t or "") and codec.decode(ids).decode() == (t or "")
    odd = ["a\n\nb\n", "one.\nTwo,\nthree", "a\r\nb", "x İ!", "'s\n's", *("".join(random.choices(["\n", "a", " ", ".", "1", "é"], k=9)) for _ in range(500))]
    every, bounds = codec.encode(pa.array(odd))
    assert [every[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in odd]


def test_bpe_rows(spark):
    rows = bpe.encode_and_decode(docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id", "text", "row"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        data = (r.row.text or "").encode()
        assert bytes(r.decoded) == data and r.decoded_sha256 == hashlib.sha256(data).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.n_tokens == len(r.ids) // 4


def test_packing_places_every_id_once(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs(spark).coalesce(2), P.path("byte_bpe_50k.json"), ["doc_id", "text"], window=16).collect()
    by_text, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_text.setdefault(r.row.text, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for t, pieces in by_text.items():
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        got = [0] * len(want)
        for p in pieces:
            assert p.doc_tokens == len(want)
            got[p.start:p.start + p.length] = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert got == want and sum(p.length for p in pieces) == len(want) * TEXTS.count(t)
    free = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        free += 1024 - at
    assert free < 1024 * 2 * (len(TEXTS) // 16 + 1)


def test_balance_fills_and_levels_cost():
    lengths = [random.randrange(1, 1024) for _ in range(500)]
    pieces = packing.balance(lengths)
    assert max(p[3] for p in pieces) + 1 == -(-sum(lengths) // 1024)
    assert sum(p[2] for p in pieces) == sum(lengths)


@pytest.mark.parametrize("n", [0, 1, 5, 2000])
def test_elias_fano_round_trip(n):
    for gap in (2, 5000):
        want = np.cumsum(np.random.default_rng(n).integers(0, gap, n))
        coded = token_files.EliasFano.from_bytes(token_files.EliasFano.of(want).to_bytes())
        assert want.tolist() == [coded[i] for i in range(n)]
    far = np.array([0, 7, 10 ** 6, 10 ** 6, 10 ** 8])
    assert [token_files.EliasFano.of(far)[i] for i in range(5)] == far.tolist()
    if n:
        steps = np.concatenate([np.arange(1500), 10 ** 7 + np.arange(1500) * 3])
        coded = token_files.EliasFano.of(steps)
        assert [coded[i] for i in range(3000)] == steps.tolist() and len(coded.samples) == 6


def test_token_files_read_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", 7)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = new_table_path(spark, "tokens")
    token_files.write_token_files(docs(spark), path, P.path("word_bpe_49k.json"))
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [
        -1 if r.doc_id is None else r.doc_id for r in rows] == sorted((i if i is not None else -1) for i in ids_of(TEXTS))
    at = 0
    for r in rows:
        assert r.start == at and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS)
    assert sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows) == want


def crc(i):
    return zlib.crc32(str(i).encode())


def test_held_out_quality_and_language(spark):
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    net = quality.train(table, labels.where("crc32(string(doc_id)) % 5 <> 0"))
    found = quality.score(table, net, ["doc_id", "lang"]).select("row.doc_id", "score").join(labels, "doc_id").collect()
    held = [(r.score >= 0.3, r.quality) for r in found if crc(r.doc_id) % 5 == 0]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.mean([p for p, q in held if q]) > 0.98
    model = language.train(table.where("crc32(string(doc_id)) % 3 <> 1"))
    rows = language.predict(table, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang_pred == r.row.lang for r in rows if crc(r.row.doc_id) % 3 == 1]) > 0.97


def test_models_take_odd_texts(spark):
    odd = docs(spark, [None, "", "  12 3", "a", "x" * 300_000, "\U0001f600"])
    net = quality.fit([b"good words here " * 20, b"### $$$ " * 40] * 4, np.array([1, 0] * 4), epochs=2)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, net, odd.columns).collect())
    data = b"the cat sat " * 9 + b"der hund lag " * 9
    model = language.fit(language.features(np.frombuffer(data, np.uint8), np.array([0, 108, 225])), ["en", "de"])
    got = [r.lang_pred for r in language.predict(odd, model, odd.columns).collect()]
    assert got[:3] == ["und"] * 3 and got[5] == "und" and {got[3], got[4]} <= {"en", "de"}


def test_codewords_stay_apart():
    for n in (2, 4, 7, 20):
        code = language.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else 2)


def test_features_do_not_depend_on_the_piece(monkeypatch):
    parts = [(t or "").encode() for t in TEXTS]
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    whole = language.features(data, bounds)
    one = np.concatenate([language.features(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in parts])
    assert np.allclose(whole, one)
    for piece in (1, 7, 4096):
        monkeypatch.setattr(language, "PIECE", piece)
        some = slice(0, len(parts) if piece > 7 else 9)
        got = language.features(data[:bounds[some.stop]], bounds[:some.stop + 1])
        assert np.array_equal(got, whole[some])


def test_blocks_hold_whole_texts():
    parts = [(t or "").encode() for t in TEXTS]
    bounds = np.cumsum([0, *map(len, parts)])
    flat, ends = quality.laid_out(np.frombuffer(b"".join(parts), np.uint8), bounds)
    for p, a, b in zip(parts, ends[:-1] * quality.BLOCK, ends[1:] * quality.BLOCK, strict=True):
        assert bytes(flat[a:b]) == p + bytes(b - a - len(p)) and b - a - len(p) >= quality.WIDTH - 1
