"""Language ID by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newslab.llm.common import by_slice, text_bytes
from newslab.session import settle

#: Features: hashed byte pairs and triples.
PAIRS, TRIPLES = 1024, 2048
#: Bound of the training sample, of which the driver holds feature vectors (12 KB each).
TRAIN_ROWS = 3000
#: A decision is ambiguous if the two best losses are closer than this.
GAP = 0.05
#: Bytes that are counted at once, so that a very long text needs no more memory than others.
PIECE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unit vectors of square roots of n-gram counts, over the whole of each text."""
    n = len(bounds) - 1
    out = np.zeros((n, PAIRS + TRIPLES), np.float32)
    for start in range(0, len(data) if n else 0, PIECE):
        for gram, size, at in ((2, PAIRS, 0), (3, TRIPLES, PAIRS)):
            # A piece ends with the last n-gram that starts in it.
            stop = min(len(data), start + PIECE + gram - 1)
            low = _LOWER[data[start:stop]].astype(np.uint32)
            if len(low) < gram:
                continue
            row = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.clip(bounds, start, stop)))
            code = low[:len(low) - gram + 1] * np.uint32(2654435761)
            for k in range(1, gram):
                code = (code + low[k:len(low) - gram + 1 + k]) * np.uint32(2654435761)
            whole = row[:len(code)] == row[gram - 1:]
            cell = row[:len(code)] * size + (code >> np.uint32(32 - size.bit_length() + 1)).astype(np.int64)
            out[:, at:at + size] += np.bincount(cell[whole], minlength=n * size).reshape(n, size)
    np.sqrt(out, out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Rows of +1 and -1, one per class: all splits in two for up to 7 classes, else the random
    code of 100 tries whose closest two words are farthest apart."""
    if n <= 7:
        bits = [[1 if k == 0 or not split >> (k - 1) & 1 else -1 for k in range(n)]
                for split in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float32).reshape(-1, n).T
    r, best, least = np.random.default_rng(seed), None, -1
    long = 15 * int(np.ceil(np.log2(n)))
    for _ in range(100):
        code = r.choice([-1.0, 1.0], (n, long)).astype(np.float32)
        apart = (long - code @ code.T) / 2 + long * np.eye(n)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    """``langs`` sorted; ``code`` and ``trust`` by language and bit; a linear classifier per bit."""

    langs: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity of feature rows.

        The loss of a language sums log(1 + exp(-bit * margin)) over its bits, each weighted by how
        often the bit's classifier was right for that language in training. The score is the share
        of exp(-loss * bits) among languages. Ambiguous: two losses within GAP, or more wrong bits
        than the code can correct.
        """
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * t).sum(axis=1)
                         for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        order = np.sort(loss, axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - order[:, :1]) * max(1, self.code.shape[1]))
        score = 1 / share.sum(axis=1)
        close = (order[:, 1] - order[:, 0] < GAP) if loss.shape[1] > 1 else np.zeros(len(x), bool)
        least = min(((a != b).sum() for i, a in enumerate(self.code) for b in self.code[:i]), default=0)
        wrong = (np.sign(margin) != self.code[best]).sum(axis=1)
        return best, score, close | (wrong > max(0, (least - 1) // 2))


def fit(x: np.ndarray, langs: list[str], rounds: int = 150) -> Model:
    """One logistic regression per bit, all bits at once, by gradient steps with momentum."""
    names = sorted(set(langs))
    code = codewords(len(names)) if names else np.zeros((0, 0), np.float32)
    bits = code.shape[1]
    place = {v: i for i, v in enumerate(names)}
    which = np.array([place[v] for v in langs], np.int64)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if bits:
        want = code[which]
        fair = (len(which) / len(names) / np.bincount(which))[which][:, None].astype(np.float32)
        v, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            g = -want * fair / (1 + np.exp(np.clip(want * (x @ w + b), -30, 30))) / len(x)
            v = 0.9 * v - 8.0 * (x.T @ g + 1e-5 * w)
            vb = 0.9 * vb - 8.0 * g.sum(axis=0)
            w, b = w + v, b + vb
        right = np.stack([((x[which == i] @ w + b) * code[i] > 0).mean(axis=0) for i in range(len(names))])
        trust = (right + 0.01) / (right + 0.01).sum(axis=1, keepdims=True)
    else:
        trust = np.zeros_like(code)
    return Model(names, code, trust.astype(np.float32), w, b)


def _featured(rows: DataFrame, kept: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(*text_bytes(batch.column(1)))
            cells = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), cells], [kept, "x"])
        return by_slice(batches, one)

    return rows.mapInArrow(work, StructType([rows.schema[kept]]).add("x", "binary"))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> Model:
    """Fit on at most ``train_rows`` rows with a language and a letter, those with the smallest hash
    of their id. Their whole texts become feature vectors on the executors; the driver gets those."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(key), F.lit(5)).alias("place"), F.xxhash64(text).alias("tie"))
    cut = settle(labelled.select("place").orderBy("place").limit(train_rows), "sample")
    last = cut.agg(F.max("place")).first()[0]
    if last is None:
        return fit(np.zeros((0, PAIRS + TRIPLES), np.float32), [])
    rows = (_featured(labelled.where(F.col("place") <= last)
                      .select(F.struct("lang", "place", "tie").alias("row"), "text"), "row")
            .orderBy("row.place", "row.tie").limit(train_rows).collect())
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, [r["row"]["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Rows ``(row struct of the columns in keep, lang_pred, score, ambiguous)`` of whole texts.

    ``und`` with score 0 and ambiguous, if a text is null or has no letter, or if no language was
    learnt; a text with letters too few for any n-gram is decided by the classifiers' bias. Equal
    losses: the language first in order. The kept columns stand in a struct of their own, so no
    name can clash. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 12 KB a bit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score, unsure = np.full(len(ok), -1), np.zeros(len(ok)), np.ones(len(ok), bool)
            if model.langs and len(ok):
                found = model.decode(features(*text_bytes(batch.column(1))))
                best, score, unsure = (np.where(ok, a, b) for a, b in zip(found, (best, score, unsure)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score.astype(float)),
                 pa.array(unsure.astype(bool))], ["row", "lang_pred", "score", "ambiguous"])

        return by_slice(batches, one)

    schema = (StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double")
              .add("ambiguous", "boolean"))
    return rows.mapInArrow(work, schema)
