"""A neural scorer for texts: hashed words and byte trigrams, their mean embedding, one hidden layer, two logits.

It is trained with numpy on the driver on a bounded sample, and applied to whole tables as a Spark ML batch predictor.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from newslab.constants import EMBED_BATCH
from newslab.functions.numbers import polarity

#: Rows of the hashed embedding; pieces that share one share its vector.
BUCKETS = 1 << 14
#: Length of a piece's vector and of the hidden layer.
WIDTH = 16
#: The training sample: at most so many texts, none of more than so many characters.
TRAIN_ROWS, TRAIN_CHARS = 2000, 20_000
#: Passes over the sample, texts per step, step size; a small sample is passed over until so many steps are made.
EPOCHS, STEP_TEXTS, RATE, LEAST_STEPS = 4, 32, 0.01, 100

_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Network:
    pieces: np.ndarray  # BUCKETS x WIDTH
    hidden: np.ndarray  # WIDTH x WIDTH
    shift: np.ndarray   # WIDTH
    out: np.ndarray     # WIDTH x 2: positive, negative

    def weights(self) -> list[np.ndarray]:
        return [self.pieces, self.hidden, self.shift, self.out]


def piece_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of a text and the share of each in its pieces: the lower-cased words, and each three bytes of
    the text as it is. Words carry the sense of headlines, trigrams the marks and letters that make a text look odd."""
    found = _WORD.findall(text.lower())
    words = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in found), np.int64, len(found))
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64)
    pieces = np.concatenate([words, ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 40_503 >> 7) % BUCKETS])
    rows, counts = np.unique(pieces, return_counts=True)
    return rows, counts / max(len(pieces), 1)


def logits(network: Network, texts: list[str]) -> np.ndarray:
    """Texts x 2. A text without pieces has the mean vector zero; no array grows beyond BUCKETS rows but its pieces."""
    mean = np.array([shares @ network.pieces[rows] for rows, shares in map(piece_shares, texts)])
    return np.tanh(mean @ network.hidden + network.shift) @ network.out


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> Network:
    """Adam on the cross entropy of (positive, negative); ``labels`` are 1 and 0."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, WIDTH ** -0.5, (WIDTH, WIDTH)),
               np.zeros(WIDTH), rng.normal(0, WIDTH ** -0.5, (WIDTH, 2))]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    bags, wanted, step = [piece_shares(t) for t in texts], np.eye(2)[1 - np.asarray(labels, int)], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * STEP_TEXTS // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), STEP_TEXTS):
            some, step = order[at:at + STEP_TEXTS], step + 1
            vectors, hidden, shift, out = weights
            mean = np.array([shares @ vectors[rows] for rows, shares in (bags[i] for i in some)])
            inner = np.tanh(mean @ hidden + shift)
            raised = np.exp((z := inner @ out) - z.max(axis=1, keepdims=True))
            error = (raised / raised.sum(axis=1, keepdims=True) - wanted[some]) / len(some)
            back = (error @ out.T) * (1 - inner ** 2)
            slope = np.zeros_like(vectors)
            for i, to_mean in zip(some, back @ hidden.T):
                slope[bags[i][0]] += np.outer(bags[i][1], to_mean)
            for w, g, m, v in zip(weights, (slope, mean.T @ back, back.sum(axis=0), inner.T @ error), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Network(*weights)


def fit_network(labelled: DataFrame, text: str = "text", label: str = "label", rows: int = TRAIN_ROWS) -> Network:
    """Train on the first ``rows`` texts in the order of a hash, after texts without a label and those over TRAIN_CHARS
    characters have been left out."""
    usable = labelled.filter(F.col(label).isin(0, 1) & (F.length(text) <= TRAIN_CHARS))
    sample = usable.select(F.col(text).alias("text"), F.col(label).alias("label")).orderBy(
        F.xxhash64("text"), "text", "label").limit(rows).collect()
    if not sample:
        raise ValueError("no labelled text to train on")
    return train([r["text"] for r in sample], np.array([r["label"] for r in sample]))


def score_with_network(network: Network, df: DataFrame, text: str = "headline", output: str = "live_score") -> DataFrame:
    """Add the polarity of whole texts; a null text has a null score. The weights (2 MB) travel with the job and are
    unpacked once per Python worker."""
    def load():
        return lambda texts: logits(network, list(texts))

    predict = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=EMBED_BATCH)
    scored = df.withColumn("_logits", predict(F.coalesce(F.col(text), F.lit(""))))
    score = F.when(F.col(text).isNotNull(), polarity(F.col("_logits"), 0, 1))
    return scored.withColumn(output, score).drop("_logits")
