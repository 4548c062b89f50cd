"""Quality score: a byte-level convolutional network in numpy over whole documents."""

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

FILTERS = 32
WIDTH = 5
#: A chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 128
HIDDEN = 16
#: Blocks that are convolved at once.
AT_ONCE = 256
#: Bounds of the training sample, which the driver fits: rows, and bytes of one text.
TRAIN_ROWS = 2500
TRAIN_BYTES = 65_536


@dataclass
class Network:
    """Filters ``[width, 256, filters]``, their bias, a hidden layer per chunk and an output."""

    taps: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        small = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
        return Network(small(WIDTH, 256, FILTERS) * 0.4, np.zeros(FILTERS, np.float32),
                       small(FILTERS, HIDDEN) * 0.2, np.zeros(HIDDEN, np.float32),
                       small(HIDDEN) * 0.3, 0.0)

    def parts(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.inner, self.inner_bias, self.outer]

    def convolve(self, blocks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter in each block of ``laid_out``, and where it is."""
        flat, n = blocks, (len(blocks) - WIDTH + 1) // BLOCK
        best = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        for at in range(0, n, AT_ONCE):
            to = min(n, at + AT_ONCE)
            span = flat[at * BLOCK:to * BLOCK + WIDTH - 1]
            long = (to - at) * BLOCK
            out = self.taps[0][span[:long]]
            for t in range(1, WIDTH):
                out += self.taps[t][span[t:t + long]]
            out = out.reshape(to - at, BLOCK, FILTERS)
            if places:
                where[at:to] = out.argmax(axis=1)
                best[at:to] = np.take_along_axis(out, where[at:to, None, :], axis=1)[:, 0]
            else:
                best[at:to] = out.max(axis=1)
        return best + self.bias, where

    def read(self, flat: np.ndarray, bounds: np.ndarray, places: bool = False):
        """What backward() needs, first of it the score before the logistic function, by document."""
        best, where = self.convolve(flat, places)
        first, last = bounds[:-1], bounds[1:] - 1
        left = np.arange(bounds[-1])
        right = np.minimum(left + 1, np.repeat(last, np.diff(bounds)))
        chosen = np.where(best[left] >= best[right], left[:, None], right[:, None])
        pooled = np.maximum(np.take_along_axis(best, chosen, axis=0), 0)
        hidden = np.tanh(pooled @ self.inner + self.inner_bias)
        mean = np.add.reduceat(hidden, first, axis=0) / np.diff(bounds)[:, None]
        return mean @ self.outer + self.outer_bias, mean, hidden, pooled, chosen, where

    def probability(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        logits = self.read(*laid_out(data, bounds))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))

    def backward(self, flat, bounds, away: np.ndarray, read) -> list[np.ndarray]:
        """Gradients of parts() and the output bias; ``away``: of the loss by the logits."""
        _, mean, hidden, pooled, chosen, where = read
        lengths = np.diff(bounds)
        d_hidden = np.repeat(away / lengths, lengths)[:, None] * self.outer * (1 - hidden ** 2)
        d_pooled = (d_hidden @ self.inner.T) * (pooled > 0)
        at = chosen * BLOCK + np.take_along_axis(where, chosen, axis=0)
        filters = np.broadcast_to(np.arange(FILTERS), at.shape)
        live = d_pooled != 0
        at, filters, weight = at[live], filters[live], d_pooled[live]
        taps = np.stack([
            np.bincount(flat[at + t].astype(np.int64) * FILTERS + filters, weight, 256 * FILTERS)
            .reshape(256, FILTERS) for t in range(WIDTH)]).astype(np.float32)
        return [taps, d_pooled.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0),
                mean.T @ away, away.sum()]


def laid_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents padded with zero bytes to whole blocks (one at least), and their bounds in blocks."""
    lengths = np.diff(bounds)
    ends = np.concatenate([[0], np.cumsum((lengths + WIDTH - 1 + BLOCK - 1) // BLOCK)])
    flat = np.zeros(ends[-1] * BLOCK + WIDTH - 1, np.uint8)
    for to, a, b in zip((ends[:-1] * BLOCK).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        flat[to:to + b - a] = data[a:b]
    return flat, ends


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, seed: int = 7) -> Network | float:
    """Fit the network by Adam; classes weigh alike. One class only: its smoothed share instead."""
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return float((labels.sum() + 1) / (len(labels) + 2))
    net, r = Network.new(seed), np.random.default_rng(seed)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*net.parts(), np.zeros(1, np.float32)]]
    batch, step = 32, 0
    epochs = max(epochs, -(-400 * batch // len(texts)))  # few rows: 400 steps at least
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            some = [texts[i] for i in pick]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in some])])
            flat, ends = laid_out(np.frombuffer(b"".join(some), np.uint8), bounds)
            read = net.read(flat, ends, places=True)
            guess = 1 / (1 + np.exp(-np.clip(read[0], -60, 60)))
            away = ((guess - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for k, g in enumerate(net.backward(flat, ends, away, read)):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                change = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
                if k < 5:
                    net.parts()[k] -= change
                else:
                    net.outer_bias -= float(change[0])
    return net


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
          train_bytes: int = TRAIN_BYTES, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Network | float:
    """Fit on at most ``train_rows`` labelled documents, those with the smallest hash of their id,
    of at most ``train_bytes`` bytes each: that bounds what the driver holds. A document with
    several labels counts with the smallest; null labels and ids are no labels."""
    chosen = settle(
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("key", F.lit(7)), "key").limit(train_rows), "labels")
    rows = (docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
            .where(F.octet_length("text") <= train_bytes).join(chosen, "key")
            .orderBy(F.xxhash64("key", F.lit(7)), "key", "text").limit(train_rows).collect())
    return fit([bytes(x["text"]) for x in rows], np.array([x["label"] > 0 for x in rows], np.float32))


def score(docs: DataFrame, net: Network | float, keep: list[str], text: str = "text") -> DataFrame:
    """Rows ``(row struct of the columns in keep, score)``: the probability of label 1.

    Every byte of a text is read, in chunks of two blocks that overlap by one. Null and empty texts
    are one block of padding and get a score like any other. The kept columns stand in a struct of
    their own, so no name can clash. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 170 KB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = (np.full(batch.num_rows, net) if isinstance(net, float)
                     else net.probability(*text_bytes(batch.column(1))))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["row", "score"])

        return by_slice(batches, one)

    return rows.mapInArrow(work, StructType([rows.schema["row"]]).add("score", "double"))
