"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes. Each passage is encoded from its own bytes
(pairs of character classes, repeated and distinct words), gated attention weighs the encodings,
and the weighted one is scored. Attention weights are learned from document labels alone.

The model is fitted on the driver from at most `TRAIN_DOCS` labelled documents (the first in the
order of a hash of doc_id, one text each, of long ones `DOC_PASSAGES` passages spread over the whole
text: 4,000 x 50 rows of features at most), whose crc32(doc_id as text) modulo 3 isn't 1. Weights have a fixed size and are
broadcast. Scoring reads every whole text in lots of bounded size. Labels, lang, source and
doc_id are no inputs of a score.

Edge cases: a null or empty text is one passage of no bytes and gets a score as well; contradicting
labels of one doc_id count by their mean; rows that repeat are scored each; without labels every
score is 0.5; a null doc_id isn't held out and never trained on; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import Words
from .pieces import batches

PASSAGE, TRAIN_DOCS, DOC_PASSAGES = 512, 4000, 50
HIDDEN, GATE, EPOCHS, RATE, DECAY, LOT = 24, 12, 40, 0.01, 1e-4, 256
BATCH_CHARS = 4_000_000
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!", b"?", b"|", b"$%&#*", b"'\"", b"()[]{}<>", b"-_/\\+=@~^`", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k
N_FEATURES = 256 + 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def passages(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages (float32) and the first passage of each text."""
    data = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    raw = b"".join(data)
    of = np.repeat(first, size) + (np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)) // PASSAGE
    kind = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    x = np.zeros((total, N_FEATURES), np.float32)
    if len(raw) > 1:
        same = of[1:] == of[:-1]
        pairs = np.bincount((of[1:] * 256 + kind[:-1] * 16 + kind[1:])[same], minlength=total * 256).reshape(total, 256)
        x[:, :256] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    h, ends = words(raw)
    if len(h):
        owner = of[np.minimum(ends - 1, len(raw) - 1)]
        n = np.maximum(np.bincount(owner, minlength=total), 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        x[:, 256] = np.bincount(owner, again, total) / n
        mixed = np.unique(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        x[:, 257] = np.bincount(owner[mixed], minlength=total) / n
        x[:, 258] = np.log1p(n) / 5
    x[:, 259] = np.log1p(np.bincount(of, minlength=total)) / 6
    return x, first


class Model:
    """Encoder, gated attention and scorer; the arrays are all it is."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        r = np.random.default_rng(11)
        self.mean, self.scale = mean, scale
        self.w = {
            "E": r.normal(0, 0.1, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)),
            "a": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, count = self.w, np.diff(np.append(first, len(x)))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        score = (t * s) @ w["a"]
        score = np.exp(score - np.repeat(np.maximum.reduceat(score, first), count))
        weight = score / np.repeat(np.add.reduceat(score, first), count)
        bag = np.add.reduceat(h * weight[:, None], first)
        p = 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["b"][0], -30, 30)))
        return p, (z, h, t, s, weight, bag, count)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        w = self.w
        p, (z, h, t, s, weight, bag, count) = self.forward(x, first)
        out = (p - y) / len(y)
        d_bag = np.repeat(out, count)[:, None] * w["c"]
        d_weight = (d_bag * h).sum(1)
        d_score = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, first), count))
        d_t, d_s = d_score[:, None] * w["a"] * s * (1 - t**2), d_score[:, None] * w["a"] * t * s * (1 - s)
        d_h = (weight[:, None] * d_bag + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h**2)
        return {"E": z.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "a": ((t * s) * d_score[:, None]).sum(0), "c": bag.T @ out, "b": np.array([out.sum()])}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over lots of documents, in an order fixed by a seed."""
    x = x.astype(np.float64)
    model = Model(x.mean(0), x.std(0) + 1e-3)
    one, two = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    ends, r, step = np.append(first[1:], len(x)), np.random.default_rng(5), 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), LOT):
            docs = order[at : at + LOT]
            size = ends[docs] - first[docs]
            begin = np.cumsum(size) - size
            rows = np.arange(int(size.sum())) + np.repeat(first[docs] - begin, size)
            step += 1
            for k, g in model.gradients(x[rows], begin, y[docs]).items():
                g = g + DECAY * model.w[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                model.w[k] -= RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The passages of each document, of long ones DOC_PASSAGES spread over the whole text."""
    words = Words()
    for ids, texts in batches(frames, BATCH_CHARS):
        x, first = passages(texts, words)
        spread = [v if len(v) <= DOC_PASSAGES else v[np.linspace(0, len(v) - 1, DOC_PASSAGES).astype(int)] for v in np.split(x, first[1:])]
        yield pd.DataFrame({"doc_id": ids, "x": [v.tobytes() for v in spread]})


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model from a bounded sample of labelled documents that aren't held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most train_docs rows, one for each doc_id
    got = sample.mapInPandas(_featured, "doc_id long, x binary").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "x")
    x, y, first, n = [], [], [], 0
    for row in got.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():  # train_docs x DOC_PASSAGES passages at most
        part = np.frombuffer(row.x, np.float32).reshape(-1, N_FEATURES)
        x.append(part)
        y.append(row.y)
        first.append(n)
        n += len(part)
    return train(np.concatenate(x), np.array(first), np.array(y)) if y else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        out = d.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words()
            for ids, texts in batches(frames, BATCH_CHARS):
                x, first = passages(texts, words)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "score": shared.value.forward(x, first)[0]})

        out = d.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels))
