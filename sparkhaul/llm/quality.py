"""Operator 2, quality classifier: hashed word 1- and 2-grams, logistic regression by follow-the-regularised-leader.

A text's features are its words and word pairs, and the 1-, 2- and 3-grams of its words' shapes, hashed to 2**20
places; a shape keeps which kinds of characters follow each other, and whether a word repeats the one before it. The
value of a place is its share of all features, times SCALE. Training is FTRL-proximal (McMahan et al.): per coordinate sums z and n, weights that are
zero until |z| exceeds L1. It runs on a bounded sample of labelled rows, TRAIN_ROWS at most, in EPOCHS passes;
every document is then scored as a sparse dot product. Weights are one array of 4 MB, whatever the input.

Words are runs of non-blank bytes with their case. Empty and null texts have no features and get the score of
the bias. Without any usable label, or with one label only, the score of every text is 0.5 or near that label. A score
of just 0.5 predicts 1. Equal texts get equal scores; rows repeated with one id are scored each; rows without id are scored
and are never learned from or held out. A long text is scored in blocks of words; its pairs across blocks
count too. Columns of docs or labels other than doc_id, text and quality are ignored, also those named score or held_out, and
pass through untouched in good_documents. An empty table of documents gives no rows, of labels a bias of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, map_arrow, mix, ngrams, texts, word_hashes
from .labelled import fold, sample

#: Places for features (a power of two), rows of the training sample, passages over it, and FTRL's parameters.
PLACES, TRAIN_ROWS, EPOCHS = 1 << 20, 4000, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.002, 0.01, 16.0

#: Each byte's kind: blanks as one blank, A-Z as A, other letters and all beyond ASCII as a, digits as 0, others as they are.
KINDS = bytes(32 if b in b" \t\n\x0b\x0c\r" else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape_hashes(text: bytes) -> np.ndarray:
    """A hash of each word's shape: the kinds of its bytes, runs as one."""
    kinds = np.frombuffer(text.translate(KINDS), np.uint8)
    return word_hashes(kinds[np.flatnonzero(np.diff(kinds, prepend=0))].tobytes())


def places(text: bytes | None) -> Iterator[np.ndarray]:
    """Places of all word and shape n-grams of a text, repeated ones included, block by block."""
    before, shapes_before = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for block in blocks(text or b""):
        h, shape = word_hashes(block), shape_hashes(block) + np.uint64(1)
        own = np.r_[before[-1:], h]
        shape[np.flatnonzero(own[1:] == own[:-1]) + len(h) - len(own) + 1] ^= np.uint64(0x5851F42D4C957F2D)
        two, shapes = ngrams(own, 2), np.r_[shapes_before, shape]
        found = [mix(h), two, *(ngrams(shapes[max(0, len(shapes_before) - n + 1) :], n) + np.uint64(n) for n in (1, 2, 3))]
        yield (np.concatenate(found) & np.uint64(PLACES - 1)).astype(np.int64)
        before, shapes_before = own[-1:], shapes[-2:]


def train(rows: list[tuple[bytes | None, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    examples = []
    for text, label in rows:
        at = np.concatenate([np.empty(0, np.int64), *places(text)])
        place, count = np.unique(at, return_counts=True)
        examples.append((np.r_[place, PLACES], np.r_[count * (SCALE / max(1, len(at))), 1.0], label))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            place, value, label = examples[i]
            w = weights(z[place], n[place])
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
            sigma = (np.sqrt(n[place] + gradient**2) - np.sqrt(n[place])) / ALPHA
            z[place] += gradient - sigma * w
            n[place] += gradient**2
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def score_of(text: bytes | None, weights: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for at in places(text):
        total += float(weights[at].sum(dtype=np.float64))
        n += len(at)
    dot = bias + (SCALE * total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(dot, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """labels: doc_id, quality. Learns from rows outside the held-out fold (crc32 of the id, modulo 3, equal to 1) only."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = sample(docs, named, fold(3) != 1, train_rows).select("text", "label").collect()
    return train([(None if t is None else t.encode(), y) for t, y in rows])


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array([score_of(t, *shared.value) for _, t in columns(batch)], pa.float64())
        return pa.record_batch([batch.column(0), scores], ["doc_id", "score"])

    scored = map_arrow(texts(docs), score, "doc_id long, score double")
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The whole rows of docs whose predicted label is 1, decided in place."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [score_of(t.as_py(), *shared.value) >= 0.5 for t in batch.column(at).cast(pa.binary())]
        return batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
