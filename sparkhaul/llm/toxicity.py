"""Operator 3, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each blank-separated word has a word vector (one for all words rare in the sample) and a character vector (the largest
values of its hashed character n-grams), joined. Two GRUs read a window of WINDOW words forward and backward; attention
pools their states; a logistic unit scores the window. Windows start every STRIDE words, so they overlap, and the last one ends
with the text; all of them are scored, and a document's score is its largest.

Training (Adam, back-propagation through time) knows documents only: each round picks, of all windows of every
sampled document, the one the network finds worst, and trains it towards the document's label. The sample has
TRAIN_ROWS rows of each label at most; the bias is set at the end, by whole documents and the labels' shares. What
depends on the word alone (its vectors times the input weights of all gates) is computed once for each distinct word in a worker.

Null, empty and blank texts have no window and a score of next to 0 (below 1e-12). If nothing can be learned (no labels, or one label only), scores
are those of the first weights. A score of just 0.5 predicts 1. Equal texts get equal scores; rows repeated with one id are scored
each, and rows without id are scored but never learned from. A long text is read and scored in blocks of words.
Columns of docs or labels other than doc_id, text and toxic are ignored, also those named like the new ones. An empty
table of documents gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, texts
from .labelled import fold, sample
from .language_id import PLACES as GRAMS
from .language_id import gram_places

#: Words of a window and between window starts; sizes of word and character vectors, states and attention.
WINDOW, STRIDE, WORD_DIM, CHAR_DIM, STATE, ATTEND = 24, 16, 8, 12, 12, 8
#: Word vectors, the sampled documents a word must be in to have one of its own, and rows of each label to learn from.
WORDS, KNOWN_DOCS, TRAIN_ROWS = 4096, 8, 1000
#: Rounds over the sample, windows in a batch, and the size of a step.
ROUNDS, BATCH, RATE = 14, 64, 0.01
#: Characters that don't count at the ends of a word.
EDGES = ".,;:!?()[]{}'\"#$%&*|"
#: Windows scored at once, words that a worker remembers, and words whose n-grams are looked up at once.
SCORE_WINDOWS, MEMO_WORDS, SOME_WORDS = 4096, 60_000, 10_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def first_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"word": (WORDS, WORD_DIM), "char": (GRAMS, CHAR_DIM)}
    w = {k: 0.1 * rng.standard_normal(shape).astype(np.float32) for k, shape in w.items()}
    for side in "fb":
        w |= {f"x{side}": normal(d, 3 * STATE), f"h{side}": normal(STATE, 3 * STATE), f"b{side}": np.zeros(3 * STATE, np.float32)}
    pool = {"a": normal(2 * STATE, ATTEND), "ab": np.zeros(ATTEND, np.float32), "av": normal(ATTEND, 1)[:, 0]}
    return w | pool | {"o": normal(2 * STATE, 1)[:, 0], "ob": np.full(1, -1.0, np.float32)}


def vocabulary(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word among the known ones (0 for others), places of all their n-grams word by word, and how many each has."""
    bucket = np.fromiter((known.get(w.strip(EDGES), 0) for w in words), np.int64, len(words))
    parts = [gram_places(words[k : k + SOME_WORDS]) for k in range(0, len(words), SOME_WORDS)]
    places, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return bucket, places, count


def word_vectors(w: dict, bucket: np.ndarray, places: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Word vector beside the largest value of each dimension among the word's n-grams (0 at least); some words at once."""
    chars = np.zeros((len(bucket), CHAR_DIM), np.float32)
    ends = np.cumsum(count)
    for k in range(0, len(bucket), SOME_WORDS):
        own = slice(k, k + SOME_WORDS)
        some = k + np.flatnonzero(count[own])
        if len(some):
            first = ends[k] - count[k]
            starts_of = (ends - count)[some] - first
            chars[some] = np.maximum.reduceat(w["char"][places[first : ends[some[-1]]]], starts_of, axis=0)
    return np.concatenate([w["word"][bucket], np.maximum(chars, 0)], axis=1)


def recur(gates: np.ndarray, ids: np.ndarray, wh: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States (windows, words, STATE) of one GRU. gates: input part of each word; ids: words of windows, -1 beyond the end."""
    n, length = ids.shape
    out, h = np.zeros((n, length, STATE), np.float32), np.zeros((n, STATE), np.float32)
    full = ids.min() >= 0 if n else True
    for t in range(length - 1, -1, -1) if backward else range(length):
        g, q = gates.take(ids[:, t], axis=0), h @ wh
        rz = g[:, : 2 * STATE] + q[:, : 2 * STATE]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:, :STATE], rz[:, STATE:]
        c = r * q[:, 2 * STATE :]
        c += g[:, 2 * STATE :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        if not full:
            new = np.where((ids[:, t] >= 0)[:, None], new, h)
        if keep is not None:
            keep.append((t, h, q, r, z, c))
        out[:, t] = h = new
    return out


def forward(w: dict, gates: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    tapes = {s: ([] if keep is not None else None) for s in "fb"}
    states = np.concatenate([recur(gates[s], ids, w[f"h{s}"], s == "b", tapes[s]) for s in "fb"], axis=2)
    u = np.tanh(states @ w["a"] + w["ab"])
    e = np.where(ids >= 0, u @ w["av"], -1e9)
    share = np.exp(e - e.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    pooled = (share[:, :, None] * states).sum(axis=1)
    if keep is not None:
        keep |= {"tapes": tapes, "states": states, "u": u, "share": share, "pooled": pooled}
    return pooled @ w["o"] + w["ob"][0]


def gates_of(w: dict, vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {s: vectors @ w[f"x{s}"] + w[f"b{s}"] for s in "fb"}


def gradients(w: dict, words: tuple, ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over windows. words: vocabulary() of the words that ids point to."""
    bucket, places, count = words
    vectors = word_vectors(w, *words)
    kept: dict = {}
    p = sigmoid(forward(w, gates_of(w, vectors), ids, kept))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    states, u, share = kept["states"], kept["u"], kept["share"]
    g = {"o": kept["pooled"].T @ d_logit, "ob": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["o"]
    d_states = share[:, :, None] * d_pooled[:, None, :]
    d_share = (states * d_pooled[:, None, :]).sum(axis=2)
    d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    d_u = d_e[:, :, None] * w["av"] * (1 - u**2)
    g |= {"av": np.einsum("nt,nta->a", d_e, u), "a": np.einsum("nts,nta->sa", states, d_u), "ab": d_u.sum(axis=(0, 1))}
    d_states = d_states + d_u @ w["a"].T
    d_vectors = np.zeros_like(vectors)
    for s, part in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
        d_gates, d_h = np.zeros((len(vectors), 3 * STATE), np.float32), np.zeros((len(ids), STATE), np.float32)
        g[f"h{s}"] = np.zeros_like(w[f"h{s}"])
        for t, h, q, r, z, c in reversed(kept["tapes"][s]):
            there = (ids[:, t] >= 0)[:, None]
            total = d_h + d_states[:, t, part]
            d_new = np.where(there, total, 0)
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * q[:, 2 * STATE :] * r * (1 - r)
            d_q = np.concatenate([d_r, d_z, d_c * r], axis=1)
            np.add.at(d_gates, ids[there[:, 0], t], np.concatenate([d_r, d_z, d_c], axis=1)[there[:, 0]])
            g[f"h{s}"] += h.T @ d_q
            d_h = np.where(there, d_new * z + d_q @ w[f"h{s}"].T, total)
        g[f"x{s}"], g[f"b{s}"] = vectors.T @ d_gates, d_gates.sum(axis=0)
        d_vectors += d_gates @ w[f"x{s}"].T
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    np.add.at(g["word"], bucket, d_vectors[:, :WORD_DIM])
    most = np.repeat(vectors[:, WORD_DIM:], count, axis=0)
    np.add.at(g["char"], places, np.where(w["char"][places] >= most, np.repeat(d_vectors[:, WORD_DIM:], count, axis=0), 0))
    return g


def starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    at = np.arange(0, n - WINDOW, STRIDE)
    return np.append(at, n - WINDOW)


def window_parts(text: bytes | None) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of a text in parts, and the starts in each part of the windows that starts() gives for the whole text."""
    words: list[str] = []
    last: list[str] = []
    for block in blocks(text or b""):
        new = block.decode().lower().split()
        words += new
        last = (last + new)[-WINDOW:]
        count = max(0, -(-(len(words) - WINDOW) // STRIDE))  # windows that end before the last word
        for k in range(0, count, SCORE_WINDOWS):
            n = min(SCORE_WINDOWS, count - k)
            yield words[k * STRIDE : (k + n - 1) * STRIDE + WINDOW], np.arange(n) * STRIDE
        words = words[count * STRIDE :]
    if last:
        yield last, np.zeros(1, np.int64)


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([ids, np.full(WINDOW, -1, np.int64)]) if len(ids) < WINDOW else ids
    return padded[at[:, None] + np.arange(WINDOW)]


def worst_windows(w: dict, gates: dict[str, np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """Of each text the window with the largest logit, the first of equals; scored in blocks of about SCORE_WINDOWS windows."""
    at = [starts(len(x)) for x in ids]
    ends = np.cumsum([len(x) for x in at])
    chosen = np.zeros((len(ids), WINDOW), np.int64)
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SCORE_WINDOWS, "right")))
        every = np.concatenate([windows(x, y) for x, y in zip(ids[first:last], at[first:last], strict=True)])
        logits = np.concatenate([forward(w, gates, every[k : k + SCORE_WINDOWS]) for k in range(0, len(every), SCORE_WINDOWS)])
        cuts = np.cumsum([len(x) for x in at[first:last]])
        for k, part in enumerate(np.split(logits, cuts[:-1])):
            chosen[first + k] = every[cuts[k] - len(part) + np.argmax(part)]
        first = last
    return chosen


def best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the range of cuts with the least weighted errors (the widest of equals)."""
    order = np.argsort(logits, kind="stable")
    x, y, c = logits[order], labels[order], weights[order]
    # errors if the first k are called 0 and the others 1
    errors = np.concatenate([[0.0], np.cumsum(np.where(y == 1, c, -c))]) + c[y == 0].sum()
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    good = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = good[np.argmax(edges[good + 1] - edges[good])]
    return float(edges[k] + edges[k + 1]) / 2


def train(rows: list[tuple[str | None, int]], rounds: int = ROUNDS, seed: int = 1, share: float | None = None) -> dict[str, np.ndarray]:
    """Weights, with the words that have a vector under "known". share: the share of label 1 among all labelled rows.

    At last the bias is set: the sampled documents are scored whole, and their best cut, with each label weighed by its
    share of all rows, becomes the score 0.5.
    """
    rng, w = np.random.default_rng(seed), first_weights(seed)
    split = [((t or "").lower().split(), y) for t, y in rows]
    split = [(x, y) for x, y in split if x]
    names = {n: k for k, n in enumerate(sorted({n for x, _ in split for n in x}))}
    if len({y for _, y in split}) < 2:
        return w | {"known": {}}
    held = Counter(n for x, _ in split for n in {y.strip(EDGES) for y in x})
    common = sorted(held.items(), key=lambda nc: (-nc[1], nc[0]))[: WORDS - 1]
    known = {n: k + 1 for k, (n, c) in enumerate(common) if c >= KNOWN_DOCS}
    words = vocabulary(list(names), known)
    ids = [np.fromiter(map(names.__getitem__, x), np.int64, len(x)) for x, _ in split]
    labels = np.array([y for _, y in split], np.float32)
    ends = np.cumsum(words[2])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for _ in range(rounds):
        gates = gates_of(w, word_vectors(w, *words))
        chosen = worst_windows(w, gates, ids)
        for batch in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            own = np.unique(chosen[batch])
            own = own[own >= 0]
            local = np.where(chosen[batch] >= 0, np.searchsorted(own, chosen[batch]), -1)
            count = words[2][own]
            places = np.concatenate([words[1][ends[k] - words[2][k] : ends[k]] for k in own]) if len(own) else words[1][:0]
            step += 1
            for k, d in gradients(w, (words[0][own], places, count), local, labels[batch]).items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    scorer = Scorer(w | {"known": known})
    scores = np.clip(scorer.scores([t for t, _ in rows]), 1e-9, 1 - 1e-9)
    y = np.array([label for _, label in rows])
    weights = np.ones(len(y)) if share is None else np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    w["ob"] -= best_cut(np.log(scores / (1 - scores)), y, weights)
    return w | {"known": known}


class Scorer:
    """Document scores under fixed weights, with the gates of words met before at hand."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.names = w, {}
        self.gates = {s: np.zeros((1024, 3 * STATE), np.float32) for s in "fb"}

    def ids_of(self, words: list[str]) -> np.ndarray:
        new = list({x for x in words if x not in self.names})
        if new:
            first = len(self.names)
            made = gates_of(self.w, word_vectors(self.w, *vocabulary(new, self.w["known"])))
            for s in "fb":
                while first + len(new) > len(self.gates[s]):
                    self.gates[s] = np.concatenate([self.gates[s], np.zeros_like(self.gates[s])])
                self.gates[s][first : first + len(new)] = made[s]
            self.names.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))

    def scores(self, batch: Iterable[str | bytes | None]) -> np.ndarray:
        """In blocks: a block ends when it has SCORE_WINDOWS windows, so a long text is in many blocks."""
        best: list[float] = []
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            if held:
                logits = forward(self.w, self.gates, np.concatenate(held))
                of, first = np.unique(np.concatenate(owner), return_index=True)  # texts lie in order, each in one run
                for k, x in zip(of.tolist(), np.maximum.reduceat(logits, first).tolist(), strict=True):
                    best[k] = max(best[k], x)
                held.clear()
                owner.clear()

        for k, text in enumerate(batch):
            best.append(-np.inf)
            for own, at in window_parts(text.encode() if isinstance(text, str) else text):
                if len(self.names) + len(own) > MEMO_WORDS or size + len(at) > SCORE_WINDOWS:
                    flush()
                    size = 0
                if len(self.names) + len(own) > MEMO_WORDS:
                    self.names.clear()
                held.append(windows(self.ids_of(own), at))
                owner.append(np.full(len(at), k))
                size += len(at)
        flush()
        return sigmoid(np.array(best))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. labels: doc_id, toxic.

    Learns from rows outside the held-out fold (crc32 of the id, modulo 5, equal to 0) only.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    rows = sample(docs, named, fold(5) != 0, train_rows, per_class=True).select("text", "label").collect()
    share = named.where(fold(5) != 0).agg(F.avg((F.col("label") == 1).cast("int"))).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast(train([(r.text, r.label) for r in rows], share=share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.scores(t for _, t in columns(batch))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
