"""Operator 7, language ID: family first, then one-versus-one linear support vector machines within the family.

A word's features are its character 1- to 4-grams with word ends marked, hashed to 2**14 places. All decisions are
linear in the sum of the word vectors divided by the number of words, so each distinct word is turned into
its decision values once per worker, and a document is the mean over its words.

Families are learned, not given: languages are clustered by the cosine of their mean profiles, each less the mean of all.
The two clusters with the largest mean cosine between their languages are joined, again and again, while it is above LIKENESS (above 0:
more alike than languages are on average) and the family stays within MOST_LANGUAGES. Level one separates families by
one-versus-rest machines; level two has a machine for each pair of languages of a family, and the language with most
wins is predicted (ties by the sum of margins, then by name). Machines are trained by dual coordinate descent on at
most TRAIN_ROWS documents of each language.

Score is the least probability (logistic of a margin) along the path, of family and language. Texts that are null
or have no letter get `und` with score 0; so does every text if nothing was learned. With one learned language
all other texts get it with score 1. Equal texts get equal predictions; rows repeated with one id are predicted each, of several
texts with one id and one language the least is learned from, and rows without id are predicted and never learned
from. A long text is taken in blocks of words. Columns other than doc_id, text and lang are ignored, also those named
like the new ones. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_arrow, texts
from .labelled import fold, sample

#: Places for n-grams, longest n-gram, documents of each language to learn from, decision values of words that a worker keeps.
PLACES, LONGEST, TRAIN_ROWS, MEMO_VALUES = 1 << 14, 4, 400, 2_000_000
#: Least mean cosine at which clusters of languages are joined, and most languages in a family.
LIKENESS, MOST_LANGUAGES = 0.0, 12
#: Words taken at once, cost of an error, passes over the sample.
BLOCK_WORDS, COST, PASSES = 20_000, 8.0, 8

LETTER = re.compile(r"[^\W\d_]")


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def gram_places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the character n-grams of many words, word by word, and how many each word has.

    Everything but letters counts as a blank; an n-gram may begin or end with a blank, but has none inside.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32)
    basic = letter_table()[codes & 0xFFFF] & (codes < 0x10000)
    for c in np.unique(codes[codes >= 0x10000]):
        basic |= (codes == c) & chr(c).isalpha()
    codes = np.where(basic, codes, 32).astype(np.uint32)
    of_word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])  # a word with the blank before it
    places, owners, h = [], [], np.full(len(codes), 0x811C9DC5, np.uint32)
    blank = ~basic
    good = np.ones(len(codes), bool)  # no blank inside so far
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ codes[n - 1 : n - 1 + m]) * np.uint32(0x01000193)
        if n > 2:
            good = good[:m] & ~blank[n - 2 : n - 2 + m]
        take = np.flatnonzero(good[:m] & ~(blank[:m] & blank[n - 1 : n - 1 + m]))
        places.append((h[take] ^ (h[take] >> np.uint32(15))) & np.uint32(PLACES - 1))
        owners.append(of_word[np.minimum(take, len(of_word) - 1)])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: n-grams per word of the text."""
    counts = Counter((text or "").lower().split())
    if not counts:
        return np.empty(0, np.int64), np.empty(0)
    places, own = gram_places(list(counts))
    dense = np.bincount(places, np.repeat(list(counts.values()), own), minlength=PLACES)
    at = np.flatnonzero(dense)
    return at, dense[at] / counts.total()


def machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """Weights (the last one the bias) of an L2-loss linear SVM, by dual coordinate descent (Hsieh et al. 2008)."""
    w, alpha = np.zeros(PLACES + 1), np.zeros(len(rows))
    counts = {s: (signs == s).sum() for s in (-1, 1)}
    costs = np.array([COST * len(rows) / (2 * max(1, counts[s])) for s in signs])
    squares = np.array([v @ v + 1 for _, v in rows])
    for epoch in range(PASSES):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, v = rows[i]
            slope = signs[i] * (w[at] @ v + w[-1]) - 1 + alpha[i] / (2 * costs[i])
            new = max(0.0, alpha[i] - slope / (squares[i] + 1 / (2 * costs[i])))
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * signs[i] * v
                w[-1] += (new - alpha[i]) * signs[i]
                alpha[i] = new
    return w


def families_of(profiles: dict[str, np.ndarray]) -> list[tuple[str, ...]]:
    """Average-linkage clusters of languages by the cosine of their mean profiles less the mean of all."""
    names = sorted(profiles)
    if not names:
        return []
    common = sum(profiles.values()) / len(profiles)
    unit = np.array([(profiles[n] - common) / (np.linalg.norm(profiles[n] - common) or 1.0) for n in names])
    sums = unit @ unit.T  # of cosines between the languages of two clusters
    clusters = [[k] for k in range(len(names))]
    while len(clusters) > 1:
        sizes = np.array([len(c) for c in clusters])
        mean = sums / np.outer(sizes, sizes)
        mean[(sizes[:, None] + sizes > MOST_LANGUAGES) | np.eye(len(clusters), dtype=bool)] = -2
        i, j = sorted(np.unravel_index(np.argmax(mean), mean.shape))
        if mean[i, j] <= LIKENESS:
            break
        clusters[i] += clusters.pop(j)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        sums = np.delete(np.delete(sums, j, 0), j, 1)
    return sorted(tuple(names[k] for k in sorted(c)) for c in clusters)


class Model:
    """Families, their machines, and the machine of each pair of languages in a family."""

    def __init__(self, rows: Iterable[tuple[str | None, str]]):
        rows = [(features(t), lang) for t, lang in rows if t and LETTER.search(t)]
        names = sorted({lang for _, lang in rows})
        profiles = {}
        for n in names:
            total = np.zeros(PLACES)
            own = [f for f, lang in rows if lang == n]
            for at, v in own:
                total[at] += v
            profiles[n] = total / len(own)
        self.families = families_of(profiles)
        place = {n: k for k, f in enumerate(self.families) for n in f}
        weights, self.pairs = [], []
        if len(self.families) > 1:
            for k in range(len(self.families)):
                weights.append(machine([f for f, _ in rows], np.array([1 if place[lang] == k else -1 for _, lang in rows])))
        for f in self.families:
            for i, a in enumerate(f):
                for b in f[i + 1 :]:
                    own = [(x, lang) for x, lang in rows if lang in (a, b)]
                    self.pairs.append((a, b))
                    weights.append(machine([x for x, _ in own], np.array([1 if lang == a else -1 for _, lang in own])))
        stacked = np.array(weights).reshape(-1, PLACES + 1)
        self.weights, self.bias = stacked[:, :-1].T.copy(), stacked[:, -1]
        self.words: dict[str, int] = {}
        self.values = np.zeros((1024, len(stacked)))
        self.most_words = max(BLOCK_WORDS, MEMO_VALUES // max(1, len(stacked)))

    def places_of(self, words: list[str]) -> np.ndarray:
        """Rows of the words in the table of values, at most BLOCK_WORDS of them; new words are added."""
        new = list({w for w in words if w not in self.words})
        if len(self.words) + len(new) > self.most_words:
            self.words.clear()
            new = list(set(words))
        step = max(1, 40_000 // max(1, self.values.shape[1]))
        for part in (new[k : k + step] for k in range(0, len(new), step)):
            places, own = gram_places(part)
            first = len(self.words)
            while first + len(part) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            ends = np.cumsum(own)
            sums = np.zeros((len(places) + 1, self.values.shape[1]))
            np.cumsum(self.weights[places], axis=0, out=sums[1:])
            self.values[first : first + len(part)] = sums[ends] - sums[ends - own]
            self.words.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not LETTER.search(text):
            return "und", 0.0
        total, counted = np.zeros(self.values.shape[1]), 0
        for part in blocks(text.encode("utf-8", "replace")):
            words = part.decode("utf-8", "replace").lower().split()
            for i in range(0, len(words), BLOCK_WORDS):
                block = words[i : i + BLOCK_WORDS]
                at = self.places_of(block)  # may put a larger table in the place of self.values
                total += self.values[at].sum(axis=0)
                counted += len(block)
        margins = total / counted + self.bias
        k = int(np.argmax(margins[: len(self.families)])) if len(self.families) > 1 else 0
        family, sure = self.families[k], 1.0
        first = len(self.families) if len(self.families) > 1 else 0
        if first:
            sure = 1 / (1 + np.exp(-np.clip(2 * margins[k], -30, 30)))
        if len(family) == 1:
            return family[0], float(sure)
        wins, sums = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
        for (a, b), m in zip(self.pairs, margins[first:], strict=True):
            if a in wins:
                wins[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        best = min(family, key=lambda n: (-wins[n], -sums[n], n))
        least = min((m if a == best else -m) for (a, b), m in zip(self.pairs, margins[first:], strict=True) if best in (a, b))
        return best, float(min(sure, 1 / (1 + np.exp(-np.clip(2 * least, -30, 30)))))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and lang of documents outside the held-out fold (crc32 of the id, modulo 4, equal to 2) only."""
    named = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    rows = sample(docs, named, fold(4) != 2, train_rows, per_class=True)
    return Model((r.text, r.label) for r in rows.toLocalIterator())


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    predicted = map_arrow(texts(docs), predict, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
