"""Operator 4, benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

The index holds the test items, not the corpus: per term a list of (item, impact), the impact being the term's BM25
weight in the item divided by the score of the item against itself, so that 1 means the whole item. Postings lie
in blocks, each with its largest impact. A passage cannot hold an item of more than PASSAGE words, so such an item is indexed as
overlapping pieces of PASSAGE words, each divided by its own score. Where a piece stands unchanged, the last passage that begins
at or before it and the next one hold all of its words together, so the better of them has half of its score at least; the nearer one
holds three quarters of its words.

Every document is cut into overlapping passages, all of them queries. A passage is passed over at once if no item can
reach the threshold in it by a first bound: the item's commonest terms give at most half of the threshold together and count as
there, its other terms count where they are; the others run WAND: a pivot from the terms' maxima, refined by the maxima
of the blocks that hold it, and full scoring only of items that can reach the threshold. All items above it
are retrieved. For a retrieved pair the document's words around the passage must then hold enough of
the whole item's question and of its answer, by word 3-grams. An item's score is that of its best piece.

Items are dealt into shards of about SHARD_WORDS words. How many items hold a term, how many items there are and how long pieces
are on average is counted once over the whole benchmark by Spark, so scores do not depend on the deal. A task builds the
index of each shard from its items; one at a time is broadcast, and the corpus is scanned once for each shard.

Null and empty texts and items match nothing. Items without id or repeated with one id are items of their own; so are
documents. A document gives one row for each item it holds, of its passages the one with the best score, of equal ones the
first. A long text is searched in parts that overlap by a passage and the longest item on either side. Columns other than
doc_id, item_id and text are ignored by contaminated and pass through untouched in clean_documents, also those named like the new
ones. An empty benchmark gives no match, an empty table of documents no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import blocks, columns, map_arrow, shared_table, texts

#: Words of a passage and between the starts of passages.
PASSAGE, STRIDE = 64, 32
#: BM25 constants, postings per block, and the share of an item's own score from which it is retrieved.
K1, B, BLOCK, THRESHOLD = 1.2, 0.75, 32, 0.4
#: Share of the threshold that an item's commonest terms may give in the first bound.
COMMON = 0.5
#: Shares of the question's and the answer's 3-grams that must be there.
QUESTION, ANSWER = 0.6, 0.6
#: Words of all items and pieces in one broadcast index (some 100 bytes a word in a worker), and words of a text that are searched at once.
SHARD_WORDS, PART_WORDS = 500_000, 200_000
#: Needed postings that the first bound lays out at once, some 200 bytes each.
RUN_POSTINGS = 200_000

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 32)


def terms(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, ASCII punctuation and white space between them."""
    return (text or b"").translate(_TABLE).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line of an item of several lines, else its last sentence; the question is the rest."""
    body = text.rstrip(b" \t\n\x0b\x0c\r")
    cut = body.rfind(b"\n")
    if cut < 0:
        cut = max(body.rfind(mark, 0, max(0, len(body) - 1)) for mark in (b". ", b"? ", b"! "))
    question, answer = terms(body[: cut + 1]), terms(body[cut + 1 :])
    return (question, answer) if question else (answer, [])


def grams(words: list[bytes]) -> set:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def pieces(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces of an item of n words: the whole item up to PASSAGE words, else PASSAGE words every STRIDE and the last."""
    return [(k, k + PASSAGE) for k in (*range(0, n - PASSAGE, STRIDE), n - PASSAGE)] if n > PASSAGE else [(0, n)]


class Index:
    """Inverted index of items: per term its postings (piece, impact) by piece, the largest impact of each block and of all.

    A term's rarity is counted over items, lengths over pieces; owner has the item of each piece.
    """

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD, counted: tuple[dict[bytes, int], int, float] | None = None):
        """counted: how many items hold each term, how many items there are, and the mean length of a piece; else those of items."""
        self.items = [(i, terms(t), *map(grams, question_and_answer(t))) for i, t in items if terms(t)]
        cut = [(i, w[a:b]) for i, (_, w, _, _) in enumerate(self.items) for a, b in pieces(len(w))]
        self.owner = [i for i, _ in cut]
        if counted is None:
            holding = Counter(t for _, w, _, _ in self.items for t in set(w))
            counted = holding, len(self.items), sum(len(w) for _, w in cut) / max(1, len(cut))
        holding, n, mean = counted
        postings: dict[bytes, list[tuple[int, float]]] = {}
        impact: list[dict[bytes, float]] = []
        for i, (_, words) in enumerate(cut):
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {t: math.log(1 + (n - holding[t] + 0.5) / (holding[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(words).items()}
            whole = sum(weight.values())
            impact.append({t: w / whole for t, w in weight.items()})
            for t, w in impact[-1].items():
                postings.setdefault(t, []).append((i, w))
        self.term = {t: k for k, t in enumerate(postings)}
        # A piece's commonest terms may give COMMON of the threshold together; the rest must come from its other terms,
        # whose postings are kept a second time, as flat arrays by term.
        self.rest = np.zeros(len(cut))
        needed: list[list[tuple[int, float]]] = [[] for _ in postings]
        for i, own in enumerate(impact):
            common = 0.0
            for t in sorted(own, key=lambda t: (-holding[t], t)):
                if common + own[t] <= COMMON * threshold:
                    common += own[t]
                else:
                    needed[self.term[t]].append((i, own[t]))
            self.rest[i] = threshold - common - 1e-9
        self.first = np.cumsum([0, *map(len, needed), 0])  # the last list is for words of no item
        self.needed_item = np.array([i for x in needed for i, _ in x], np.int64)
        self.needed_impact = np.array([w for x in needed for _, w in x])
        self.postings = list(postings.values())
        self.blocks = [[max(w for _, w in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.postings]
        self.most = np.array([max(b) for b in self.blocks] + [0.0])  # the last is for words of no item
        self.longest = max((len(w) for _, w, _, _ in self.items), default=0)

    def likely(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the passages of a text (term numbers of its words) in which needed terms may lift a piece to the threshold.

        Passages are taken in runs whose words have RUN_POSTINGS needed postings together, one passage at least.
        """
        ends, n = np.cumsum(self.first[ids + 1] - self.first[ids]), len(passages(len(ids)))
        found, start = [np.empty(0, np.int64)], 0
        while start < n:
            word = start * STRIDE
            full = int(np.searchsorted(ends, RUN_POSTINGS + (ends[word - 1] if word else 0), "right"))
            end = min(n, max(start + 1, (full - PASSAGE) // STRIDE + 1 if full < len(ids) else n))
            found.append(start + self._likely(ids[word : (end - 1) * STRIDE + PASSAGE], end - start))
            start = end
        return np.concatenate(found)

    def _likely(self, ids: np.ndarray, n: int) -> np.ndarray:
        """The same of the n passages of one run."""
        count = self.first[ids + 1] - self.first[ids]
        at = np.flatnonzero(count)
        if not len(at):
            return at
        count = count[at]
        posting = np.repeat(self.first[ids[at]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, impact, last = self.needed_item[posting], self.needed_impact[posting], np.repeat(at // STRIDE, count)
        held = [last - k for k in range(PASSAGE // STRIDE)]  # passages that have a word: the last that begins before it, and others
        keys = np.concatenate([p * len(self.rest) + item for p in held])
        good = np.concatenate([(p >= 0) & (p < n) for p in held])
        found, place = np.unique(keys[good], return_inverse=True)
        sums = np.bincount(place, np.tile(impact, len(held))[good], minlength=len(found))
        return np.unique(found[sums >= self.rest[found % len(self.rest)]] // len(self.rest))

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (piece, score) with a score of at least threshold, by block-max WAND."""
        end, slack = len(self.owner), 1e-9
        lists = [[self.postings[t][0][0], t, 0] for t in query]  # piece it stands at, term, place
        found = []

        def seek(x: list, item: int) -> None:
            p, at = self.postings[x[1]], x[2]
            while at < len(p) and p[at][0] < item:
                # whole blocks that end before the item are jumped over
                last = min(len(p), (at // BLOCK + 1) * BLOCK) - 1
                at = last + 1 if p[last][0] < item else at + 1
            x[0], x[2] = (p[at][0] if at < len(p) else end), at

        while True:
            lists = sorted(x for x in lists if x[0] < end)
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += self.most[x[1]]
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            blocks = 0.0
            for x in lists[: pivot + 1]:
                seek_at = x[2]
                p = self.postings[x[1]]
                while seek_at < len(p) and p[min(len(p), (seek_at // BLOCK + 1) * BLOCK) - 1][0] < item:
                    seek_at = (seek_at // BLOCK + 1) * BLOCK
                if seek_at < len(p):
                    blocks += self.blocks[x[1]][seek_at // BLOCK]
            for x in lists[: pivot + 1]:
                seek(x, item)
            if blocks >= threshold - slack:
                here = [x for x in lists[: pivot + 1] if x[0] == item]
                score = sum(self.postings[x[1]][x[2]][1] for x in here)
                if score >= threshold - slack:
                    found.append((item, score))
            for x in lists[: pivot + 1]:
                if x[0] == item:
                    seek(x, item + 1)


def passages(n: int) -> np.ndarray:
    """Starts of the passages of n words: every STRIDE words until one reaches the end."""
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE) if n else np.empty(0, np.int64)


def share(part: set, words: list[bytes]) -> float:
    """Share of the n-grams of a part that the words hold."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    return len(part & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(part)


def matches_in(words: list[bytes], index: Index, threshold: float = THRESHOLD, low: int = 0, high: int | None = None) -> list[tuple]:
    """(place of the item in the index, best score, question share, answer share, first word of the best passage), verified.

    Only passages that begin from word `low` on and before word `high` are queries; the words around them are there for the check.
    """
    other = len(index.term)
    ids = np.fromiter((index.term.get(w, other) for w in words), np.int64, len(words))
    scores: dict[int, dict[int, float]] = {}  # per item its passages
    for passage in index.likely(ids).tolist():
        start = passage * STRIDE
        if start < low or (high is not None and start >= high):
            continue
        query = np.unique(ids[start : start + PASSAGE])
        for piece, score in index.search(query[query < other].tolist(), threshold):
            own = scores.setdefault(index.owner[piece], {})
            own[start] = max(score, own.get(start, 0.0))
    found = []
    for item, own in sorted(scores.items()):
        _, text, question, answer = index.items[item]
        reach = len(text)
        first, last = max(0, min(own) - reach), min(len(words), max(own) + PASSAGE + reach)
        together = words[first:last]
        if len(own) * (PASSAGE + 2 * reach) > last - first and (share(question, together) < QUESTION or share(answer, together) < ANSWER):
            continue  # all passages together do not hold enough
        for start, score in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            around = words[max(0, start - reach) : start + PASSAGE + reach]
            held = share(question, around), share(answer, around)
            if held[0] >= QUESTION and held[1] >= ANSWER:
                found.append((item, score, *held, start))
                break
    return found


def parts(text: bytes, reach: int) -> Iterator[tuple[list[bytes], int, int, int | None]]:
    """Words of a text in parts: the words, the place of the first (a multiple of STRIDE), and from and before which of them passages begin.

    Around each passage that begins there, `reach` words on either side are in the part, or all that the text has.
    """
    words, base, low = [], 0, 0
    for block in blocks(text):
        words += terms(block)
        ready = (base + len(words) - PASSAGE - reach) // STRIDE * STRIDE
        if ready - low >= PART_WORDS:
            yield words, base, low - base, ready - base
            low, keep = ready, max(base, (ready - reach) // STRIDE * STRIDE)
            words, base = words[keep - base :], keep
    yield words, base, low - base, None


def matches(text: bytes | None, index: Index, threshold: float = THRESHOLD) -> list[tuple]:
    """What matches_in() gives for all words of a text."""
    best: dict[int, tuple] = {}
    for words, base, low, high in parts(text or b"", index.longest):
        for item, score, question, answer, start in matches_in(words, index, threshold, low, high):
            if item not in best or score > best[item][1]:
                best[item] = item, score, question, answer, base + start
    return [best[k] for k in sorted(best)]


def indexes(benchmark: DataFrame, threshold: float, shard_words: int) -> Iterator[Index]:
    """The index of each shard of the benchmark, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [[b - a for a, b in pieces(len(terms(t)))] for _, t in columns(batch)]
        sizes = [pa.array(x, pa.int64()) for x in ([len(c) for c in cut], [sum(c) for c in cut])]
        return pa.RecordBatch.from_arrays([*batch.columns, *sizes], [*batch.schema.names, "pieces", "words"])

    items = map_arrow(items, measured, "item_id long, text string, pieces long, words long").where("words > 0")
    items = shared_table(items.withColumn("number", F.monotonically_increasing_id()), "items")
    n, n_pieces, n_words = items.agg(F.count("*"), F.sum("pieces"), F.sum("words")).first()
    if not n:
        yield Index([], threshold)
        return
    shards = -(-n_words // shard_words)
    items = items.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(shard, t) for shard, text in columns(batch) for t in set(terms(text))]
        return pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["shard", "term"])

    each = map_arrow(items.select("shard", "text"), held, "shard long, term binary").groupBy("shard", "term").agg(F.count("*").alias("own"))
    each = shared_table(each, "terms")
    counts = each.join(each.groupBy("term").agg(F.sum("own").alias("items")), "term").select("shard", "term", "items")

    def build(key: tuple, own: pa.Table, counts: pa.Table) -> pa.Table:
        own = own.sort_by("number")
        holding = dict(zip(counts.column("term").to_pylist(), counts.column("items").to_pylist(), strict=True))
        rows = zip(own.column("item_id").to_pylist(), (t.encode() for t in own.column("text").to_pylist()), strict=True)
        index = Index(list(rows), threshold, (holding, n, n_words / n_pieces))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([cloudpickle.dumps(index)], pa.binary())})

    built = items.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(build, "shard long, index binary")
    built = shared_table(built, "indexes")
    for shard in range(shards):
        for row in built.where(F.col("shard") == shard).select("index").collect():  # one shard
            yield cloudpickle.loads(row[0])


SCHEMA = "doc_id long, item_id long, score double, question_share double, answer_share double, first_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share, first_word: every verified match of a document and an item."""
    docs, arrow = texts(docs), to_arrow_schema(_parse_datatype_string(SCHEMA))

    def scanned(index: Index) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def match(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            index = shared.value
            rows = [(doc_id, index.items[m[0]][0], *m[1:]) for doc_id, text in columns(batch) for m in matches(text, index, threshold)]
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        return map_arrow(docs, match, SCHEMA), shared

    out, shared = None, None
    for index in indexes(benchmark, threshold, shard_words):
        if shared is not None:  # the scan before is written, and its index goes
            out = shared_table(out, "matches")
            shared.destroy()
        part, shared = scanned(index)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The whole rows of docs that match no test item, decided in place: nothing but a scan for each index shard."""
    schema, place = docs.schema, docs.columns.index("text")
    out, shared = docs, None
    for index in indexes(benchmark, threshold, shard_words):
        if shared is not None:
            out = shared_table(out, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts_of = batch.column(place).cast(pa.binary())
            return batch.filter(pa.array([not matches(t.as_py(), shared.value, threshold) for t in texts_of], pa.bool_()))

        out = map_arrow(out, keep, schema)
    return out
