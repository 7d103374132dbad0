"""Operator 9, substring dedup: relative Lempel-Ziv parsing of documents against each other, in phrases with indexed positions.

The reference is the whole corpus. Its blocks are indexed at content-defined positions: of every window of `words`
consecutive words one q-gram (q = half a window), the one with the least hash, is the *seed*, and the windows in a row
that share their seed make one *phrase*. Equal text has equal seeds and phrases wherever it stands, so every factor of
a window or more can be found from its seeds, and only documents and blocks that share a seed ever meet.

1. Index: seeds that occur twice or more, counted in one pre-aggregated shuffle. Only their occurrences go on, with the
   place in the text (t, word) where they stand.
2. Reference: each distinct phrase of such a seed has its first and last place in the corpus as its source, and the number of
   places. A phrase found twice is copied whole; the source of an occurrence is never itself.
3. Boundaries: where a seed has phrases that occur once, words around it differ, and a factor begins or ends there. Of each
   distinct phrase of such a seed the windows are compared one by one with those of the seed's other phrases, by
   hash, taken from one text that holds the phrase.
4. Parse: each text is read from left to right. A factor (start, length, source text, source word) goes on while the next
   phrase is copied from the same source at the same distance; runs of windows found at boundaries are factors
   whose source is not told. Every factor is at least a window long, and its words go.

The result is exact up to hashes of 128 bits (seed and window, over 64-bit hashes of words): a window is removed if and
only if its words also start elsewhere, in the same document or another. What is left is not parsed again.

Null and empty texts have no words. Rows repeated with one id, or without id, are documents of their own: all joins are by
text number or by a 128-bit hash of the text, so they make no group. A seed or phrase that a large part of all texts hold is one row
in each join that it is looked up in; adaptive execution splits the other side. A long text is hashed in blocks of
words, and a phrase across two blocks is two. Columns other than doc_id and text are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import BROADCAST_ROWS, Grams, blocks, columns, drop_shared, joined, map_arrow, shared_table, slices, texts, with_longs, word_hashes

#: Words in a window.
WORDS = 35
#: A mask with every window of a phrase (a phrase has fewer than 63 windows up to windows of 124 words).
ALL = -1

FACTOR = "array<struct<start:long, length:long, source:long, source_start:long>>"


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least element (the leftmost of equals) of each `width` consecutive ones, by doubling."""
    value, place, reach = h, np.arange(len(h)), 1
    while reach < width:
        step = min(reach, width - reach)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        reach += step
    return place


def phrases(text: bytes | None, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Seeds, phrase hashes, first window and number of windows of the phrases of a text, and the hashes of all windows, block by block.

    Windows are numbered over the whole text; the last array begins at the first window of the block.
    """
    q, before, base = (words + 1) // 2, np.empty(0, np.uint64), 0
    for block in blocks(text or b""):
        h = np.concatenate([before, word_hashes(block)])
        n = len(h) - words + 1
        if n > 0:
            grams = Grams(h)
            short, windows = grams.of(q), grams.of(words)
            at = least_in_windows(short, words - q + 1)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], n] - 1
            shape = ((at[first] - first) * words + last - first).astype(np.uint64)
            yield short[at[first]], joined(joined(windows[first], windows[last]), shape), first + base, last - first + 1, windows
            base, before = base + n, h[n:]
        else:
            before = h


def text_keys(text: bytes | None) -> tuple[int, int]:
    """Two signed 64-bit hashes of a text."""
    both = xxhash.xxh3_128_intdigest(text or b"")
    return (both >> 64) - (1 << 63), (both & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def arrays(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) if p.dtype == np.uint64 else p for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64), pa.int64()).cast(kind))


def phrase_table(docs: DataFrame, words: int) -> DataFrame:
    """t (a number), k1, k2 (see text_keys), and arrays with an element for each phrase of every text with a window."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, found = [], []
        for _, text in columns(batch):
            parts = [p[:4] for p in phrases(text, words)]
            if parts:
                keys.append(text_keys(text))
                found.append([np.concatenate(x) for x in zip(*parts, strict=True)])
        ids = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        lists = [arrays([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int16()))]
        return pa.record_batch([*ids, *lists], ["k1", "k2", "seed", "phrase", "first", "windows"])

    schema = "k1 long, k2 long, seed array<long>, phrase array<long>, first array<int>, windows array<short>"
    return shared_table(map_arrow(texts(docs), emit, schema).withColumn("t", F.monotonically_increasing_id()), "phrases")


def occurrences(table: DataFrame) -> DataFrame:
    """t, seed, phrase, first, windows of every phrase whose seed occurs at least twice."""
    # written first: a join whose both sides are shuffled for it can be split where a seed is in very many places
    seeds = shared_table(table.select(F.explode("seed").alias("seed")).groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    each = table.select("t", F.explode(F.arrays_zip("seed", "phrase", "first", "windows")).alias("p")).select("t", "p.*")
    out = shared_table(each.join(seeds, "seed").select("t", "seed", "phrase", "first", "windows"), "occurrences")
    drop_shared(seeds)
    return out


def joined_to_texts(docs: DataFrame, own: DataFrame, kind: str) -> DataFrame:
    """doc_id, text and the columns of own (k1, k2 and more) of documents; kind: inner or left.

    Up to BROADCAST_ROWS texts of own, their hashes are broadcast first, and only documents that have one shuffle.
    """
    more = [c for c in own.columns if c not in ("k1", "k2")]

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [text_keys(t) for _, t in columns(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], [*batch.schema.names, "k1", "k2"])

    keyed = map_arrow(docs, hashed, with_longs(docs.schema, "k1", "k2"))
    if own.select("k1").limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return keyed.join(own, ["k1", "k2"], kind).select("doc_id", "text", *more)
    few = F.broadcast(own.select("k1"))
    found = keyed.join(few.distinct(), "k1", "left_semi").join(own.hint("shuffle_merge"), ["k1", "k2"], kind).select("doc_id", "text", *more)
    if kind == "inner":
        return found
    none = keyed.join(few, "k1", "left_anti").select("doc_id", "text", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in more))
    return found.union(none)


def boundary_masks(docs: DataFrame, table: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """seed, phrase, mask of the distinct phrases at boundaries: bit k is set if window k of the phrase occurs at least twice."""
    unclear = distinct.groupBy("seed").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("seed")
    asked = distinct.join(unclear, "seed").select("seed", "phrase", "n", F.col("lo.t").alias("t"), F.col("lo.first").alias("first"))
    asked = asked.join(table.select("t", "k1", "k2"), "t")
    own = shared_table(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "seed", "phrase", "n")).alias("asked")), "asked")

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (_, text), wanted in zip(columns(batch), batch.column(2), strict=True):
            first, seed, phrase, n = (x.to_numpy() for x in wanted.values.flatten())
            order = np.argsort(first)
            base = 0
            for _, _, starts, counts, windows in phrases(text, words):
                at = order[np.isin(first[order], starts)]
                size = counts[np.searchsorted(starts, first[at])]
                owner = np.repeat(at, size)
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hashes = windows[first[owner] + k - base]
                base += len(windows)
                values = (seed[owner], phrase[owner], k.astype(np.int16), hashes.view(np.int64), n[owner])
                yield pa.record_batch([pa.array(x) for x in values], ["seed", "phrase", "k", "window", "n"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from emit(part)

    found = joined_to_texts(docs, own, "inner").mapInArrow(every, "seed long, phrase long, k short, window long, n long")
    # rows with equal texts give equal windows
    found = shared_table(found.groupBy("seed", "phrase", "k").agg(F.min("window").alias("window"), F.min("n").alias("n")), "windows")
    again = found.groupBy("seed", "window").agg(F.sum("n").alias("n")).where("n > 1").select("seed", "window")
    out = found.join(again, ["seed", "window"]).groupBy("seed", "phrase").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    out = shared_table(out, "masks")
    drop_shared(own, found)
    return out


def factors_of(first: np.ndarray, count: np.ndarray, mask: np.ndarray, source: np.ndarray, source_first: np.ndarray, words: int) -> list[dict]:
    """Factors of a text from its phrases that repeat: greedy, from left to right. source: -1 for a phrase that is not copied whole."""
    order = np.argsort(first)
    out: list[dict] = []
    end = shift = -1  # window behind the current factor, and its distance from its source
    for i in order.tolist():
        a, n = int(first[i]), int(count[i])
        if source[i] >= 0:
            if out and end == a and out[-1]["source"] == source[i] and shift == source_first[i] - a:
                out[-1]["length"] += n
            else:
                out.append({"start": a, "length": n + words - 1, "source": int(source[i]), "source_start": int(source_first[i])})
            end, shift = a + n, int(source_first[i]) - a
            continue
        k = 0
        while k < n:
            if not mask[i] >> k & 1:
                k += 1
                continue
            begin = k
            while k < n and mask[i] >> k & 1:
                k += 1
            if out and end == a + begin and out[-1]["source"] is None:
                out[-1]["length"] += k - begin
            else:
                out.append({"start": a + begin, "length": k - begin + words - 1, "source": None, "source_start": None})
            end = a + k
    return out


def parsed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """k1, k2, t, factors of each distinct text that has any; source is the t of another text, or of this one at another word."""
    docs = texts(docs)
    table = phrase_table(docs, words)
    found = occurrences(table)
    place = F.struct("t", "first")
    distinct = found.groupBy("seed", "phrase").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    distinct = shared_table(distinct, "distinct")
    masks = boundary_masks(docs, table, distinct, words)
    told = distinct.join(masks, ["seed", "phrase"], "left").where("n > 1 OR mask IS NOT NULL")
    own = found.join(told, ["seed", "phrase"])
    source = F.when(F.col("n") > 1, F.when(F.col("lo") == place, F.col("hi")).otherwise(F.col("lo")))
    row = F.struct("first", "windows", F.when(F.col("n") > 1, ALL).otherwise(F.col("mask")).alias("mask"), source.alias("source"))
    by_text = own.groupBy("t").agg(F.collect_list(row).alias("rows"))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for rows in batch.column(1):
            first, count, mask, source = rows.values.flatten()
            at, start = (x.fill_null(-1).to_numpy(zero_copy_only=False) for x in (source.field(0), source.field(1)))
            at = np.where(source.is_valid().to_numpy(zero_copy_only=False), at, -1)
            out.append(factors_of(first.to_numpy(), count.to_numpy(), mask.to_numpy(), at, start, words))
        return pa.record_batch([batch.column(0), pa.array(out, kind)], ["t", "factors"])

    kind = to_arrow_schema(_parse_datatype_string(f"factors {FACTOR}")).field(0).type
    factors = map_arrow(by_text, parse, f"t long, factors {FACTOR}").where(F.size("factors") > 0)
    out = factors.join(table.select("t", "k1", "k2"), "t").groupBy("k1", "k2").agg(F.min("t").alias("t"), F.min_by("factors", "t").alias("factors"))
    out = shared_table(out, "factors")
    drop_shared(table, found, distinct, masks)
    return out


def removed_words(factors: list | None, n: int) -> np.ndarray | None:
    """Whether a factor covers each of n words; None if there is no factor."""
    if not factors:
        return None
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, [f["start"] for f in factors], 1)
    np.add.at(edges, [f["start"] + f["length"] for f in factors], -1)
    return np.cumsum(edges[:-1]) > 0


def parse(docs: DataFrame, row: Callable, names: list[str], schema: str, words: int) -> DataFrame:
    """row(doc_id, n_words, n_removed, kept text) -> tuple, for every document."""
    docs = texts(docs)
    both = joined_to_texts(docs, parsed(docs, words).select("k1", "k2", "factors"), "left")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for (doc_id, text), factors in zip(columns(part), part.column(2).to_pylist(), strict=True):
                    out.append(row(doc_id, *kept_words(text, factors)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names)

    return both.mapInArrow(remove, schema)


def kept_words(text: bytes | None, factors: list | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept ones joined by one space; a long text is split in blocks."""
    n, kept, removed = 0, [], None
    if factors:
        removed = removed_words(factors, max(f["start"] + f["length"] for f in factors))
    gone = int(removed.sum()) if removed is not None else 0
    for block in blocks(text or b""):
        tokens = block.split()
        if removed is not None and n < len(removed):
            mask = removed[n : n + len(tokens)]
            own = [t for t, x in zip(tokens, mask.tolist(), strict=False) if not x] + tokens[len(mask) :]
        else:
            own = tokens
        n += len(tokens)
        if own:
            kept.append(b" ".join(own))
    return n, gone, b" ".join(kept)


def substring_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space)."""

    def row(doc_id, n, gone, kept):
        return doc_id, n, gone, kept.decode()

    return parse(docs, row, ["doc_id", "n_words", "n_removed", "text"], "doc_id long, n_words long, n_removed long, text string", words)


def substring_dedup_digest(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """As substring_dedup, with the SHA-256 of the text that is left."""

    def row(doc_id, n, gone, kept):
        return doc_id, n, gone, hashlib.sha256(kept).hexdigest()

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return parse(docs, row, names, "doc_id long, n_words long, n_removed long, kept_sha256 string", words)
