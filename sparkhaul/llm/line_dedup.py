"""Operator 6, line dedup: two Bloom filters, then exact confirmation of the suspected repeats.

1. Lines whose key is long enough to count are counted, which sizes the filters: BITS_PER_LINE bits for each.
2. Every map task puts the keys of its lines (each key once per document) into a pair of Bloom filters:
   *once*, and *twice* for keys whose bits were all there already. Pairs merge by
   once = a | b, twice = ta | tb | (a & b): a key that two documents hold always ends up in *twice*. Filters travel
   as compressed segments and merge segment by segment. The *twice* filter goes to all tasks.
   Beyond MOST_BITS that would be too large for a task. Then 64-bit hashes of the keys go to owners by range of hash,
   each owner has a pair of filters of its own share, and the hashes in its *twice* filter come back by look-up.
3. Only suspected keys shuffle as text, pre-aggregated per task, for the exact number of documents and the document
   that keeps them. This is written once.
4. Confirmed keys go back by look-up: broadcast up to a bound, joined beyond it (see with_lookup).

A full filter suspects more lines, which costs shuffle but never changes the result. Null and empty texts are one
empty line. Documents are rows: rows repeated with one id count separately, and all of them keep the lines that their id keeps.
A document without id counts as a holder, and keeps the line only where no holder has an id. Keys are equal
byte by byte; a line keeps its own spelling. A long text is split once into its lines. An empty table gives no rows. Other columns,
also those named like the new ones, are ignored by line_dedup and pass through untouched in without_repeated_lines, but
for n_chars, which becomes the new length of the text where docs has it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import columns, map_arrow, shared_table, signed, texts, with_lookup

#: Bits for each line that counts, bits set per line, the most bits of a filter that all tasks hold, and segments in which filters travel.
BITS_PER_LINE, PROBES, MOST_BITS, SEGMENTS = 12, 3, 1 << 28, 64
#: Hashes that an owner of a range of hashes has.
OWNER_LINES = 2_000_000
#: A key is dropped from this many code points and this many documents on.
LEAST_CHARS, LEAST_DOCS = 40, 5

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and their keys; None for keys that are too short to count."""
    lines = (text or b"").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK).lower() if len(line) >= least_chars else b""
        # code points: bytes less continuation bytes
        keys.append(key if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars) else None)
    return lines, keys


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class Filter:
    """A Bloom filter of packed bits."""

    def __init__(self, bits: int, held: np.ndarray | None = None):
        self.bits, self.held = bits, np.zeros(bits // 8, np.uint8) if held is None else held

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit of the PROBES places of each hash, by double hashing."""
        step = (h >> np.uint64(32)) | np.uint64(1)
        at = (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(self.bits)
        return (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8)

    def has(self, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return (self.held[places[0]] & places[1] != 0).all(axis=1)

    def put(self, places: tuple[np.ndarray, np.ndarray]) -> None:
        np.bitwise_or.at(self.held, places[0].ravel(), places[1].ravel())


def see(once: Filter, twice: Filter, h: np.ndarray) -> None:
    """Puts distinct hashes into once, and those that were there already into twice."""
    places = once.places(h)
    again = once.has(places)
    twice.put((places[0][again], places[1][again]))
    once.put(places)


def filter_bits(lines: int) -> int:
    """A power of two with BITS_PER_LINE bits a line at least, and whole bytes in each segment."""
    return max(8 * SEGMENTS, 1 << (BITS_PER_LINE * max(1, lines) - 1).bit_length())


def long_lines(docs: DataFrame, least_chars: int) -> int:
    """Lines of docs that are long enough to count, before blanks at their ends go."""
    long = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= least_chars)
    return docs.agg(F.sum(F.size(long))).first()[0] or 0


def distinct_hashes(text: bytes | None, least_chars: int) -> tuple[list[bytes], np.ndarray]:
    """The keys of a text that count, each once, and their hashes."""
    keys = list({k for k in line_keys(text, least_chars)[1] if k})
    return keys, hashes(keys)


def twice_filter(docs: DataFrame, bits: int, least_chars: int) -> np.ndarray:
    """The packed bits of the merged *twice* filter."""
    size = bits // 8 // SEGMENTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        any_rows = False
        for batch in batches:
            for _, text in columns(batch):
                h = distinct_hashes(text, least_chars)[1]
                if len(h):
                    see(once, twice, h)
                    any_rows = True
        if any_rows:
            for k in range(SEGMENTS):
                part = slice(k * size, (k + 1) * size)
                codes = (pa.array([zlib.compress(x.held[part].tobytes(), 1)], pa.binary()) for x in (once, twice))
                yield pa.record_batch([pa.array([k], pa.int32()), *codes], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, *codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(c), np.uint8) for c in codes)
                pair = held.setdefault(segment, [np.zeros(size, np.uint8), np.zeros(size, np.uint8)])
                pair[1] |= b | (pair[0] & a)
                pair[0] |= a
        for segment, (_, b) in held.items():
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([b.tobytes()], pa.binary())], ["segment", "twice"])

    pairs = docs.mapInArrow(build, "segment int, once binary, twice binary")
    merged = pairs.repartition(SEGMENTS, "segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros((SEGMENTS, size), np.uint8)
    for segment, twice in merged.toLocalIterator():  # SEGMENTS rows of a fixed size
        out[segment] = np.frombuffer(twice, np.uint8)
    return out.ravel()


def owners_suspects(docs: DataFrame, lines: int, least_chars: int) -> DataFrame:
    """key: hashes of keys that owners' *twice* filters hold, each owner having a range of hashes."""
    owners = -(-lines // OWNER_LINES)

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = np.concatenate([np.empty(0, np.uint64), *(distinct_hashes(t, least_chars)[1] for _, t in columns(batch))])
        distinct, count = np.unique(h, return_counts=True)
        h = np.repeat(distinct, np.minimum(count, 2))  # a third holder in one batch tells an owner nothing new
        owner = ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        return pa.record_batch([pa.array(owner.astype(np.int32)), signed(h)], ["owner", "key"])

    def suspected(share: pa.Table) -> pa.Table:
        h = share.column("key").to_numpy().view(np.uint64)
        once, twice = (Filter(filter_bits(len(h))) for _ in range(2))
        order = np.argsort(h, kind="stable")
        first = np.r_[True, h[order][1:] != h[order][:-1]]
        see(once, twice, h[order][first])
        twice.put(once.places(h[order][~first]))
        distinct = h[order][first]
        return pa.table({"key": signed(distinct[twice.has(twice.places(distinct))])})

    sent = map_arrow(docs, send, "owner int, key long")
    return sent.groupBy("owner").applyInArrow(suspected, "key long")


def confirmed_lines(
    docs: DataFrame, bits: int | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS
) -> DataFrame:
    """key_text, docs, keeper: the keys that enough documents hold, and the document that keeps them. bits: else by the lines."""
    docs = texts(docs)
    lines = 0 if bits else long_lines(docs, least_chars)
    bits = bits or filter_bits(lines)

    def rows(ids: list, found: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key_text"])

    if bits <= most_bits:
        shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, least_chars))

        def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
            twice, ids, found = Filter(bits, shared.value), [], []
            for doc_id, text in columns(batch):
                keys, h = distinct_hashes(text, least_chars)
                if keys:
                    at = np.flatnonzero(twice.has(twice.places(h)))
                    found += [keys[i] for i in at]
                    ids += [doc_id] * len(at)
            return rows(ids, found)

        pairs = map_arrow(docs, suspects, "doc_id long, key_text binary")
    else:

        def looked_up(batch: list) -> pa.RecordBatch:
            ids, found = [], []
            for doc_id, text, lookup in batch:
                keys, h = distinct_hashes(text, least_chars)
                at = np.flatnonzero(lookup.find(h)[0])
                found += [keys[i] for i in at]
                ids += [doc_id] * len(at)
            return rows(ids, found)

        known = shared_table(owners_suspects(docs, lines, least_chars), "suspects")
        keys_of = lambda text: distinct_hashes(text, least_chars)[1]
        pairs = with_lookup(docs, known, keys_of, looked_up, "doc_id long, key_text binary")
    grouped = pairs.groupBy("key_text").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
    return shared_table(grouped.where(F.col("docs") >= least_docs), "confirmed")


def _split_hash(keys: DataFrame) -> DataFrame:
    """key and check (two 64-bit hashes of a key's bytes), its keeper, and whether there is one: 0 where no holder has an id."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).to_pylist()
        both, check = ([f(k) for k in names] for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest))
        as_long = [signed(np.array(x, np.uint64)) for x in (both, check)]
        return pa.record_batch([*as_long, batch.column(1), batch.column(2)], ["key", "check", "keeper", "kept"])

    told = keys.select("key_text", F.coalesce("keeper", F.lit(0)).alias("keeper"), F.col("keeper").isNotNull().cast("long").alias("kept"))
    return map_arrow(told, of, "key long, check long, keeper long, kept long")


def apply_lines(
    docs: DataFrame, confirmed: DataFrame, row: Callable, names: list[str], schema: str, least_chars: int = LEAST_CHARS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """row(doc_id, text, lines, dropped mask) -> tuple, for every document, with the columns to carry behind."""

    def keys_of(text: bytes | None) -> np.ndarray:
        return hashes([k for k in line_keys(text, least_chars)[1] if k])

    def consume(rows: list) -> pa.RecordBatch:
        out = []
        for doc_id, text, lookup in rows:
            lines, keys = line_keys(text, least_chars)
            dropped = np.zeros(len(lines), bool)
            at = [i for i, k in enumerate(keys) if k]
            if at:
                hit, place = lookup.find(hashes([keys[i] for i in at]))
                check, keeper, kept = lookup.values
                for i, p in zip(np.flatnonzero(hit), place, strict=True):
                    same = int(check[p]) & 0xFFFFFFFFFFFFFFFF == xxhash.xxh64_intdigest(keys[at[i]])
                    own = doc_id == keeper[p] if doc_id is not None and kept[p] else doc_id is None and not kept[p]
                    dropped[at[i]] = same and not own
            out.append(row(doc_id, text, lines, dropped))
        return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)}, arrow) if out else None

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return with_lookup(docs, _split_hash(confirmed), keys_of, consume, schema, carry=carry)


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_dedup(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, text (what is left of it, null where it was null), n_lines, n_dropped for every document."""

    def row(doc_id, text, lines, dropped):
        kept = None if text is None else b"\n".join(x for x, d in zip(lines, dropped, strict=True) if not d).decode()
        return doc_id, kept, len(lines), int(dropped.sum())

    schema = "doc_id long, text string, n_lines long, n_dropped long"
    return apply_lines(docs, confirmed_lines(docs, **limits), row, ["doc_id", "text", "n_lines", "n_dropped"], schema, limits.get("least_chars", LEAST_CHARS))


def without_repeated_lines(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs, all columns, with what is left of their text; n_chars, where docs has it, is its new length."""

    def row(doc_id, text, lines, dropped):
        return doc_id, None if text is None else b"\n".join(x for x, d in zip(lines, dropped, strict=True) if not d).decode()

    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    least = limits.get("least_chars", LEAST_CHARS)
    out = apply_lines(docs, confirmed_lines(docs, **limits), row, ["doc_id", "text"], "doc_id long, text string", least, carry)
    if "n_chars" in carry:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def line_dedup_digest(docs: DataFrame, **limits) -> DataFrame:
    """As line_dedup, with the SHA-256 of the text that is left instead of the text."""

    def row(doc_id, text, lines, dropped):
        kept = b"\n".join(x for x, d in zip(lines, dropped, strict=True) if not d)
        return doc_id, len(lines), int(dropped.sum()), hashlib.sha256(kept).hexdigest()

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return apply_lines(docs, confirmed_lines(docs, **limits), row, names, DIGEST, limits.get("least_chars", LEAST_CHARS))
