"""Operator 8, exact dedup: Golomb-coded fingerprint exchange, then byte verification of the suspects.

1. Every map task fingerprints its normalised texts, sorts the distinct fingerprints by owner (the top bits
   choose the owner) and codes each owner's gaps with a Golomb-Rice code: one message per (sender, owner), kept in
   an outbox table in the shared folder beside the ids. To the owners only the coded messages shuffle.
2. An owner merges its senders' messages and answers each with a bitmap: which of its fingerprints another
   sender has as well. Fingerprints that repeat inside one sender are suspects without asking. The bitmaps are joined to the outbox's
   rows of ids and digests by sender and owner: where they are too large to be broadcast, those rows (some 50 bytes a document)
   shuffle once, without texts.
3. Only suspects' texts are read again and shuffled, grouped by their bytes (pre-aggregated in each map task,
   so a group of copies costs one row per task). The group gives the row that stays.

The number of owners follows the number of rows, so an owner's share is bounded (OWNER_ROWS), and senders gather SEND_ROWS
where there are many, so messages are not many and small. A group of copies is one row in the join that tells its
rows their result; where one group has a large part of all rows, adaptive execution splits its rows over tasks.

Rows with equal normalised text form a group, rows repeated with one id included (each of those that carry the
largest id has kept = true). Null text counts as empty. A row without id never stays while its group has an id.
Texts of any length are hashed whole. Columns other than doc_id and text are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import columns, drop_shared, keep_ids, map_arrow, shared_table, texts

#: Bits of a fingerprint: N documents give about N * N / 2**(BITS + 1) false pairs, which only cost a verification.
BITS = 48
#: Rows whose fingerprints a map task gathers before it sends its messages, and rows for each owner.
SEND_ROWS, OWNER_ROWS = 200_000, 1_000_000


def golomb_encode(sorted_values: np.ndarray, span: int) -> bytes:
    """Golomb-Rice code of ascending distinct values below span: a header, then unary quotients and k-bit remainders of the gaps."""
    n = len(sorted_values)
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, 0.69 * span / max(1, n)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    rests = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return np.array([n, k, len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + np.packbits(rests).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    n, k, length = (int(x) for x in np.frombuffer(code, "<u4", 3))
    cut = 12 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(code[12:cut], np.uint8), count=length)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rests = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    low = (rests << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()  # bytes.lower() touches A-Z only


def _outbox(docs: DataFrame, owners: int) -> DataFrame:
    span = (1 << BITS) // owners + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, ids, prints, digests = TaskContext.get().partitionId(), 0, [], [], []

        def messages() -> pa.RecordBatch:
            values = np.array(prints, np.uint64)
            order = np.argsort(values, kind="stable")
            values = values[order]
            owner = (values // np.uint64(span)).astype(np.int64)
            rows = []
            for o in np.unique(owner):
                at = order[owner == o]
                own = values[owner == o]
                distinct, place, count = np.unique(own, return_inverse=True, return_counts=True)
                rows.append({
                    "sender": (task << 20) | part,
                    "owner": int(o),
                    "code": golomb_encode(distinct - np.uint64(int(o) * span), span),
                    "ids": [ids[i] for i in at],
                    "digests": [digests[i] for i in at],
                    "place": place.tolist(),
                    "local": (count[place] > 1).tolist(),
                })
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for doc_id, text in columns(batch):
                norm = normalised(text)
                ids.append(doc_id)
                prints.append(xxhash.xxh3_64_intdigest(norm) >> (64 - BITS))
                digests.append(hashlib.sha256(norm).digest())
            if len(ids) >= SEND_ROWS:
                yield messages()
                part += 1
                ids, prints, digests = [], [], []
        if ids:
            yield messages()

    rows = "sender long, owner long, code binary, ids array<long>, digests array<binary>, place array<int>, local array<boolean>"
    schema = to_arrow_schema(_parse_datatype_string(rows))
    return docs.mapInArrow(send, rows)


def _answer(messages: pa.Table) -> pa.Table:
    """For each message of one owner, the bitmap of the fingerprints that other senders have too."""
    parts = [golomb_decode(c) for c in messages.column("code").to_pylist()]
    values, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    repeated = count[place] > 1
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bitmaps = [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]
    return pa.table({"sender": messages.column("sender"), "owner": messages.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    owners: fingerprint owners, by default one for each OWNER_ROWS rows, but no fewer than Spark has cores.
    """
    docs = texts(docs)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.count()
    owners = owners or max(cores, -(-rows // OWNER_ROWS))
    docs = docs.coalesce(max(8 * cores, -(-rows // SEND_ROWS)))  # merges small scan tasks only where there are very many
    outbox = shared_table(_outbox(docs, owners), "outbox")
    answers = outbox.select("sender", "owner", "code").groupBy("owner").applyInArrow(_answer, "sender long, owner long, bitmap binary")
    rows = outbox.drop("code").join(answers, ["sender", "owner"])

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests, suspect = [], [], []
        for r in batch.to_pylist():
            bits = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8)).astype(bool)
            ids += r["ids"]
            digests += [d.hex() for d in r["digests"]]
            suspect += (bits[np.array(r["place"], np.int64)] | np.array(r["local"], bool)).tolist()
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests), pa.array(suspect)], ["doc_id", "text_sha256", "suspect"])

    told_rows = map_arrow(rows.select("ids", "digests", "place", "local", "bitmap"), told, "doc_id long, text_sha256 string, suspect boolean")
    told_rows = shared_table(told_rows, "suspects")
    drop_shared(outbox)
    suspects = told_rows.where("suspect")
    nulls = docs.where("doc_id is null")
    again = keep_ids(docs, suspects.select("doc_id").where("doc_id is not null").distinct()).union(nulls)

    def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(columns(batch))
        texts_of = pa.array([normalised(t) for _, t in rows], pa.binary())
        return pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), texts_of], ["doc_id", "bytes"])

    groups = map_arrow(again, lowered, "doc_id long, bytes binary").groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(F.sha2("bytes", 256).alias("sha"), "keep_id", "group_size")
    found = suspects.join(groups, suspects.text_sha256 == groups.sha, "left")
    found = found.select("doc_id", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    single = told_rows.where("not suspect").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = single.union(found)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
