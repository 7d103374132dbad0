"""What the text operators share: columns, tables in the shared folder, word and n-gram hashes, look-ups.

A *document frame* has a 64-bit integer id column and a text column; every other column is
ignored and passes through untouched where an operator returns whole documents. Texts are
always read whole. What works on the words of a text takes them in blocks of about BLOCK_BYTES, so the memory
it needs beside the text itself is that of its hashes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

#: Rows up to which a side table is broadcast; beyond it the same work runs as a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Bytes of a text that are split into words at once, and of the texts whose rows are held together in Python.
BLOCK_BYTES = 1 << 20
#: Bytes in an Arrow batch between Spark and Python, unless the session says otherwise.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B97F4A7C15)
_S33, _S29, _S32 = np.uint64(33), np.uint64(29), np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as rows are texts of any length; a bound that the session has set stays."""
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def texts(docs: DataFrame, *more) -> DataFrame:
    """Only the id and text of a document frame, ids as long, with further columns if named."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkhaul-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage and survives lost executors.

    The files go by drop_shared(), else when the driver's file system handle closes, at the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkhaul-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Deletes the files of shared tables that no later plan reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where, files = _path(df.sparkSession, path)
            files.delete(where, True)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(over, schema)


def columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows (id, UTF-8 bytes or None) of a batch with doc_id and text, one at a time."""
    ids = batch.column(0).to_pylist()
    for doc_id, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
        yield doc_id, text.as_py()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two sequences in a row, from their hashes; not linear, so patterns of words do not cancel."""
    return mix(a * _P ^ (a >> _S29)) * _P + mix(b + _P)


class Grams:
    """Hashes of any number of consecutive elements of h, made by doubling and kept for the text at hand."""

    def __init__(self, h: np.ndarray):
        self.made = {1: h}
        self.size = len(h)

    def of(self, n: int) -> np.ndarray:
        """A hash of each n consecutive elements."""
        m = self.size - n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        if n not in self.made:
            half = 1 << ((n - 1).bit_length() - 1)  # the largest power of two below n
            left, right = self.of(half), self.of(n - half)
            self.made[n] = joined(left[:m], right[half : half + m])
        return self.made[n]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    return Grams(h).of(n)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NEXT_BLANK = re.compile(rb"[ \t-\r]")
_LOW = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)  # masks of the first k bytes


def blocks(text: bytes, size: int = 0) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, each cut before a blank, so no word is cut (a longer word stays whole)."""
    size = size or BLOCK_BYTES
    start = 0
    while start < len(text):
        if len(text) - start <= size:
            yield text[start:]
            return
        cut = _NEXT_BLANK.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def _block_hashes(text: bytes) -> np.ndarray:
    codes = np.frombuffer(text + b"\0" * 16, np.uint8)
    inside = np.zeros(len(codes) - 14, bool)
    np.logical_not(_BLANK[codes[:-16]], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    length = end - start
    eight = np.ndarray(len(codes) - 7, np.uint64, codes, strides=(1,))  # the eight bytes from each place on
    h = mix((eight[start] & _LOW[np.minimum(length, 8)]) + _P)
    h = mix((h ^ length.astype(np.uint64)) + (eight[start + np.minimum(length, 8)] & _LOW[np.clip(length - 8, 0, 8)]) * _P)
    for i in np.flatnonzero(length > 16).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return h


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each run of non-blank bytes: its first 16 bytes mixed, of longer words xxh3 over all bytes."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) <= BLOCK_BYTES:
        return _block_hashes(text)
    return np.concatenate([_block_hashes(b) for b in blocks(text)])


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64), pa.int64())


def keep_ids(docs: DataFrame, ids: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents whose id is in ids (one column doc_id): a broadcast up to `bound` ids, else a shuffled join."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents whose id is not in ids, rows without id included; joined as in keep_ids."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


class Lookup:
    """Sorted keys (64 bits) and value columns; find() gives the places of the keys that are there."""

    def __init__(self, keys: np.ndarray, values: list[np.ndarray]):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask over wanted, and for the found ones their index into values."""
        if not len(self.keys) or not len(wanted):
            return np.zeros(len(wanted), bool), np.empty(0, np.int64)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted
        return hit, at[hit]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about BLOCK_BYTES together, one row at least."""
    sizes = np.cumsum(np.nan_to_num(batch.column(1).cast(pa.binary()).to_pandas().str.len().to_numpy(dtype=np.float64)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BLOCK_BYTES)) + 1
        yield batch.slice(start, end - start)
        start = end


def text_key(text: bytes | None) -> int:
    """A signed 64-bit hash of a whole text."""
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def with_longs(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *(StructField(n, LongType()) for n in names)])


def with_lookup(
    docs: DataFrame,
    known: DataFrame,
    keys_of: Callable[[bytes | None], np.ndarray],
    consume: Callable[[list], pa.RecordBatch | None],
    schema: str,
    bound: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Runs consume([(doc_id, text, lookup), ...]) over all documents, lookup holding the rows of `known` that they need.

    known: a column key (long, distinct) and any further long columns, the values. Up to `bound` rows it is
    broadcast as sorted arrays (16 MB for two columns at the default bound). Beyond it, each document's distinct
    keys are joined with `known` by key, gathered per document (at most as many as the document has), and joined
    to the documents by a hash of the text, as equal texts have equal keys: rows without id, or repeated with one id, are no group.
    Ids then shuffle with their texts once. Both ways give the same rows. carry: columns of docs to put behind those
    of consume, which then gives one row for each document, in order.
    """
    spark, values = docs.sparkSession, [c for c in known.columns if c != "key"]
    bound = BROADCAST_ROWS if bound is None else bound
    if carry:
        schema = StructType([*_parse_datatype_string(schema).fields, *(docs.schema[c] for c in carry)])
    carried = [f"carried_{i}" for i in range(len(carry))]
    docs = texts(docs, *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried, strict=True)))

    def finished(out: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if out is None or not carry:
            return out
        return pa.RecordBatch.from_arrays([*out.columns, *batch.columns[-len(carry) :]], [*out.schema.names, *carry])

    if known.limit(bound + 1).count() <= bound:
        got = known.select("key", *values).toArrow()
        arrays = [got.column(i).to_numpy().astype(np.int64) for i in range(got.num_columns)]
        lookup = Lookup(arrays[0].view(np.uint64), arrays[1:])
        shared = spark.sparkContext.broadcast((lookup.keys, lookup.values))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(np.empty(0, np.uint64), [])
            lookup.keys, lookup.values = shared.value
            for batch in batches:
                for part in slices(batch):
                    out = finished(consume([(i, t, lookup) for i, t in columns(part)]), part)
                    if out is not None and out.num_rows:
                        yield out

        return docs.mapInArrow(apply, schema)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(text_key(t), np.unique(keys_of(t))) for _, t in columns(batch)]
        owner = np.concatenate([np.empty(0, np.int64), *(np.full(len(k), i, np.int64) for i, k in found)])
        keys = np.concatenate([np.empty(0, np.uint64), *(k for _, k in found)])
        return pa.record_batch([pa.array(owner), signed(keys)], ["own_text", "key"])

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([text_key(t) for _, t in columns(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "text_key"])

    wanted = map_arrow(docs.select("doc_id", "text"), emit, "own_text long, key long").distinct().join(known, "key")
    own = wanted.groupBy("own_text").agg(F.collect_list(F.struct("key", *values)).alias("own"))
    keyed = map_arrow(docs, hashed, with_longs(docs.schema, "text_key"))
    both = keyed.join(own, keyed.text_key == own.own_text, "left").select("doc_id", "text", "own", *carried)

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for (i, t), mine in zip(columns(part), part.column(2), strict=True):
                    flat = mine.values.flatten() if mine.is_valid else [pa.array([], pa.int64())] * (1 + len(values))
                    arrays = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat]
                    rows.append((i, t, Lookup(arrays[0].view(np.uint64), arrays[1:])))
                out = finished(consume(rows), part)
                if out is not None and out.num_rows:
                    yield out

    return both.mapInArrow(apply_own, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, component) per node, the component being its smallest node.

    Alternates large-star and small-star steps, each a minimum per node and an equi-join, until no edge
    changes; every step is written to the shared folder, so the lineage stays one step long. The step before goes.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = shared_table(df.where("u <> v").distinct(), "edges")
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, state = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, last = now, state
        now, state = settled(small)
        drop_shared(before)
        if state == last:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
