"""Operator 10, packing: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents.

A document's ids (with the closing id) are cut into pieces of one full sequence each and a rest. Pieces are
dealt into groups of about GROUP_ROWS by a hash of the document and of a number that each row gets when it is read, so equal
rows are spread too; the deal is written down once. In each group first-fit decreasing finds the first bin with
room by descending a tree that holds the largest free capacity of each half. Groups see lengths only, never ids,
so a group is a few hundred kB whatever the texts are.

Ids are made white-space chunk by chunk: this tokenizer's pieces never cross white space, so a chunk has the same
ids wherever it stands, and each distinct chunk is encoded once per worker (a test holds this against whole-text
encoding). A long text is encoded in blocks that end at white space, and what a worker remembers is bounded in bytes.

Null and empty texts have the closing id alone. Rows repeated with one id, and rows without id, are
packed separately. Ties in length go by id, start and contents. Columns of docs other than doc_id and text are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, shared_table, texts

SEQUENCE, CLOSING_ID = 4096, 2
#: Pieces in a group, bytes of chunks that a worker remembers, and what a remembered chunk takes besides its own bytes.
GROUP_ROWS, MEMO_BYTES, ENTRY_BYTES = 4000, 48 << 20, 200
#: The characters that the tokenizer's \\s matches.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ODD_SPACE = re.compile("[\\x1c-\\x1f]")  # str.split() would split at these too
#: Latin letters that have one lower case letter each and compose with nothing, then punctuation: one pre-token each.
PLAIN = re.compile("([^\\W\\d_\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]+)([.,;:!?)\\]\"'#$%&*]*)").fullmatch


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class ChunkEncoder:
    """Text -> uint32 ids, remembering the ids of chunks; a full memory is emptied.

    A new chunk of Latin letters, perhaps with punctuation behind, is two pre-tokens at most; its letters go to the
    tokenizer's model in lower case, as the characters that stand for their bytes. Any other chunk takes the
    tokenizer's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.byte = self.tokenizer.model, byte_characters()
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def remember(self, chunk: str, ids: bytes) -> bytes:
        self.held += ENTRY_BYTES + len(chunk) + len(ids)
        self.memo[chunk] = ids
        return ids

    def whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def new(self, chunk: str) -> bytes:
        match = PLAIN(chunk)
        if match is None:
            return self.whole(chunk)
        head, tail = match.groups()
        head = head.lower()
        ids = self.memo.get(head)
        if ids is None:
            word = head if head.isascii() else head.encode().decode("latin-1").translate(self.byte)
            ids = self.remember(head, array("I", [t.id for t in self.model.tokenize(word)]).tobytes())
        if tail:
            if tail not in self.memo:
                self.remember(tail, self.whole(tail))
            ids += self.memo[tail]
        return ids

    def __call__(self, text: str) -> np.ndarray:
        chunks = WHITE.split(text) if ODD_SPACE.search(text) else text.split()
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        distinct = set(chunks)
        own = dict(zip(distinct, map(self.memo.get, distinct), strict=True))  # small, so a text's own look-ups are cheap
        for c in [c for c, ids in own.items() if ids is None]:
            own[c] = self.remember(c, self.new(c))
        return np.frombuffer(b"".join(map(own.__getitem__, chunks)), np.uint32)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first; ties in the given order."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left >= right else right
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and the row's draw for each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer_path)
        closing = np.array([CLOSING_ID], np.uint32)
        for batch in batches:
            rows = []
            for (doc_id, text), draw in zip(columns(batch), batch.column(2).to_pylist(), strict=True):
                ids = np.concatenate([*(encode(b.decode()) for b in blocks(text or b"")), closing]).astype("<u4")
                for start in range(0, len(ids), sequence):
                    piece = ids[start : start + sequence]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), draw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"]
    drawn = texts(docs, F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("draw"))
    return drawn.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces with sequence_id (group * 2**24 + the bin in the group) and offset (gapless from 0 in each sequence)."""
    cut = shared_table(pieces(docs, tokenizer_path, sequence), "pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def in_group(key: tuple, rows: pa.Table) -> pa.Table:
        order = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length")])
        bins, offsets = first_fit_decreasing(order.column("length").to_numpy(), sequence)
        order = order.drop_columns(["draw", "group"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 24)))
        return order.append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("draw", "start"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(in_group, schema)
