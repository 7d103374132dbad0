"""Operator 12, fill-in-middle: token boundaries as a succinct bitvector, cut by rank and select.

A token is a word with the blanks before it, or the blanks at the end of a text. Its last byte is a one in a bitvector of the text's
bytes, packed into 64-bit words, with a directory that holds the running popcount of each block of BLOCK_WORDS words. The popcount of
all words is the number n of tokens; select on a rank (directory, then block, then word) gives the byte behind that token. No list of
tokens is made: beside the text, memory is an eighth of it.

Two draws from a keyed hash of the id give the ends of prefix and middle, two more the form. plain: the text as it is, where it is
empty, holds a mark, or is not drawn. psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle. spm: suffix first. Marks
cannot overlap each other or lie in a text that is cut, so restored() finds them again and gives the text back byte by byte.

Null texts count as empty and are plain with n = 0. A text of blanks is one token. Rows repeated with one id are cut each, equal rows
alike; a row without id is drawn as an empty id. Texts of any length are cut whole. Columns other than doc_id and text are
ignored, also those named like the new ones. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, slices, texts

BLANKS = b" \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: 64-bit words in a block of the popcount directory.
BLOCK_WORDS = 64
#: Key of the draws, percent of texts that are cut, percent of those with the suffix first.
KEY, CUT_PERCENT, SPM_PERCENT = 42, 50, 80

_IS_BLANK = np.isin(np.arange(256), list(BLANKS))


class Boundaries:
    """The ends of a text's tokens as packed bits with a popcount directory."""

    def __init__(self, text: bytes):
        self.size = len(text)
        packed = []
        for start in range(0, len(text), BLOCK_BYTES):  # a multiple of 8, so blocks of bits join without a shift
            size = min(BLOCK_BYTES, len(text) - start)
            blank = np.ones(size + 1, bool)  # what comes behind the text ends a word, as a blank does
            own = np.frombuffer(text, np.uint8, min(size + 1, len(text) - start), start)
            blank[: len(own)] = _IS_BLANK[own]
            packed.append(np.packbits(~blank[:-1] & blank[1:], bitorder="little"))
        bits = np.concatenate(packed) if packed else np.empty(0, np.uint8)
        width = 8 * BLOCK_WORDS
        padded = np.zeros(max(1, -(-len(bits) // width)) * width, np.uint8)
        padded[: len(bits)] = bits
        if text and _IS_BLANK[text[-1]]:
            padded[(len(text) - 1) // 8] |= 1 << ((len(text) - 1) % 8)
        self.words = padded.view("<u8")
        self.directory = np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64))
        self.total = int(self.directory[-1])

    def select(self, k: int) -> int:
        """The byte place behind the k-th token, 0 for k = 0."""
        if k == 0:
            return 0
        block = int(np.searchsorted(self.directory, k))
        k -= int(self.directory[block - 1]) if block else 0
        own = self.words[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS]
        ranks = np.cumsum(np.bitwise_count(own), dtype=np.int64)
        word = int(np.searchsorted(ranks, k))
        k -= int(ranks[word - 1]) if word else 0
        bit = np.flatnonzero(np.unpackbits(own[word : word + 1].view(np.uint8), bitorder="little"))[k - 1]
        return 64 * (block * BLOCK_WORDS + word) + int(bit) + 1


def characters(part: bytes) -> int:
    """Code points of UTF-8 bytes, counted in blocks."""
    return sum(int(np.count_nonzero((np.frombuffer(part, np.uint8, min(BLOCK_BYTES, len(part) - k), k) & 0xC0) != 0x80)) for k in range(0, len(part), BLOCK_BYTES))


def cut(text: bytes, draws: tuple[int, int, int, int], cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    places = Boundaries(text)
    n = places.total
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or draws[2] % 100 >= cut_percent or p in text or s in text or m in text:
        return n, "plain", None, None, text
    one, two = sorted(places.select(h % (n + 1)) for h in draws[:2])
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", characters(prefix), characters(middle), b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", characters(prefix), characters(middle), b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, key: int = KEY, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs; cut in place, nothing shuffles."""
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"draw_{k}") for k in range(4)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, read = part.column(0), part.column(1).cast(pa.binary())
                drawn = zip(*(part.column(2 + k).to_pylist() for k in range(4)), strict=True)
                rows = [cut(t.as_py() or b"", d, cut_percent, spm_percent) for t, d in zip(read, drawn, strict=True)]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types[1:], strict=True)]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, *made], names)

    return texts(docs, *draws).mapInArrow(apply, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made from: what lies between the marks, in the text's order."""
    def parts(opening: str, inner: str) -> tuple[Column, Column, Column]:
        at, end = F.instr(output, inner), F.instr(output, MIDDLE)
        lead = len(opening)
        return F.substr(output, F.lit(lead + 1), at - 1 - lead), F.substr(output, at + len(inner), end - at - len(inner)), F.substr(output, end + len(MIDDLE))

    p1, s1, m1 = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p1, m1, s1)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
