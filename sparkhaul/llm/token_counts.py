"""Operator 1, token counts: offset-mapped attribution of tokens to sections or fields.

A text is encoded once, whole. The tokenizer is byte-level without a normaliser, so the running sum of its
tokens' byte lengths gives the place of every token, and with the text's character starts its character span.
Sections (or fields) tile the text; each token span is joined with the sections it overlaps by binary search in
their bounds. A token that crosses a bound goes to one section, by an explicit rule:

- "most" (the default): the section that has most of the token's bytes, the earliest of equals;
- "first", "last": the section of its first or of its last byte.

So the counts of a text's sections always add up to the number of its tokens. No text is split before it is
encoded, and nothing shuffles. Null and empty texts are one empty section without tokens. Rows repeated with one id, and rows
without id, are counted separately. Ties of the rule "most" go to the earliest section; the other rules have none. A long text is
encoded whole, which takes some 20 bytes of memory a byte. Other columns are ignored, also those named like the new ones; in
field_tokens all columns stay, but for those named <field>_tokens. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, texts

RULES = ("most", "first", "last")


@lru_cache(2)
def encoder(path: str, pattern: str):
    """The encoding of a rank file, and the byte length of each id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, path: str, pattern: str) -> np.ndarray:
    """Byte place behind each token of the text."""
    encoding, sizes = encoder(path, pattern)
    return np.cumsum(sizes[encoding.encode_to_numpy(text)])


def line_bounds(text: bytes) -> np.ndarray:
    """Byte places where lines begin, and the length of the text; a line ends with its \\n."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks, [len(text)]])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of those cross a bound. bounds: section starts, and the end of the last."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds[1:], starts, "right")
    last = np.searchsorted(bounds[1:], ends - 1, "right")
    owner = (last if rule == "last" else first).copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for i in crossing:
            cuts = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
            owner[i] += int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, path: str, pattern: str, bounds_of: Callable[[bytes], np.ndarray] = line_bounds, rule: str = "most") -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens for every section of every document.

    path, pattern: a rank file and the pattern that splits text before its merges. bounds_of: see line_bounds.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for doc_id, text in columns(batch):
                text = text or b""
                ends = token_ends(text.decode(), path, pattern)
                bounds = bounds_of(text)
                n_tokens, crossing = attribute(ends, bounds, rule)
                chars = bounds if text.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[bounds]
                n = len(n_tokens)
                parts.append(np.stack([np.arange(n), chars[:-1], chars[1:], n_tokens, crossing, np.full(n, len(ends))]))
                ids += [doc_id] * n
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, np.concatenate(parts, axis=1))], names)

    return texts(docs).mapInArrow(count, ", ".join(f"{n} long" for n in names))


def field_tokens(rows: DataFrame, fields: list[str], path: str, pattern: str, separator: str = "\n", rule: str = "most") -> DataFrame:
    """The columns of rows with <field>_tokens for each field: tokens of all fields joined by a separator, encoded once.

    A separator belongs to the field before it; a null field is an empty one. Columns of rows that have one of the
    new names are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ends_with = separator.encode()

    @F.pandas_udf("array<long>")
    def counted(parts):
        out = []
        for row in parts:
            values = [("" if x is None else x).encode() + (ends_with if k + 1 < len(row) else b"") for k, x in enumerate(row)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in values])])
            out.append(attribute(token_ends(b"".join(values).decode(), path, pattern), bounds, rule)[0])
        return pa.array(out, pa.list_(pa.int64())).to_pandas()

    # one evaluation of the function for all fields, under a name that no column has
    held = "__field_tokens"
    while held in rows.columns:
        held += "_"
    counts = rows.withColumn(held, counted(F.array(*(F.col(f"`{f}`").cast("string") for f in fields))))
    return counts.withColumns({f"{f}_tokens": F.col(held)[k] for k, f in enumerate(fields)}).drop(held)
