"""Operator 11, source divergence audit: how the terms of each source of a language depart from those of the others.

Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps the terms of at least LEAST_DOCS of its
documents. Each source, and the language as a whole, gives every kept term a share in parts of 10**9 with one count added. f, the
squared difference of two shares over the second, is summed over all terms for each two sources of a language (part `pair`), and
ranked by term against the whole language (part `term`). All arithmetic is exact, in 64-bit integers.

1. Map tasks count terms by (language, source, term) and add up counts and documents before anything shuffles.
2. A language's terms are dealt into blocks of about TILE_CELLS / sources terms. Each block is a dense int64 tile, sources by
   terms; shares are worked out in it and all pairs of its rows are broadcast against each other, some rows at a time. It gives a
   partial matrix of pair sums, and for each source a heap of its TOP terms.
3. Partial matrices are summed and heaps merged, both keyed by language and source.

A language of many sources is dealt by rows of the matrix as well (PAIR_CELLS), so no task holds more than that many sums whatever
the number of sources. No table is broadcast by its name: the tile's sources come with its cells. Counts may reach 9.2e15 a source.

Null text, language and source are ''. Documents are rows: rows repeated with one id, or without id, count each. A text of any
length is read in blocks; one without terms, or an empty one, still makes its source occur. A language without kept terms has
pairs of value 0, one with a single source has no rows. Ties rank by the bytes of the item. Columns other than text, lang and source are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, drop_shared, shared_table, small_batches

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Documents that a kept term is in at least, terms told of each source, parts of a share.
LEAST_DOCS, TOP, PARTS = 3, 200, 1_000_000_000
#: Cells of a dense tile, cells of a task's part of the pair matrix, cells worked on at once, counters that a map task holds.
TILE_CELLS, PAIR_CELLS, WORK_CELLS, HELD_TERMS = 1 << 16, 1 << 20, 1 << 18, 300_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), added up within each map task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in found.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                counts = pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(n), pa.string()) for x in (lang, source)), terms, *counts], ["lang", "source", "term", "n", "d"])
            found.clear()

        for batch in batches:
            groups = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for group, text in zip(groups, batch.column(0).cast(pa.binary()), strict=True):
                n, d = found.setdefault(group, (Counter(), Counter()))
                own: set[bytes] = set()
                for part in blocks(text.as_py().lower()):  # of bytes: A-Z only
                    terms = TERM.findall(part)
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in found.values()) >= HELD_TERMS:
                yield from out()
        yield from out()

    small_batches(docs.sparkSession)
    counted = docs.mapInArrow(tally, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / total), by long division in base 1000: exact for totals below 9.2e15."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def pair_sums(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of the rows of p and each row of p, the sum of f over the columns: all pairs broadcast, some rows at a time."""
    out = np.zeros((len(rows), len(p)), np.int64)
    step = max(1, WORK_CELLS // max(1, p.size))
    for k in range(0, len(rows), step):
        apart = p[rows[k : k + step], None, :] - p[None, :, :]
        out[k : k + step] = (apart * apart // p[None, :, :]).sum(axis=2)
    return out


def _tile(rows: pa.Table, row_parts: int, row_part: int, top: int) -> pa.Table:
    """The partial pair sums and the heaps of one tile: rows without term are its sources, the others its cells."""
    head = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
    cells = rows.filter(pc.is_valid(rows.column("term")))
    sources, totals = head.column("source").to_pylist(), head.column("n").to_numpy()
    kept_terms, lang_total = head.column("kept_terms")[0].as_py(), head.column("lang_total")[0].as_py()
    order = np.array(sources, object)
    mine = np.flatnonzero(np.arange(len(sources)) % row_parts == row_part)
    term = cells.column("term").combine_chunks().dictionary_encode()
    names = term.dictionary.to_pylist()
    by_bytes = sorted(range(len(names)), key=lambda k: names[k].encode())
    place = np.empty(len(names), np.int64)
    place[by_bytes] = np.arange(len(names))
    of = {s: k for k, s in enumerate(sources)}
    counts = np.zeros((len(sources), len(names)), np.int64)
    at = np.array([of[s] for s in cells.column("source").to_pylist()], np.int64)
    counts[at, place[term.indices.to_numpy(zero_copy_only=False)]] = cells.column("n").to_numpy()
    p = share(counts, (totals + kept_terms)[:, None]) if len(names) else counts
    sums = pair_sums(p, mine)
    left, right = np.nonzero(mine[:, None] != np.arange(len(sources))[None, :])
    parts = [(order[mine[left]], np.full(len(left), "pair", object), order[right], sums[left, right])]
    if len(names):
        q = share(counts.sum(axis=0), np.int64(lang_total + kept_terms))
        terms = np.array([names[k] for k in by_bytes], object)
        for i in mine.tolist():
            own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = (p[i, own] - q[own]) ** 2 // q[own]
            best = np.argsort(-value, kind="stable")[:top]  # terms lie in the order of their bytes, so ties do too
            parts.append((np.full(len(best), sources[i], object), np.full(len(best), "term", object), terms[own[best]], value[best]))
    source, part, item, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.table({"source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def _few(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bound: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank. bound: languages or sources up to which their sizes are broadcast."""
    bound = BROADCAST_ROWS if bound is None else bound
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    docs = docs.select(*named)
    whole = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"docs": F.sum("d").over(whole), "first": (F.min("source").over(whole) == F.col("source")).cast("int")})
    kept = shared_table(counted.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "first"), "terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    occurring = docs.select("lang", "source").distinct()
    groups = occurring.join(by_source, ["lang", "source"], "left").fillna(0, ["n", "first"])
    groups = shared_table(groups, "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("first").alias("kept_terms"), F.sum("n").alias("lang_total"))
    langs = shared_table(
        langs.select(
            "lang",
            "kept_terms",
            "lang_total",
            F.greatest(F.lit(1), F.ceil(F.col("kept_terms") * F.col("sources") / TILE_CELLS)).alias("blocks"),
            F.least(F.col("sources"), F.ceil(F.col("sources") * F.col("sources") / PAIR_CELLS)).alias("row_parts"),
        ),
        "langs",
    )
    told = _few(langs, bound)
    spread = F.explode(F.sequence(F.lit(0), F.col("row_parts").cast("int") - 1))
    head = groups.drop("first").join(told, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    head = head.withColumn("row_part", spread).select("lang", "block", "row_part", "row_parts", "source", F.lit(None).cast("string").alias("term"), "n", "kept_terms", "lang_total")
    cells = kept.join(told, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("row_part", spread).select("lang", "block", "row_part", "row_parts", "source", "term", "n", "kept_terms", "lang_total")

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        out = _tile(rows, key[3].as_py(), key[2].as_py(), top)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    tiles = head.union(cells).groupBy("lang", "block", "row_part", "row_parts").applyInArrow(tile, "lang string, source string, part string, item string, value long")
    # within a map task the partial matrices of its tiles are summed before they shuffle; a term is in one tile only
    summed = shared_table(tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "tiles")
    drop_shared(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs, terms = (summed.where(F.col("part") == part).withColumn("rank", F.row_number().over(order)) for part in ("pair", "term"))
    return pairs.union(terms.where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
