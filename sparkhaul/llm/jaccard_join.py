"""Operator 5, n-gram Jaccard join: token-combination prefixes, then exact verification.

Tokens are the distinct word n-grams (shingles) of a text. Two sets of similarity t or more differ in at most
tau(n) = n - ceil(t n) tokens of either. In a common order of all tokens, a prefix is long enough once its *credit*
exceeds tau: a rare token counts 1 and is a signature of its own; frequent tokens are dealt into classes, and a class
with m tokens of the prefix counts m - k + 1 and gives its k-token combinations as signatures. Fewer common signatures than one
would need more than tau differences, so every similar pair shares a signature. Frequent tokens stand last in
the order, so only documents made of them nearly whole need combinations; those are far rarer than the tokens.

1. Sets are built per document; equal sets collapse into a class, represented by its least id.
2. Token frequencies over the representatives, from the part of each set that prefixes can reach, in one
   pre-aggregated shuffle. Which tokens count as frequent affects cost, never the result.
3. Signatures shuffle. In each bucket every member is paired with one pivot only, the least id, found by a partial
   aggregate and joined back; pairs are made distinct, filtered by size and by a bound on the difference from parity
   bits (about a 60th of a set), and the rest verified on the whole sets. Linked documents become components.
4. Buckets whose members are not all in one component yet: each member is stood for by a document it is linked with, at a
   known distance. Jaccard distance obeys the triangle inequality, so two representatives that are too far apart for any
   of their members settle all their members' pairs at once; the members of the others meet in blocks of like sizes, and
   what the blocks' sizes and distances, then each pair's sizes, distances and parities leave possible is verified.
5. Components of all links; documents get the component of their class.

No pair inside a component that is known already is made, so a group of n copies or near copies costs about n pairs. Blocks
are dealt by representative, size and part, so no key has more rows than a block. What is broadcast is the list of
frequent tokens (TOLD_TOKENS at most, 16 MB) and ids up to BROADCAST_ROWS (8 MB), at any size of the input.

Words are hashed to 64 bits and shingles to 64 bits; two sets are compared whole, shingle by shingle, as hashes.
Null ids: such a row gets its set size and no component. Rows repeated with one id act as one node in links
through their texts. Null, empty and blank texts have an empty set and no links. Ties between pivots cannot be, as ids
of representatives are distinct. A long text is hashed in blocks. An empty table gives no rows. Other columns, also
those named like the new ones, are ignored by jaccard_components and pass through untouched in one_of_each_group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, components, drop_ids, drop_shared, keep_ids, map_arrow, mix, ngrams, shared_table, signed, texts, word_hashes

#: A token found in more than FREQUENT sets, or in more than one of COMMON_SETS, is indexed in combinations of two; one in
#: VERY_FREQUENT times as many sets in combinations of three.
FREQUENT, COMMON_SETS, VERY_FREQUENT = 40, 20_000, 50
#: Frequent tokens that are told to the tasks, the most frequent first; others count as rare, which costs larger buckets only.
TOLD_TOKENS = 1_000_000
#: Counted for each set: all tokens of sets up to COUNT_ALL, else the COUNT_SHARE lowest by hash.
COUNT_ALL, COUNT_SHARE = 160, 0.3
#: Members of a representative that are compared at once with as many of another, and ranges of sizes in a power of e.
BLOCK_ROWS, SIZE_BANDS = 256, 2
#: Buckets by which representatives are kept from being compared again, and pairs that a task remembers (some 100 bytes each).
FIRST_BUCKETS, SEEN_PAIRS = 16, 300_000
#: Added to bounds on distances, against rounding.
SLACK = 1e-9


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of a shorter text, the whole word sequence."""
    h = word_hashes((text or b"").lower())
    if not len(h):
        return h
    return np.unique(ngrams(h, n)) if len(h) >= n else mix(ngrams(h, len(h)) + np.uint64(len(h)))


def least_overlap(size: int, percent: int) -> int:
    """Tokens that a set of this size has in common with any similar one, at least."""
    return -(-percent * size // 100)


class Signatures:
    """Signatures of a set, given the frequent tokens (sorted hashes, and k for each)."""

    def __init__(self, tokens: np.ndarray, ks: np.ndarray, percent: int):
        self.tokens, self.ks, self.percent = tokens, ks, percent
        self.steps = np.log(100 / percent)

    def bands(self, size: int) -> tuple[int, int]:
        """Two bands of sizes; sets of similar sizes have one in common."""
        b = int(np.log(size) / self.steps + 1e-9)
        return b, b + 1

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """tokens: sorted distinct hashes, whose order is that of the prefix."""
        size = len(tokens)
        need = size - least_overlap(size, self.percent) + 1
        k = np.ones(size, np.int64)
        if len(self.tokens):
            at = np.searchsorted(self.tokens, tokens)
            at[at == len(self.tokens)] = 0
            same = self.tokens[at] == tokens
            k[same] = self.ks[at[same]]
        rare, often = (np.flatnonzero(x) for x in (k == 1, k > 1))
        rare = rare[:need]
        found = [mix(tokens[rare] ^ np.uint64(1))]
        if len(rare) < need:
            often = often[np.argsort(k[often], kind="stable")]
            for band in self.bands(size):
                found.append(self.combined(tokens[often], k[often], need - len(rare), band))
        return np.unique(np.concatenate(found))

    def combined(self, tokens: np.ndarray, k: np.ndarray, need: int, band: int) -> np.ndarray:
        """Combinations in classes of one band, from the start of the order until the credit is reached."""
        least = max(1, int(np.exp((band - 1) * self.steps)))
        if least < 8:  # too small for combinations: every token is its own signature
            return mix(tokens[:need] ^ np.uint64(2))
        kinds = max(1, int(0.06 * least))
        place = (mix(tokens ^ np.uint64(band * 2 + 1)) % np.uint64(kinds)).astype(np.int64).tolist()
        held: dict[tuple[int, int], list[int]] = {}
        for p, kk, t in zip(place, k.tolist(), tokens.tolist(), strict=True):
            members = held.setdefault((kk, p), [])
            members.append(t)
            need -= len(members) >= kk
            if not need:
                break
        every = ((kk, sorted(c)) for (kk, _), m in held.items() for c in combinations(m, kk))
        return np.array([xxhash.xxh3_64_intdigest(np.array([band, kk, *c], np.uint64).tobytes()) for kk, c in every], np.uint64)


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bit for each of 2**k ranges of hashes, about as many as tokens: whether the set has an odd number there."""
    k = max(6, (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1).tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8))


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Two sets differ in at least so many tokens as their unpacked parities do; the longer mark is folded to the shorter one's ranges."""
    if len(x) == len(y):
        return int(np.count_nonzero(x != y))
    if len(x) < len(y):
        x, y = y, x
    return int(((x.reshape(len(y), -1).sum(axis=1) & 1) != y).sum())


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (d1, d2) of the set, and its parity bits."""

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, shingle_set(t, n)) for i, t in columns(batch)]
        digest = np.array([[xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh64_intdigest(s.tobytes())] for _, s in rows], np.uint64).reshape(-1, 2)
        bits = pa.array([parity_bits(s) if len(s) else None for _, s in rows], pa.binary())
        ids, sizes = pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64())
        return pa.record_batch([ids, sizes, signed(digest[:, 0]), signed(digest[:, 1]), bits], ["doc_id", "n_shingles", "d1", "d2", "bits"])

    return map_arrow(texts(docs), build, "doc_id long, n_shingles long, d1 long, d2 long, bits binary")


def frequent_tokens(docs: DataFrame, n: int, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and the k of each: TOLD_TOKENS at most. sets: how many documents there are."""

    def reach(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.empty(0, np.uint64)]
        for _, text in columns(batch):
            s = shingle_set(text, n)
            found.append(s[: max(COUNT_ALL, int(COUNT_SHARE * len(s)))])
        return pa.record_batch([signed(np.concatenate(found))], ["token"])

    often = max(FREQUENT, sets // COMMON_SETS)
    counted = map_arrow(docs, reach, "token long").groupBy("token").agg(F.count("*").alias("df"))
    most = counted.where(F.col("df") > often).orderBy(F.desc("df"), "token").limit(TOLD_TOKENS).toArrow()
    tokens, df = most.column("token").to_numpy().view(np.uint64), most.column("df").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.where(df[order] > often * VERY_FREQUENT, 3, 2)


def possible(pairs: DataFrame, marks: DataFrame, most: float) -> DataFrame:
    """The pairs (u, v) whose sizes and parity bits allow a Jaccard distance of at most `most`. marks: doc_id, n_shingles, bits."""
    u, v = (marks.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", "bits"))) for x in "uv")
    fits = F.expr("1 - least(n_shingles_u, n_shingles_v) / greatest(n_shingles_u, n_shingles_v)") <= most + SLACK
    sides = pairs.join(u, "u").join(v, "v").where(fits).select("u", "v", F.expr("n_shingles_u + n_shingles_v AS size"), "bits_u", "bits_v")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask = []
        for size, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            d = least_difference(unpacked(a), unpacked(b))
            mask.append(2 * d / (size + d) <= most + SLACK)
        return pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(mask, pa.bool_()))

    return map_arrow(sides, keep, "u long, v long")


def in_blocks(rows: DataFrame, key: str, who: str, *more: str) -> DataFrame:
    """key, block, lo, hi (sizes), wide (the largest radius), held: the rows of each key in blocks of about BLOCK_ROWS and like sizes.

    rows: key, who, component, n_shingles, radius, bits and more.
    """
    banded = rows.withColumn("band", F.floor(F.log("n_shingles") * SIZE_BANDS).cast("long"))
    # written first: a join whose both sides are shuffled for it can be split where a key has very many rows
    parts = shared_table(banded.groupBy(key, "band").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")), "parts")
    dealt = banded.join(parts, [key, "band"]).withColumn("block", F.shiftleft("band", 40) + F.pmod(F.xxhash64(who), F.col("parts")))
    held = F.collect_list(F.struct(F.col(who).alias("who"), "component", "n_shingles", "radius", "bits", *more))
    edges = (F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.max("radius").alias("wide"))
    out = shared_table(dealt.groupBy(key, "block").agg(*edges, held.alias("held")), "blocks")
    drop_shared(parts)
    return out


def side(blocks: DataFrame, x: str, *names: str) -> DataFrame:
    """Columns of blocks with _a or _b behind their names, the key among them."""
    return blocks.select(*(F.col(n).alias(f"{n}_{x}") for n in names))


def may_be_near(most: float, bound: Column | float = 0.0) -> Column:
    """Whether rows of block a and of block b may be within `most` and both radii, by the blocks' sizes and widest radii."""
    apart = F.greatest(F.lit(0.0), 1 - F.col("hi_a") / F.col("lo_b"), 1 - F.col("hi_b") / F.col("lo_a"))
    return F.greatest(apart, F.lit(bound)) <= most + SLACK + F.col("wide_a") + F.col("wide_b")


def block_pairs(found: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """found (key_a, block_a, key_b, block_b and more) with the rows held by both blocks."""
    rows_a, rows_b = side(a, "a", key, "block", "held"), side(b, "b", key, "block", "held")
    return found.join(rows_a, [f"{key}_a", "block_a"]).join(rows_b, [f"{key}_b", "block_b"])


def fields(block) -> list[np.ndarray]:
    """who, component, n_shingles, radius and unpacked bits of the rows of a block."""
    parts = [block.values.field(k) for k in range(5)]
    return [*(x.to_numpy() for x in parts[:4]), [unpacked(m) for m in parts[4].to_pylist()]]


def near_representatives(reps: DataFrame, wide: DataFrame, most: float) -> DataFrame:
    """u, v, bound of representatives that share a bucket and that sizes and parities leave within `most` and both radii.

    reps: sig, rep, component; wide: doc_id, n_shingles, bits, radius. Block meets block within a bucket if their sizes
    allow it; pairs of one component are passed over. Representatives share many buckets: each brings the FIRST_BUCKETS least of
    its own, and two that have any of those in common are compared in the least of them only.
    """
    firsts = reps.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_BUCKETS).alias("firsts"))
    dealt = in_blocks(reps.join(firsts, "rep").join(wide.withColumnRenamed("doc_id", "rep"), "rep"), "sig", "rep", "firsts")
    a, b = (side(dealt, x, "sig", "block", "lo", "hi", "wide") for x in "ab")
    pairs = a.join(b, F.col("sig_a") == F.col("sig_b")).where((F.col("block_a") <= F.col("block_b")) & may_be_near(most))
    pairs = pairs.select("sig_a", "block_a", "sig_b", "block_b", F.expr("block_a = block_b AS own"))
    sides = block_pairs(pairs, dealt, dealt, "sig").select("held_a", "held_b", "own", "sig_a")

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # pairs that this task has told or ruled out
        for batch in batches:
            found = []
            for a, b, own, sig in zip(*batch.columns[:2], batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (ra, ca, na, fa, ma), (rb, cb, nb, fb, mb) = fields(a), fields(b)
                first_a, first_b = ([frozenset(f) for f in x.values.field(5).to_pylist()] for x in (a, b))
                room = most + SLACK + fa[:, None] + fb
                fits = (ca[:, None] != cb) & (1 - np.minimum(na[:, None], nb) / np.maximum(na[:, None], nb) <= room)
                if own:
                    fits &= ra[:, None] < rb
                for i, j in zip(*(x.tolist() for x in np.nonzero(fits)), strict=True):
                    if min(first_a[i] & first_b[j], default=sig) != sig:
                        continue
                    u, v = sorted((int(ra[i]), int(rb[j])))
                    if (key := (u, v, int(na[i] + nb[j]))) in seen:
                        continue
                    seen.add(key)
                    d = least_difference(ma[i], mb[j])
                    bound = 2 * d / (na[i] + nb[j] + d)
                    if bound <= room[i, j]:
                        found.append((u, v, bound))
            if len(seen) > SEEN_PAIRS:
                seen.clear()
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["u", "v", "bound"])

    out = shared_table(sides.mapInArrow(pairs_of, "u long, v long, bound double").groupBy("u", "v").agg(F.min("bound").alias("bound")), "near")
    drop_shared(dealt)
    return out


def member_pairs(near: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members of representatives (u, v, bound) that sizes, the triangle inequality and parities leave possible.

    members: rep, doc_id, n_shingles, radius (its distance from rep), bits. Blocks are told apart by representative and number,
    so one with very many members is many rows; pairs of blocks that no pair of members can pass are not made.
    """
    most = 1 - percent / 100
    dealt = in_blocks(members.withColumn("component", F.lit(0).cast("long")), "rep", "doc_id")
    a, b = (side(dealt, x, "rep", "block", "lo", "hi", "wide") for x in "ab")
    pairs = near.join(a, F.col("u") == F.col("rep_a")).join(b, F.col("v") == F.col("rep_b"))
    apart = F.greatest(1 - F.col("hi_a") / F.col("lo_b"), 1 - F.col("hi_b") / F.col("lo_a"))
    pairs = pairs.where(may_be_near(most, F.col("bound")) & (apart <= most + SLACK))
    sides = block_pairs(pairs.select("rep_a", "block_a", "rep_b", "block_b", "bound"), dealt, dealt, "rep").select("bound", "held_a", "held_b")

    def pair(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for bound, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            (ids_a, _, na, fa, marks_a), (ids_b, _, nb, fb, marks_b) = fields(a), fields(b)
            fits = 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
            fits &= bound <= most + SLACK + fa[:, None] + fb
            for i, j in zip(*np.nonzero(fits), strict=True):
                d = least_difference(marks_a[i], marks_b[j])
                if 2 * d / (na[i] + nb[j] + d) <= most + SLACK:
                    found.append(sorted((int(ids_a[i]), int(ids_b[j]))))
        if not found:
            return None
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    out = shared_table(map_arrow(sides, pair, "u long, v long").distinct(), "rest")
    drop_shared(dealt)
    return out


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v, distance (Jaccard) of the pairs (u, v) that are similar. Sets are rebuilt for the documents that occur in a pair only."""
    ids = shared_table(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "candidates")

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(columns(batch))
        tokens = pa.array([shingle_set(t, n).tobytes() for _, t in rows], pa.binary())
        return pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), tokens], ["doc_id", "tokens"])

    sets = shared_table(map_arrow(keep_ids(docs, ids), build, "doc_id long, tokens binary"), "sets")
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    sides = pairs.join(b, "v").join(a, "u")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        distance, similar = [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common = int((large[at] == small).sum())
            union = len(a) + len(b) - common
            distance.append(1 - common / union)
            similar.append(100 * common >= percent * union)
        out = pa.record_batch([batch.column(0), batch.column(1), pa.array(distance, pa.float64())], ["u", "v", "distance"])
        return out.filter(pa.array(similar, pa.bool_()))

    out = shared_table(map_arrow(sides.select("u", "v", "a", "b"), compare, "u long, v long, distance double").distinct(), "links")
    drop_shared(ids, sets)
    return out


def links(docs: DataFrame, reps: DataFrame, marks: DataFrame, n: int, percent: int) -> DataFrame:
    """Enough similar pairs (u, v) of representatives to connect all that are connected. reps: doc_id; marks: see possible."""
    spark, most = docs.sparkSession, 1 - percent / 100
    docs = keep_ids(docs, reps.select("doc_id").distinct())
    shared = spark.sparkContext.broadcast(frequent_tokens(docs, n, reps.count()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures(*shared.value, percent)
        for batch in batches:
            ids, sizes, found = [], [], [np.empty(0, np.uint64)]
            for doc_id, text in columns(batch):
                s = shingle_set(text, n)
                if len(s):
                    own = maker.of(s)
                    found.append(own)
                    ids.append(np.full(len(own), doc_id, np.int64))
                    sizes.append(np.full(len(own), len(s), np.int64))
            if ids:
                yield pa.record_batch([signed(np.concatenate(found)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], ["sig", "doc_id", "size"])

    every = shared_table(docs.mapInArrow(sign, "sig long, doc_id long, size long"), "signatures")
    pivots = every.groupBy("sig").agg(F.min("doc_id").alias("pivot"), F.min_by("size", "doc_id").alias("pivot_size"), F.count("*").alias("n"))
    members = shared_table(every.join(pivots.where("n > 1"), "sig"), "buckets")
    drop_shared(every)

    near_sizes = F.expr(f"100 * least(size, pivot_size) >= {percent} * greatest(size, pivot_size)")
    stars = members.where("doc_id <> pivot").where(near_sizes).select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct()
    stars = shared_table(possible(stars, marks, most), "stars")
    first = verified(stars, docs, n, percent)
    known = shared_table(components(first.select("u", "v")), "components")

    # each document is stood for by a document it is linked with, at a known distance, or by itself
    star = first.groupBy(F.col("v").alias("doc_id")).agg(F.min("u").alias("rep"), F.min_by("distance", "u").alias("off"))
    several = marks.groupBy("doc_id").count().where("count > 1")  # an id with several texts stands for itself: no distance is all of theirs
    star = star.join(several, "doc_id", "left_anti")
    placed = members.where("n > 2").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("sig")
    open_rows = placed.join(mixed, "sig").where("doc_id <> pivot").select("sig", "doc_id", "component").join(star, "doc_id", "left")
    open_rows = open_rows.select("sig", "doc_id", "component", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("off", F.lit(0.0)).alias("radius"))
    open_rows = shared_table(open_rows, "open")
    drop_shared(members, stars, known)
    reps = open_rows.select("sig", "rep", "component").distinct()
    # buckets with the same representatives are one
    rep_hash = F.xxhash64("rep").cast("decimal(38,0)")
    same = reps.groupBy("sig").agg(F.count("*").alias("k"), F.sum(rep_hash).alias("h"), F.sum(F.hash("rep").cast("long")).alias("g"))
    reps = shared_table(reps.join(same.where("k > 1").groupBy("k", "h", "g").agg(F.min("sig").alias("sig")).select("sig"), "sig"), "representatives")
    radius = open_rows.groupBy(F.col("rep").alias("doc_id")).agg(F.max("radius").alias("radius"))
    near = near_representatives(reps, marks.join(radius, "doc_id"), most)
    each = open_rows.select("rep", "doc_id", "radius").distinct().join(marks, "doc_id")
    rest = member_pairs(near, each, percent)
    more = verified(rest, docs, n, percent)
    drop_shared(open_rows, reps, near, rest)
    return first.union(more).select("u", "v")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: the least id reachable through links of percent / 100 or more."""
    docs = texts(docs)
    sets = shared_table(sets_of(docs, n), "set-sizes")
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = shared_table(classes, "classes")
    marks = sets.join(classes.select("d1", "d2", "n_shingles", F.col("rep").alias("doc_id")), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    marks = shared_table(marks.select("doc_id", "n_shingles", "bits").distinct(), "marks")
    found = components(links(docs, classes.select(F.col("rep").alias("doc_id")), marks, n, percent))
    placed = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    linked = sets.where("n_shingles > 0").join(placed, ["d1", "d2", "n_shingles"], "left")
    linked = linked.select("doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL THEN component END").alias("component_id"))
    return linked.union(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The whole rows of docs that are the least of their component; rows without id stay, and all rows of one id stay or go together."""
    gone = shared_table(jaccard_components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return drop_ids(docs, gone).select(*(f"`{c}`" for c in docs.columns))
