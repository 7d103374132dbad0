"""Operator 13, quality rules: cutoffs with a proven bound on how many good documents they reject, stratum by stratum.

Every text is measured (words, characters, symbols, repeated lines and words, capitals, marks, digits). A few fixed base rules
reject what is hardly text. All further rules compare a ratio of two measures with a cutoff out of a fixed list, from lenient
to strict, and labelled documents choose the cutoffs of each stratum (here the language):

1. One fold shows the way: labelled documents of the design fold order the steps. A step makes one rule stricter; the next one is that
   which rejects most labelled-bad documents more for each labelled-good one. So the sets of cutoffs form one nested sequence.
2. Another judges: along that sequence, the good documents of the holdout fold that are rejected by the whole set are counted.
   A set passes if an exact binomial (Clopper-Pearson) bound puts the share of good documents that it rejects at RISK or less.
   Testing stops at the first set that does not pass, and the last that passed is taken.
3. Correction: a fixed sequence needs none within a stratum; over strata, the chance of an error DELTA is divided by their number
   (Bonferroni). So with probability 1 - DELTA no stratum rejects more than RISK of its good documents by these rules.

A stratum with too few labelled-good holdout documents for any proof (below fewest()) keeps its documents, base rules apart. What meets in one
task are counts per combination of the rules' levels, which fixed lists bound, never documents. Measures are taken once and
written; all of them are integers, and rules compare products, so no rounding decides.

Null texts count as empty and fail the base rules. Rows repeated with one id are judged each by their text; with a label all of them are
labelled. Labels that are null, or given to one id in two ways, are not used; rows without id have no label. A null stratum is a stratum
of its own. Texts of any length are measured whole, in blocks. Columns other than doc_id, text and the stratum's are
ignored, also those named like the new ones. Empty tables of documents give no rows, of labels no cutoffs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, BROADCAST_ROWS, Grams, columns, drop_shared, map_arrow, shared_table, texts, word_hashes

#: Most good documents that the rules may reject, chance that this fails anywhere, and the design fold: crc32 of the id modulo DESIGN is 0.
RISK, DELTA, DESIGN = 0.02, 0.05, 4
#: Words in a window that counts as repeated, words and percent of repeated words of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits"]
_SYMBOLS, _MARKS, _BLANKS = list(b"#*$%&|<>"), list(b"!?"), [9, 10, 11, 12, 13, 32]


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * part is over cutoff * whole (under it, if `under`); cutoffs go from lenient to strict."""

    part: str
    whole: str
    cutoffs: tuple[int, ...]
    under: bool = False


RULES = (
    Rule("n_symbols", "n_words", (2000, 1000, 700, 500, 300, 200, 100, 50)),
    Rule("n_marks", "n_words", (2000, 1000, 700, 500, 300, 200, 100)),
    Rule("n_capitals", "word_chars", (900, 700, 500, 300, 200)),
    Rule("n_digits", "word_chars", (700, 500, 300, 200, 100)),
    Rule("n_dup_lines", "n_lines", (800, 600, 400, 300, 200, 100)),
    Rule("n_repeat_words", "n_words", (250, 200, 150, 100, 50)),
    Rule("word_chars", "n_words", (20000, 15000, 12000, 10000)),
    Rule("word_chars", "n_words", (1500, 2000, 2500, 3000), under=True),
)


def measured(text: bytes | None) -> list[int]:
    """The MEASURES of one text."""
    text = text or b""
    kinds = np.zeros(256, np.int64)
    for k in range(0, len(text), BLOCK_BYTES):
        kinds += np.bincount(np.frombuffer(text, np.uint8, min(BLOCK_BYTES, len(text) - k), k), minlength=256)
    chars = len(text) - int(kinds[0x80:0xC0].sum()) - int(kinds[_BLANKS].sum())  # bytes that continue a character do not count
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    h = word_hashes(text)
    return [
        len(h), chars, int(kinds[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(h), len(lines), int(kinds[65:91].sum()), int(kinds[_MARKS].sum()), int(kinds[48:58].sum()),
    ]


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that are found twice or more among the words with hashes h."""
    windows = Grams(h).of(WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, MEASURES and base_failed for every row of docs."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measured(t) for _, t in columns(batch)], np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in rows.T)], ["doc_id", "stratum", *MEASURES])

    read = texts(docs, F.col(f"`{stratum}`").cast("string").alias("stratum"))
    found = map_arrow(read, apply, f"doc_id long, stratum string, {', '.join(f'{m} long' for m in MEASURES)}")
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def level(rule: Rule) -> Column:
    """How many of a rule's cutoffs the document passes; it is rejected where more than that are in use."""
    part, whole = 1000 * F.col(rule.part), F.col(rule.whole)
    passed = [(part >= c * whole) if rule.under else (part <= c * whole) for c in rule.cutoffs]
    return sum((p.cast("int") for p in passed[1:]), passed[0].cast("int"))


def fewest(risk: float, chance: float) -> int:
    """The fewest good documents with which a set that rejects none of them can pass."""
    return math.ceil(math.log(chance) / math.log1p(-risk))


def passes(rejected: int, n: int, risk: float, chance: float) -> bool:
    """Whether at most `rejected` of n have no more than this chance where each is rejected with probability risk: the exact upper
    bound of level 1 - chance for the probability is then at most risk."""
    if n <= 0 or rejected >= risk * n:
        return False
    log_odds, term = math.log(risk) - math.log1p(-risk), math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1)
    term += rejected * math.log(risk) + (n - rejected) * math.log1p(-risk)
    total, one, k = 0.0, 1.0, rejected  # terms relative to the largest, which is the last one
    while k >= 0 and one > 1e-18:
        total += one
        one *= k / ((n - k + 1) * math.exp(log_odds))
        k -= 1
    return term + math.log(total) <= math.log(chance)


def path(levels: np.ndarray, bad: np.ndarray, good: np.ndarray, steps: list[int]) -> list[tuple[int, ...]]:
    """Nested sets of cutoffs, each a number of cutoffs in use per rule; levels: cutoffs passed, one row for each combination.

    Each step takes the rule and number of cutoffs with most bad documents newly rejected for each good one (one added), of equals
    the one with more bad documents, then the earliest rule and the fewest cutoffs; it ends when no step rejects a bad one.
    """
    now, out = [0] * len(steps), []
    left = np.ones(len(levels), bool)
    while True:
        best = None
        for r, most in enumerate(steps):
            for use in range(now[r] + 1, most + 1):
                hit = left & (levels[:, r] < use)
                gain = int(bad[hit].sum())
                if gain and (best is None or (gain / (int(good[hit].sum()) + 1), gain) > best[0]):
                    best = ((gain / (int(good[hit].sum()) + 1), gain), r, use)
        if best is None:
            return out
        now[best[1]] = best[2]
        left &= levels[:, best[1]] >= best[2]
        out.append(tuple(now))


def chosen(rows: pd.DataFrame, risk: float, chance: float) -> tuple[int, ...]:
    """The cutoffs in use of one stratum. rows: levels, design, good and how many documents there are."""
    levels = np.array(rows["levels"].tolist()).reshape(len(rows), len(RULES))
    n, design, good = (rows[c].to_numpy() for c in ("n", "design", "good"))
    sets = path(levels, n * (design & ~good), n * (design & good), [len(r.cutoffs) for r in RULES])
    held = n * (~design & good)
    taken = (0,) * len(RULES)
    for use in sets:
        if not passes(int(held[(levels < np.array(use)).any(axis=1)].sum()), int(held.sum()), risk, chance):
            break
        taken = use
    return taken


def cutoffs(measured_docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and uses (for each of RULES, how many cutoffs are in use) of the strata with labelled documents enough."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    known = measured_docs.where("NOT base_failed").join(named, "doc_id")
    design = (F.crc32(F.col("doc_id").cast("string")) % DESIGN == 0).alias("design")
    counts = known.select("stratum", F.array(*map(level, RULES)).alias("levels"), design, (F.col("quality") == 1).alias("good")).groupBy("stratum", "levels", "design", "good").agg(F.count("*").alias("n"))
    counts = shared_table(counts, "levels")
    enough = counts.where("good AND NOT design").groupBy("stratum").agg(F.sum("n").alias("held")).where(F.col("held") >= fewest(risk, delta))
    strata = enough.count()
    chance = delta / max(1, strata)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": rows["stratum"].iloc[:1], "uses": [list(chosen(rows, risk, chance))]})

    tested = counts.join(enough.select(F.col("stratum").alias("tested")), F.col("stratum").eqNullSafe(F.col("tested")), "left_semi")
    out = shared_table(tested.groupBy("stratum").applyInPandas(choose, "stratum string, uses array<int>"), "cutoffs")
    drop_shared(counts)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, bound: int | None = None) -> DataFrame:
    """doc_id, stratum, MEASURES, base_failed, rule (the first of RULES that rejects, else null), kept for every row of docs.

    bound: strata up to which their cutoffs are broadcast; beyond it they are joined by stratum.
    """
    bound = BROADCAST_ROWS if bound is None else bound
    found = shared_table(measures(docs, stratum), "measures")
    uses = cutoffs(found, labels, risk, delta).withColumnRenamed("stratum", "tested")
    few = uses.limit(bound + 1).count() <= bound
    both = found.join(F.broadcast(uses) if few else uses, F.col("stratum").eqNullSafe(F.col("tested")), "left")
    rejects = [level(r) < F.coalesce(F.col("uses")[k], F.lit(0)) for k, r in enumerate(RULES)]
    rule = F.coalesce(*(F.when(x, F.lit(k)) for k, x in enumerate(rejects)))
    both = both.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return both.select("doc_id", "stratum", *MEASURES, "base_failed", "rule", "kept")

