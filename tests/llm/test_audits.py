"""Operators 11 to 13 against plain versions, with odd rows, and against SQL."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import oracle
import pandas as pd
import pytest

from sparkhaul.llm import divergence, fill_middle, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_fill_in_middle"])
def test_equal_to_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE[name])


def odd_rows():
    rng = random.Random(5)
    words = ["Über", "çà", "alpha", "Beta", "gamma", "x1y2", "日本語", "delta", "Ünder", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.randint(1, 30)), ["aa", "bb"][k % 2], f"s{k % 5}") for k in range(40)]
    rows += [(40, None, "aa", "s9"), (41, "", "aa", None), (42, "12 34 !", "cc", "s0"), (43, "only here", "cc", "s1"), (44, text(4000), "bb", "é"), (45, text(9), None, None)]
    return rows + [rows[3], rows[3], (None, rows[4][1], "aa", "s1"), (None, None, None, "s2"), (46, "lone", "dd", "one")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    more = {c: docs.doc_id for c in ("term", "n", "first", "block", "value", "rank", "form", "output", "stratum", "kept", "rule", "n_words", "levels")}
    return docs.withColumns(more)


def divergence_by_hand(rows, least=3, top=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    find = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(find(t), s) for t, g, s in rows if g == lang]
        holders = Counter(w for t, _ in own for w in set(t))
        kept = sorted(w for w, n in holders.items() if n >= least)
        counts = {s: Counter() for _, s in own} | {None: Counter()}
        for t, s in own:
            for w in t:
                if holders[w] >= least:
                    counts[s][w] += 1
                    counts[None][w] += 1
        p = {s: {w: 1 + math.floor(Fraction(10**9 * (c[w] + 1), c.total() + len(kept))) for w in kept} for s, c in counts.items()}
        for s in counts.keys() - {None}:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o, "pair") for o in counts if o not in (None, s)]
            terms = [((p[s][w] - p[None][w]) ** 2 // p[None][w], w, "term") for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for found in (pairs, terms):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item, part) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"TILE_CELLS": 12, "PAIR_CELLS": 7, "WORK_CELLS": 10, "HELD_TERMS": 5}])
@pytest.mark.parametrize("top", [2, 200])
def test_divergence(spark, monkeypatch, limits, top):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()
    found = divergence.source_divergence(frame(spark, rows), top=top, bound=0 if limits else None).collect()
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found)
    assert got == divergence_by_hand(rows, top=top) and any(r.lang == "" for r in found)
    assert divergence.source_divergence(frame(spark, rows).limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(500):
        total = rng.randrange(1, 9 * 10 ** rng.randint(1, 15))
        count = rng.randrange(0, total)
        got = int(divergence.share(np.array([count]), np.array([total]))[0])
        assert got == 1 + 10**9 * (count + 1) // total


def tokens_of(text):
    return re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    w = tokens_of(text)
    n = len(w)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def fill_rows():
    rng = random.Random(7)
    pieces = ["a", "é", "日本", " ", "\n", "\t ", "<", ">", "P", "<S", "M>", "\x0b", " ", "😀", "word"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(300, None), (301, "   "), (302, "has <P> inside"), (303, "x " * 70_000), (304, "y" * 5000), (None, "no id at all"), (None, None), (-7, "a b c d e f")]
    return [*rows, rows[5], rows[5]]


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_fill_in_middle(spark, monkeypatch, block):
    rows = fill_rows() if block > 8 else fill_rows()[:300]
    if block == 8:  # bits and characters across blocks
        monkeypatch.setattr(fill_middle, "BLOCK_BYTES", block)
        for doc_id, text in rows:
            b = text.encode()
            places = fill_middle.Boundaries(b)
            ends = np.cumsum([0, *(len(w.encode()) for w in tokens_of(text))]).tolist()
            assert places.total == len(ends) - 1 and [places.select(k) for k in range(len(ends))] == ends
            assert fill_middle.characters(b) == len(text)
        return
    docs = frame(spark, [(*r, None, None) for r in rows])
    found = fill_middle.fill_in_middle(docs)
    back = found.withColumn("back", fill_middle.restored(found.output, found.form)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted((by_hand(*r) for r in rows), key=key)
    assert Counter((r.doc_id, r.back) for r in back) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in back} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle_digest(docs.limit(0)).count() == 0


def measured_by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    chars = [c for w in words for c in w]
    count = lambda of: sum(c in of for c in chars)
    return [len(words), len(chars), count("#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in chars), count("!?"), count("0123456789")]


def rule_rows():
    rng = random.Random(8)
    words = ["Über", "çà", "alpha", "Beta", "gamma", "delta", "日本語", "eps", "zeta", "eta"]
    rows, labels = [], []
    for k in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(18, 60))]
        bad = k % 4 == 0
        if bad:
            own = [f"{w}{rng.choice(['###', '!!', '$$', ''])}" for w in own]
        text = " ".join(own) if k % 3 else "\n".join([" ".join(own[:10]), *own[10:], *([" ".join(own[:10])] * (k % 5))])
        rows.append((k, text, ["aa", "bb", None][k % 3 if k < 890 else 1]))
        labels.append((k, int(not bad) if k % 97 else 1 - int(not bad)))
    rows += [(900, None, "aa"), (901, "", None), (902, " \n\t", "bb"), (903, "a b c d e f g h " * 20, "aa"), (904, "one\n\none\n one\none", "cc"), (None, rows[4][1], "aa"), (None, None, None), (905, "long text " * 30_000, "bb")]
    labels += [(None, 1), (3, None), (5, 0), (5, 1), (10_000, 1)]
    return [*rows, rows[6], rows[6]], labels


def verdicts_by_hand(rows, labels, risk, delta):
    told: dict = {}
    for i, y in labels:
        if i is not None and y is not None:
            told.setdefault(i, set()).add(y)
    told = {i: y.pop() for i, y in told.items() if len(y) == 1}
    docs = [(i, g, m, m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t, g in rows for m in [measured_by_hand(t)]]

    def rejected(m, use):
        v = dict(zip(quality_rules.MEASURES, m, strict=True))
        hits = []
        for r, k in zip(quality_rules.RULES, use, strict=True):
            ratio = [1000 * v[r.part] < c * v[r.whole] if r.under else 1000 * v[r.part] > c * v[r.whole] for c in r.cutoffs[:k]]
            hits.append(any(ratio))
        return hits

    fold = lambda i: crc32(str(i).encode()) % quality_rules.DESIGN == 0
    known = {}
    for i, g, m, failed in docs:
        if not failed and i in told:
            known.setdefault(g, []).append((m, told[i], fold(i)))
    least = math.log(delta) / math.log(1 - risk)
    strata = [g for g, own in known.items() if sum(y == 1 and not d for _, y, d in own) >= least]
    uses = {}
    for g in strata:
        design, held = [(m, y) for m, y, d in known[g] if d], [m for m, y, d in known[g] if not d and y == 1]
        now, taken = (0,) * len(quality_rules.RULES), (0,) * len(quality_rules.RULES)
        while True:
            options = []
            for r, rule in enumerate(quality_rules.RULES):
                for k in range(now[r] + 1, len(rule.cutoffs) + 1):
                    then = (*now[:r], k, *now[r + 1 :])
                    new = [y for m, y in design if any(rejected(m, then)) and not any(rejected(m, now))]
                    gain, loss = new.count(0), new.count(1)
                    if gain:
                        options.append((Fraction(gain, loss + 1), gain, -r, -k, then))
            if not options:
                break
            now = max(options)[-1]
            x, n = sum(any(rejected(m, now)) for m in held), len(held)
            tail = sum(math.comb(n, k) * Fraction(str(risk)) ** k * (1 - Fraction(str(risk))) ** (n - k) for k in range(x + 1))
            if tail > Fraction(str(delta)) / len(strata):
                break
            taken = now
        uses[g] = taken
    return Counter((i, g, *m, failed, not failed and not any(rejected(m, uses.get(g, (0,) * len(quality_rules.RULES))))) for i, g, m, failed in docs), uses


@pytest.mark.parametrize(("risk", "bound"), [(0.05, None), (0.1, 0)])
def test_quality_rules(spark, risk, bound):
    rows, labels = rule_rows()
    docs = frame(spark, [(*r, None) for r in rows])
    named = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "1 AS kept", "2 AS stratum")
    expected, uses = verdicts_by_hand(rows, labels, risk, 0.05)
    found = quality_rules.quality_rules(docs, named, risk=risk, bound=bound).collect()
    assert Counter((r.doc_id, r.stratum, *(r[m] for m in quality_rules.MEASURES), r.base_failed, r.kept) for r in found) == expected
    assert any(any(u) for u in uses.values()) and any(r.rule is not None for r in found)
    nothing = quality_rules.quality_rules(docs, named.limit(0)).collect()
    assert all(r.kept is not r.base_failed for r in nothing) and len(nothing) == len(rows)
    assert quality_rules.quality_rules(docs.limit(0), named).count() == 0


def test_bounds_are_exact():
    for n in (1, 30, 149, 150, 151, 500, 3000):
        for risk in (0.02, 0.1):
            for chance in (0.05, 0.0125):
                for x in {0, 1, 2, 5, int(n * risk * 0.6), int(n * risk)}:
                    tail = sum(math.comb(n, k) * Fraction(str(risk)) ** k * (1 - Fraction(str(risk))) ** (n - k) for k in range(min(x, n) + 1))
                    assert quality_rules.passes(x, n, risk, chance) == (x < risk * n and tail <= Fraction(str(chance))), (n, risk, chance, x)
    least = quality_rules.fewest(0.02, 0.05)
    assert quality_rules.passes(0, least, 0.02, 0.05) and not quality_rules.passes(0, least - 1, 0.02, 0.05)


def test_false_rejections_stay_within_the_risk():
    """Strata whose good documents break a rule more often than the risk allows: in all but a few draws they lose no more."""
    rng = np.random.default_rng(9)
    broken = 0
    for _ in range(200):
        true = rng.uniform(0.0, 0.08)
        rows = []
        for design, good, n, share in ((True, True, 150, true), (True, False, 60, 0.9), (False, True, 400, true)):
            hit = int(rng.binomial(n, share))
            full = [len(r.cutoffs) for r in quality_rules.RULES]
            rows += [([0, *full[1:]], design, good, hit), (full, design, good, n - hit)]
        use = quality_rules.chosen(pd.DataFrame(rows, columns=["levels", "design", "good", "n"]), 0.02, 0.05)
        broken += any(use) and true > 0.02
    assert broken <= 12
