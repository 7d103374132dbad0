"""The text operators' methods against plain versions: dense, exhaustive or one at a time."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkhaul.llm import common, decontamination, language_id, line_dedup, packing, quality, substring_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_word_hashes_tell_words_apart():
    words = [b"", *(b"ab"[k & 1 : (k & 1) + 1] * n for n in (1, 7, 8, 9, 15, 16, 17, 40) for k in (0, 1))]
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(4096))  # no two such words differ in a sum of powers
    words += [a.encode(), a.translate({97: "b", 98: "a"}).encode(), b"a" * 4096, b"\xc3\xa9" * 9]
    h = common.word_hashes(b" \t\n".join(words))
    assert len(h) == len([w for w in words if w]) == len(set(h.tolist()))
    assert (common.word_hashes(b"x " + b"y" * 20)[1:] == common.word_hashes(b"\n" + b"y" * 20 + b"\x0b")).all()
    # sequences of two words in such a pattern differ too
    two = np.array([1, 2], np.uint64)
    for n in (4, 35, 64):
        left = two[[bin(k).count("1") & 1 for k in range(n)]]
        assert common.ngrams(left, n) != common.ngrams(two[::-1][[bin(k).count("1") & 1 for k in range(n)]], n)


def test_blocks_give_the_same_words(monkeypatch):
    text = sentence(random.Random(1), ["alpha", "be", "c", "d" * 30, "é"], 3000).encode()
    whole = common.word_hashes(text), [p[:4] for p in substring_dedup.phrases(text, 35)], np.sort(np.concatenate(list(quality.places(text))))
    windows = [w for words, at in toxicity.window_parts(text) for k in at for w in [words[k : k + toxicity.WINDOW]]]
    words = text.decode().split()
    assert windows == [words[k : k + toxicity.WINDOW] for k in toxicity.starts(len(words))]
    monkeypatch.setattr(common, "BLOCK_BYTES", 500)
    assert (common.word_hashes(text) == whole[0]).all()
    assert (np.sort(np.concatenate(list(quality.places(text)))) == whole[2]).all()
    assert [w for ws, at in toxicity.window_parts(text) for k in at for w in [ws[k : k + toxicity.WINDOW]]] == windows
    parts = list(substring_dedup.phrases(text, 35))
    assert len(parts) > 10 and sum(p[3].sum() for p in parts) == whole[1][0][3].sum() == len(words) - 34
    encoder = packing.ChunkEncoder(P.path("word_bpe_49k.json"))
    ids = [encoder(b.decode()) for b in common.blocks(text)]
    assert len(ids) > 10 and np.concatenate(ids).tolist() == encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    short = [list(decontamination.parts(text, 20))]
    monkeypatch.setattr(decontamination, "PART_WORDS", 200)
    pieces = list(decontamination.parts(text, 20))
    assert len(short[0]) == 1 and len(pieces) > 5
    begins = [base + s for ws, base, low, high in pieces for s in decontamination.passages(len(ws)) if s >= low and (high is None or s < high)]
    assert begins == decontamination.passages(len(words)).tolist()


def test_few_letters_of_a_window_before_it_is_known():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        text = " ".join(f"w{k}" for k in range(n)).encode()
        found = [tuple(ws[k : k + toxicity.WINDOW]) for ws, at in toxicity.window_parts(text) for k in at]
        assert found == [tuple(text.decode().split()[k : k + toxicity.WINDOW]) for k in toxicity.starts(n)]


def test_regularised_leader_against_dense_updates():
    rng = random.Random(2)
    rows = [(sentence(rng, ["good", "fine", "words"] if y else ["bad", "worse", "words"], 12).encode(), y) for y in (0, 1) * 12]
    w, bias = quality.train(rows, epochs=2)
    z, n = np.zeros(quality.PLACES + 1), np.zeros(quality.PLACES + 1)

    def weights():
        return np.where(np.abs(z) <= quality.L1, 0.0, (np.sign(z) * quality.L1 - z) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2))

    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = np.concatenate(list(quality.places(rows[i][0])))
            x = np.append(np.bincount(at, minlength=quality.PLACES) * (quality.SCALE / len(at)), 1.0)
            now = weights()
            g = (1 / (1 + np.exp(-now @ x)) - rows[i][1]) * x
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * now
            n += g * g
    assert np.allclose(np.append(w, bias), weights(), atol=1e-5)
    at = np.concatenate(list(quality.places(rows[0][0])))
    dense = np.bincount(at, minlength=quality.PLACES) * (quality.SCALE / len(at))
    assert math.isclose(quality.score_of(rows[0][0], w, bias), 1 / (1 + math.exp(-(dense @ w + bias))), rel_tol=1e-5)
    assert quality.score_of(None, w, bias) == quality.score_of(b"", w, bias) == 1 / (1 + math.exp(-bias))


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in toxicity.first_weights(4).items()}
    words = toxicity.vocabulary(["alpha", "beta", "gamma", "delta"], {"alpha": 1, "beta": 2})
    ids, labels = np.where(rng.random((3, toxicity.WINDOW)) < 0.2, -1, rng.integers(0, 4, (3, toxicity.WINDOW))), np.array([0.0, 1.0, 1.0])
    ids = np.sort(ids, axis=1)[:, ::-1].copy()  # what is beyond the end comes last

    def loss():
        p = toxicity.sigmoid(toxicity.forward(w, toxicity.gates_of(w, toxicity.word_vectors(w, *words)), ids).astype(np.float64))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = toxicity.gradients(w, words, ids, labels)
    for name in ("o", "ob", "av", "a", "ab", "hf", "hb", "xf", "bb", "word"):
        flat, grad = w[name].reshape(-1), found[name].reshape(-1)
        for k in sorted({int(np.argmax(np.abs(grad))), 0}):
            old, step = flat[k], 1e-2
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert math.isclose((up - down) / (2 * step), grad[k], rel_tol=0.05, abs_tol=2e-4), name


def test_documents_scored_window_by_window():
    rng = random.Random(5)
    texts = [None, "", " \n", *(sentence(rng, [f"w{k}" for k in range(50)], n) for n in (1, 24, 25, 300, 9000))]
    w = toxicity.first_weights(6) | {"known": {"w1": 1, "w7": 2}}
    found = toxicity.Scorer(w).scores(texts)
    for text, score in zip(texts, found, strict=True):
        words = (text or "").lower().split()
        each = []
        for k in toxicity.starts(len(words)):
            own = words[k : k + toxicity.WINDOW]
            vectors = toxicity.word_vectors(w, *toxicity.vocabulary(own, w["known"]))
            ids = np.concatenate([np.arange(len(own)), np.full(toxicity.WINDOW - len(own), -1)])[None]
            each.append(float(toxicity.sigmoid(toxicity.forward(w, toxicity.gates_of(w, vectors), ids))[0]))
        assert math.isclose(score, max(each, default=0.0), abs_tol=1e-5)


@pytest.fixture(scope="module")
def contamination():
    """Documents and items of many lengths, some items copied whole, edited, or in part."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = [(k, f"{sentence(rng, words, n)}\n{sentence(rng, words, 6)}") for k, n in enumerate([8, 15, 30, 58, 90, 200] * 3)]
    docs = []
    for k in range(40):
        own = items[k % len(items)][1].replace("\n", " ").split()
        kept = own if k % 4 == 0 else [x if rng.random() > 0.06 * (k % 4) else "zz" for x in own]
        docs.append((k, f"{sentence(rng, words, rng.randint(0, 150))} {' '.join(kept)} {sentence(rng, words, rng.randint(0, 90))}"))
    return docs, items


def exhaustive(docs, items):
    """Every passage against every piece of every item, with BM25 as in the book."""
    texts = {i: decontamination.terms(t.encode()) for i, t in items}
    cut = [(i, w[a:b]) for i, w in texts.items() for a, b in decontamination.pieces(len(w))]
    holding, mean = Counter(t for w in texts.values() for t in set(w)), sum(len(w) for _, w in cut) / len(cut)
    found = set()
    for doc_id, text in docs:
        words = decontamination.terms(text.encode())
        for i, piece in cut:
            tf = Counter(piece)
            norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(piece) / mean)
            weight = {t: math.log(1 + (len(texts) - holding[t] + 0.5) / (holding[t] + 0.5)) * f * (decontamination.K1 + 1) / (f + norm) for t, f in tf.items()}
            whole = sum(weight.values())
            question, answer = map(decontamination.grams, decontamination.question_and_answer(dict(items)[i].encode()))
            for start in decontamination.passages(len(words)).tolist():
                passage = set(words[start : start + decontamination.PASSAGE])
                if sum(w for t, w in weight.items() if t in passage) / whole < decontamination.THRESHOLD - 1e-9:
                    continue
                around = words[max(0, start - len(texts[i])) : start + decontamination.PASSAGE + len(texts[i])]
                if decontamination.share(question, around) >= decontamination.QUESTION and decontamination.share(answer, around) >= decontamination.ANSWER:
                    found.add((doc_id, i))
    return found


@pytest.mark.parametrize("shard_words", [10**6, 150])
def test_contamination_against_all_pairs(spark, contamination, shard_words):
    docs, items = contamination
    expected = exhaustive(docs, items)
    assert {(k, k % len(items)) for k in range(0, 40, 4)} <= expected
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    found = decontamination.contaminated(frame, benchmark, shard_words=shard_words).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)


def test_edited_long_items_are_found(spark):
    """Items of 70 to 200 words, one word in eight changed, at every offset from the passages."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(3000)]
    items = [(i, sentence(rng, words, 70 + 13 * i)) for i in range(11)]
    docs = []
    for k in range(64):
        changed = [w if j % 8 != k % 8 else f"new{j}" for j, w in enumerate(items[k % 11][1].split())]
        docs.append((k, " ".join([sentence(rng, words, 100 + k), *changed, sentence(rng, words, 50)])))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by_doc = {r.doc_id: r.item_id for r in found}
    grams = {i: decontamination.grams(decontamination.terms(t.encode())) for i, t in items}
    verified = {d for d, text in docs if decontamination.share(grams[d % 11], decontamination.terms(text.encode())) >= decontamination.QUESTION}
    assert len(verified) > 50 and all(by_doc.get(d) == d % 11 for d in verified) and all(i == d % 11 for d, i in by_doc.items())


def test_first_bound_in_runs(monkeypatch):
    """The passages passed on are the same for runs of any size, and memory does not grow with the text."""
    rng = random.Random(14)
    words = [f"w{k}" for k in range(300)]
    index = decontamination.Index([(i, sentence(rng, words, 30).encode()) for i in range(400)])
    text = [w.encode() for w in sentence(rng, words, 5000).split()]
    ids = np.array([index.term.get(w, len(index.term)) for w in text], np.int64)
    whole = index._likely(ids, len(decontamination.passages(len(ids))))
    assert len(whole)
    for run in (1, 1000, 7777):
        monkeypatch.setattr(decontamination, "RUN_POSTINGS", run)
        assert index.likely(ids).tolist() == whole.tolist()
    for short in (0, 1, 63, 64, 65, 96, 97):
        assert index.likely(ids[:short]).tolist() == index._likely(ids[:short], len(decontamination.passages(short))).tolist()
    monkeypatch.setattr(decontamination, "RUN_POSTINGS", 20_000)
    tracemalloc.start()
    index.likely(np.tile(ids, 8))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_machines_reach_the_least_objective(monkeypatch):
    monkeypatch.setattr(language_id, "PASSES", 400)  # the eight of the operator stop before the last digits
    rng = random.Random(8)
    texts = [(sentence(rng, ["abba", "baab", "abab"] if y > 0 else ["cddc", "dccd", "abab"], 6), y) for y in (1, -1) * 15]
    rows, signs = [language_id.features(t) for t, _ in texts], np.array([y for _, y in texts])
    used = np.unique(np.concatenate([at for at, _ in rows]))
    x = np.zeros((len(rows), len(used) + 1))
    for k, (at, v) in enumerate(rows):
        x[k, np.searchsorted(used, at)], x[k, -1] = v, 1.0

    def objective(w):
        return 0.5 * w @ w + language_id.COST * (np.maximum(0, 1 - signs * (x @ w)) ** 2).sum()

    found = language_id.machine(rows, signs)[np.append(used, -1)]
    w = np.zeros(x.shape[1])
    for _ in range(4000):  # plain gradient descent
        w -= 1e-3 * (w - 2 * language_id.COST * x.T @ (signs * np.maximum(0, 1 - signs * (x @ w))))
    assert objective(found) <= objective(w) * 1.02


def invented(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_families_of_several_languages():
    """Two groups of four languages each: the languages of a group share half of their words."""
    rng = random.Random(9)
    rows = []
    for group, letters in enumerate(("abcdeiou", "klmnprsv")):
        common_words = invented(rng, letters, 40)
        for k in range(4):
            own = invented(rng, letters, 40)
            rows += [(sentence(rng, common_words + own, 40), f"{'xy'[group]}{k}") for _ in range(25)]
    model = language_id.Model(rows)
    assert model.families == [("x0", "x1", "x2", "x3"), ("y0", "y1", "y2", "y3")] and len(model.pairs) == 12
    assert sum(model.predict(t)[0] == lang for t, lang in rows) >= 0.97 * len(rows)
    for text, _ in rows[::17]:  # without remembered words
        at, v = language_id.features(text)
        margins = model.weights[at].T @ v + model.bias
        k = int(np.argmax(margins[:2]))
        wins = Counter({n: 0 for n in model.families[k]})
        for (a, b), m in zip(model.pairs, margins[2:], strict=True):
            if a in wins:
                wins[a if m >= 0 else b] += 1
        assert wins[model.predict(text)[0]] == max(wins.values())


def test_predictions_over_large_vocabularies():
    """5,000 distinct words, in one text and in many, against a plain sum over each text's n-grams; also where a worker forgets."""
    rng = random.Random(12)
    words = {n: sorted({*invented(rng, letters, 3000)}) for n, letters in (("x", "abcdeiou"), ("y", "klmnprsv"))}
    rows = [(sentence(rng, words[n], 40), n) for n in "xy" for _ in range(30)]
    model = language_id.Model(rows)

    def plain(text):
        at, v = language_id.features(text)
        margins = model.weights[at].T @ v + model.bias
        return model.families[int(np.argmax(margins))][0] if len(model.families) > 1 else ("x" if margins[0] >= 0 else "y")

    every = [" ".join(w) for w in words.values()] + [sentence(rng, words["x"], 30) for _ in range(200)] + [w for w in words["y"][:300]]
    assert len({w for t in every for w in t.split()}) > 5000
    for most in (language_id.BLOCK_WORDS, 64):
        model.words.clear()
        model.most_words = most if most > 64 else model.most_words
        found = [model.predict(t)[0] for t in (every if most > 64 else every[::-1])]
        assert found == [plain(t) for t in (every if most > 64 else every[::-1])]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_that_cross_bounds(spark, rule):
    """Sections cut every three bytes, in the middle of tokens, against a walk over all bytes."""
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["several ordinary words", "é ü ñ", "", None, "several ordinary words"]
    docs = spark.createDataFrame([(k if k < 4 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, section string")
    every_third = lambda b: np.unique([*range(0, len(b), 3), len(b)]) if b else np.array([0, 0])
    found = token_counts.section_tokens(docs, path, P.PATTERN, every_third, rule).collect()
    for doc_id, text in enumerate(texts):
        b = (text or "").encode()
        bounds = every_third(b).tolist()
        expected, start = [0] * (len(bounds) - 1), 0
        for end in token_counts.token_ends(text or "", path, P.PATTERN).tolist() if text else []:
            of = [next(s for s in range(len(bounds) - 1) if bounds[s] <= x < bounds[s + 1]) for x in range(start, end)]
            expected[{"first": of[0], "last": of[-1], "most": max(set(of), key=lambda s: (of.count(s), -s))}[rule]] += 1
            start = end
        own = sorted((r.section, r.n_tokens) for r in found if r.doc_id == (doc_id if doc_id < 4 else None))
        assert [n for _, n in own] == expected


def lines_by_hand(rows, least_docs=5):
    holders = {}
    for n, (doc_id, text) in enumerate(rows):
        for line in set((text or "").lower().split("\n")):
            holders.setdefault(line.strip(), {})[n] = doc_id
    keep = {k: max((i for i in h.values() if i is not None), default=None) for k, h in holders.items() if len(k) >= 40 and len(h) >= least_docs}
    return Counter((i, sum(line.strip().lower() in keep and keep[line.strip().lower()] != i for line in (t or "").split("\n"))) for i, t in rows)


@pytest.mark.parametrize("limits", [{}, {"bits": 512}, {"most_bits": 8}])
def test_line_filters(spark, monkeypatch, limits):
    """Filters by size, full ones, and owners of ranges; ids below zero beside rows without id; look-ups beyond the broadcast bound."""
    rng = random.Random(10)
    hot = "the very same line stands in many documents here"
    rows = [(k, "\n".join(f"line {rng.random()} of its own and quite long enough" for _ in range(6)) + f"\n{hot}") for k in (-5, -4, -3, -1, 7)]
    only = "this line stands in documents without any id at all"
    rows += [(None, f"{hot}\n{only}")] * 2 + [(None, only)] * 4 + [(9, None), (10, ""), (11, "short\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if limits:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    found = line_dedup.line_dedup(docs, **limits).collect()
    assert Counter((r.doc_id, r.n_dropped) for r in found) == lines_by_hand(rows)


def test_equal_rows_are_spread_over_groups(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit(1).alias("draw"))
    found = packing.pack(docs, P.path("word_bpe_49k.json"), 64, 200)
    sizes = [r["count"] for r in found.groupBy(F.shiftright("sequence_id", 24)).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400
