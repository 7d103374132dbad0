import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkhaul.llm import decontamination, exact_dedup, jaccard_join, labelled, language_id, line_dedup, packing, quality, substring_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, draw string, sig int, kept boolean"
WORDS = [f"w{chr(97 + k % 26)}{k}" for k in range(60)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages and lines, null, empty and blank texts, repeated rows and a row without id."""
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, hot = line(50), line(12)
    texts = ["\n".join(line(rng.randint(3, 40)) for _ in range(3)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[1] + " tail", "x " + texts[1], texts[2].replace("w", "W", 3)]
    texts += [f"{line(5)} {passage} {line(k)}\n{hot}" for k in range(8)] + [passage, hot, "a b", "a b", "", None, " \t\n ", "é" * 50, line(9000)]
    rows = [(k, t, "en" if k % 2 else "fr", "x", 1, True) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    found = token_counts.section_tokens(docs, path, P.PATTERN).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    totals: dict = {}
    for r in found:
        totals.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.n_tokens
    for doc_id, text, *_ in corpus():
        if doc_id is not None and doc_id != 3:
            expected = whole.encode(text or "", add_special_tokens=False)
            assert totals[doc_id] == [len(expected.ids)] * 2
            for r in (r for r in found if r.doc_id == doc_id and len(text or "") < 300):
                starts = [sum(r.start_char <= a < r.end_char for a, b in expected.offsets), r.n_tokens]
                assert r.n_crossing or starts[0] == starts[1]
    assert token_counts.section_tokens(empty, path, P.PATTERN).count() == 0


def test_crossing_tokens_follow_the_rule():
    ends, bounds = np.array([2, 7, 9]), np.array([0, 3, 6, 9])
    assert [token_counts.attribute(ends, bounds, rule)[0].tolist() for rule in token_counts.RULES] == [[1, 1, 1], [2, 0, 1], [1, 0, 2]]
    assert token_counts.attribute(np.array([4]), np.array([0, 2, 4]))[0].tolist() == [1, 0]  # the earliest of equals


def test_field_tokens(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("user", "hello there"), (None, None)], "role string, text string")
    assert [tuple(r)[2:] for r in token_counts.field_tokens(df, ["role", "text"], path, P.PATTERN).collect()] == [(2, 2), (1, 0)]


def test_exact_dedup(docs, empty):
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, owners=3).collect()}
    groups: dict = {}
    for doc_id, text, *_ in corpus():
        groups.setdefault(lower(text), []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert found == {(i, keep[t], len(ids), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        values = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, 1 << 40)) == values).all()


def test_line_dedup(docs, empty):
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs, bits=1 << 16).collect()}
    holders: dict = {}
    keyed = [(i, [(x, lower(x.strip(" \t\n\x0b\x0c\r"))) for x in (t or "").split("\n")]) for i, t, *_ in corpus()]
    for n, (doc_id, lines) in enumerate(keyed):
        for _, k in lines:
            if len(k) >= 40:
                holders.setdefault(k, {})[n] = doc_id
    for doc_id, lines in keyed:
        kept = [x for x, k in lines if len(holders.get(k, ())) < 5 or doc_id == max(i for i in holders[k].values() if i is not None)]
        assert found[doc_id][:2] == (len(lines), len(lines) - len(kept))
        assert found[doc_id][2] in (None, "\n".join(kept))
    whole = line_dedup.without_repeated_lines(docs, bits=1 << 16)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    assert line_dedup.line_dedup_digest(empty, bits=1 << 16).count() == 0


def brute_components(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words(lower(text))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sets.pop(None)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent, often", [(4, 85, 40), (2, 60, 1)])
def test_jaccard_join(docs, empty, monkeypatch, n, percent, often):
    monkeypatch.setattr(jaccard_join, "FREQUENT", often)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n, percent).collect() if r.doc_id is not None}
    assert found == brute_components(corpus(), n, percent)
    assert jaccard_join.one_of_each_group(docs).columns == docs.columns
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_parity_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 390))) for _ in range(2))
        assert jaccard_join.least_difference(*(jaccard_join.unpacked(jaccard_join.parity_bits(x)) for x in (a, b))) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [35, 4])
def test_substring_dedup(docs, empty, size):
    found = sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(docs, size).collect())
    tokens = [(i, words(t)) for i, t, *_ in corpus()]
    counts: dict = {}
    for _, w in tokens:
        for k in range(len(w) - size + 1):
            counts[tuple(w[k : k + size])] = counts.get(tuple(w[k : k + size]), 0) + 1
    expected = []
    for i, w in tokens:
        gone = {j for k in range(len(w) - size + 1) if counts[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        expected.append(((i is None, i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert found == sorted(expected)
    assert substring_dedup.substring_dedup_digest(empty).count() == 0


def test_packing(docs, empty):
    path = P.path("word_bpe_49k.json")
    found = packing.pack(docs, path, 256, 20).collect()
    whole = packing.ChunkEncoder(path).tokenizer
    for doc_id, text, *_ in corpus():
        if doc_id not in (None, 3):
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in own)
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 256
    assert packing.pack(empty, path).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    room: list = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= lengths[i]
        assert bins[i] == k


def test_decontamination(spark, docs, empty):
    items = [(1, corpus()[0][1]), (2, "what is the answer to nothing at all here. it is forty two and no more"), (3, None), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert {(0, 1), (30, 1), (31, 1)} <= found and not any(i == 2 for _, i in found)
    kept = decontamination.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and {0, 30, 31}.isdisjoint(r.doc_id for r in kept.collect())
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == decontamination.contaminated(empty, benchmark).count() == 0


@pytest.mark.parametrize("size", [65, 150, 200, 1000])
def test_decontamination_of_long_items(spark, size):
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{line(size - 10)}\n{line(10)}") for k in range(4)] + [(9, line(20))]
    body = items[0][1].replace("\n", " ").split()
    swapped = " ".join("x" if k % 12 == 0 else w for k, w in enumerate(body))  # three of twelve 3-grams go
    texts = [f"{line(at)} {items[0][1]} {line(at)}" for at in (0, 1, 16, 31, 500)] + [swapped, " ".join(body[: size // 3]), line(2000), f"{line(7)} {items[4][1]}"]
    docs = spark.createDataFrame([(k, t, None, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect())
    assert found == [(k, 0) for k in range(6)] + [(8, 9)]
    assert sorted(r.doc_id for r in decontamination.clean_documents(docs, benchmark).collect()) == [6, 7]


def test_search_finds_all_above_the_threshold():
    rng = random.Random(4)
    index = decontamination.Index([(k, " ".join(rng.choice(WORDS) for _ in range(12)).encode()) for k in range(80)])
    impact = [{t: dict(p)[i] for t, p in enumerate(index.postings) if i in dict(p)} for i in range(80)]
    for _ in range(60):
        ids = np.array([index.term.get(rng.choice(WORDS).encode(), len(index.term)) for _ in range(64)])
        query = sorted({int(k) for k in ids if k < len(index.term)})
        exact = {i for i, w in enumerate(impact) if sum(w.get(t, 0) for t in query) >= 0.4}
        assert {i for i, _ in index.search(query, 0.4)} == exact
        assert not exact or 0 in index.likely(ids)


def test_classifiers_learn_and_handle_odd_rows(spark, empty):
    rng = random.Random(6)
    spelled = ["".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]  # letters only: digits say nothing of a language
    rows = [(k, " ".join(rng.choice(spelled[:30] if k % 2 else spelled[30:]) for _ in range(30)), "aa" if k % 2 else "bb", k % 2) for k in range(240)]
    odd = [(900, None, "aa", None), (901, "", None, 1), (902, "1 2 3", "bb", 0), (None, "x", None, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, quality int").withColumnRenamed("quality", "toxic")
    labels = docs.selectExpr("doc_id", "toxic", "toxic AS quality")
    truth = {r[0]: r[3] for r in rows}
    for found in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        got = found.collect()
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(got) == 244 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
        assert all(0 <= r.score <= 1 for r in got)
    langs = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert langs[900] == langs[901] == langs[902] == "und"
    assert sum(langs[i] == ("aa" if y else "bb") for i, y in truth.items()) >= 0.95 * len(truth)
    for found in (quality.quality(empty, labels), toxicity.toxicity(empty, labels.limit(0)), language_id.language_id(empty)):
        assert found.count() == 0


def test_every_label_is_sampled(spark):
    """130 rare labels come before the two that have nearly all rows."""
    rare = [(k, f"x{k}", f"a{k:03}") for k in range(130)]
    docs = spark.createDataFrame([*rare, *((k, f"y{k}", "zz" if k % 3 else "zy") for k in range(130, 1000))], "doc_id long, text string, label string").repartition(5)
    named = docs.select("doc_id", "label")
    found = labelled.sample(docs, named, F.lit(True), 20, per_class=True).collect()
    own = {r.doc_id: (r.text, r.label) for r in docs.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw").collect()}
    expected: dict = {}
    for i, (_, label) in own.items():
        expected.setdefault(label, []).append(i)
    assert {r.doc_id for r in found} == {i for ids in expected.values() for i in ids[:20]} and len(found) == 170
    assert all((r.text, r.label) == own[r.doc_id] for r in found)


def test_language_after_many_labels_is_predicted(spark):
    rng = random.Random(8)
    spelled = ["".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    text = lambda part: " ".join(rng.choice(part) for _ in range(20))
    junk = [(k, " ".join(chr(0x4E00 + 50 * k + j) for j in range(5)), f"a{k:03}") for k in range(150)]
    rows = [(k, text(spelled[:30] if k % 2 else spelled[30:]), "zy" if k % 2 else "zz") for k in range(200, 300)]
    docs = spark.createDataFrame([*junk, *rows], "doc_id long, text string, lang string")
    langs = {r.doc_id: r.lang_pred for r in language_id.language_id(docs, 20).collect()}
    assert sum(langs[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)


def test_registered_queries_equal_sql(spark):
    from oracle import connect, same

    from sparkhaul.llm import queries

    con = connect("/root/testdata/sf0.001")
    for name, sql in queries.ORACLE.items():
        same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, sql)


def test_pipeline_equals_stages_by_hand(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
    lines: dict = {}
    for i in good:
        for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in (texts[i] or "").split("\n")}:
            lines.setdefault(k, set()).add(i)
    gone = {k: max(ids) for k, ids in lines.items() if len(k) >= 40 and len(ids) >= 5}
    left = {i: "\n".join(x for x in (texts[i] or "").split("\n") if gone.get(lower(x.strip(" \t\n\x0b\x0c\r")), i) == i) for i in good}
    firsts = {i for i, (_, c) in brute_components([*left.items(), (None, "")], 5, 80).items() if c == i}
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontamination.Index(items)
    clean = {i for i in firsts if not decontamination.matches_in(decontamination.terms(left[i].encode()), index)}
    assert {r.doc_id for r in found} == clean
