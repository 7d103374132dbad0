"""Odd rows through every operator and the whole pipeline: nulls, repeated rows, clashing columns, empty tables."""

import random

import pytest

from sparkhaul.llm import decontamination, exact_dedup, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, draw long, seed long, t long, keep_id long, section long, _field_tokens string"
PATH = "word_bpe_49k.json"


def rows():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [line(rng.randint(5, 80)) for _ in range(24)]
    texts += [texts[0], texts[1] + " x", "", None, " \n\t", "ÀÉ " * 30, line(6000), "same line that is long enough to count as a line\n" + line(4)]
    out = [(k, t, ["aa", "bb"][k % 2], "s", len(t or ""), 0.5, True, 1, 2, 3, 4, 5, "z") for k, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[4], None, *[None] * 10), (None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2, 0.1) for k in range(24)] + [(3, 0, 0, 0.1), (None, 1, 1, 0.2), (5, None, None, 0.3)], "doc_id long, quality int, toxic int, score double")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, rows()[2][1], "x"), (1, rows()[5][1], "x"), (None, rows()[7][1], "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")


def operators(docs, labels, items):
    return {
        "tokens": token_counts.section_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "section").where("section = 0"),
        "quality": quality.quality(docs, labels),
        "toxicity": toxicity.toxicity(docs, labels),
        "language": language_id.language_id(docs),
        "jaccard": jaccard_join.jaccard_components(docs),
        "exact": exact_dedup.exact_dedup(docs),
        "substring": substring_dedup.substring_dedup_digest(docs),
        "packing": packing.pack(docs, P.path(PATH)).where("start = 0"),
    }


def test_every_row_has_its_result(docs, labels, items):
    expected = sorted((r[0] is None, r[0] or 0) for r in rows())
    for name, found in operators(docs, labels, items).items():
        got = found.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == expected, name
    counts: dict = {}
    for r in exact_dedup.exact_dedup(docs).collect():
        counts.setdefault((r.doc_id, r.group_size, r.kept), []).append(1)
    assert len(counts[3, 3, True]) == 3  # a repeated row is a row each time
    matched = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert {(2, 1), (5, 1), (7, None)} <= matched and not {i for _, i in matched} & {2, 3}


def test_no_rows_no_labels_no_items(docs, labels, items):
    for name, found in operators(docs.limit(0), labels, items).items():
        assert found.count() == 0, name
    none = labels.limit(0)
    one = labels.where("quality = 1")
    for some in (none, one):
        assert quality.quality(docs, some).where("score BETWEEN 0 AND 1").count() == toxicity.toxicity(docs, some).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", docs.lang.substr(1, 0)).where("lang = 'none'")).collect()} == set()


def test_fields_named_like_helpers(docs):
    found = token_counts.field_tokens(docs, ["lang", "text"], P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert found.columns[: len(docs.columns)] == docs.columns and found.where("_field_tokens = 'z'").count() == docs.where("_field_tokens = 'z'").count()


def test_pipeline_with_odd_rows_and_without_rows(spark, docs, labels, items, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "held_out")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns, name
                out.write.mode("overwrite").parquet(f"{tmp_path}/{some is docs}{k}")
                out = spark.read.schema(out.schema).parquet(f"{tmp_path}/{some is docs}{k}")
                assert out.count() <= now.count()
                now = out
            else:
                assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").distinct().collect()}
