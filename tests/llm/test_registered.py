"""The registered queries that SQL cannot express, run as they are over whole tables."""

import pytest

from sparkhaul.llm import queries
from sparkhaul.llm.common import table

SF = "/root/testdata/sf0.01"
PER_DOCUMENT = ["op2_quality_classifier", "op3_toxicity", "op7_language_id"]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_each_document_has_its_prediction(spark, name):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    found = queries.QUERIES[name](spark, SF)
    both = docs.join(found, "doc_id", "full").collect()
    assert len(both) == docs.count()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in both)
    if name == "op7_language_id":
        asked = [r for r in both if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
        assert len(asked) > 200 and sum(r.lang_pred == r.lang for r in asked) >= 0.99 * len(asked)


def test_tokens_of_sections_add_up(spark):
    found = queries.op1_token_counts(spark, SF).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max"}).collect()
    assert len(found) == table(spark, SF, "documents").count()
    assert all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in found)


def test_items_are_found_whole(spark):
    """Every document that holds a whole test item, word for word, is told with it."""
    items = {r.item_id: (r.text or "").lower().split() for r in table(spark, SF, "benchmark").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()}
    expected = set()
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        text = " ".join((r.text or "").lower().split())
        expected |= {(r.doc_id, i) for i, words in items.items() if words and f" {' '.join(words)} " in f" {text} "}
    assert expected and expected <= found


def test_sequences_are_gapless(spark):
    pieces = queries.op10_packing(spark, SF).collect()
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
