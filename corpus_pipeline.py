"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Bad documents go, repeated lines go, one document of each group of near copies stays, documents that hold test
items go, and the rest is packed into training sequences.

Every stage works on whole rows: all columns of documents, also those named like what an operator makes, pass through all stages
but the last untouched, except for text and n_chars where lines went. Rows without id are judged by their text, and count as
documents of their own; near copies are only looked for among rows with an id. Rows repeated with one id stay or go together
as near copies and are rows of their own elsewhere. Null and empty texts have no near copies, lines or test items, and are
packed as the closing id alone if the classifier keeps them. An empty table of documents, labels or test items is no error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkhaul.llm.common import shared_table, table
from sparkhaul.llm.decontamination import clean_documents
from sparkhaul.llm.jaccard_join import one_of_each_group
from sparkhaul.llm.line_dedup import without_repeated_lines
from sparkhaul.llm.packing import pack
from sparkhaul.llm.quality import good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer cannot be said in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus (see packing.pack) for documents under sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
