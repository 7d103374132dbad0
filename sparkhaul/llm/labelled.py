"""What the trained operators share: hold-out folds, the bounded training sample, and columns of a scored frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_table, texts

#: How many times the rows wanted of a label are looked at, and some more, by the hash of their ids.
MARGIN, MORE = 2, 64


def fold(parts: int):
    """crc32 of the id as text, modulo parts; a row without id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, learnable, rows: int, per_class: bool = False) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents (of each label, if per_class) that satisfy `learnable`.

    The sample is the rows with the least hash of their id: the same for the same tables, whatever
    their order or partitions. Only ids are sorted; texts are then read for the chosen ids, of several texts of one id the
    least. labels: doc_id and label. Labels that are null, or given to one id in two ways, are not used. With per_class every label has its rows, however
    many labels there are.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").where(learnable)
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    draw = labels.withColumn("draw", F.xxhash64("doc_id"))
    if per_class:
        # hashes are even over their range, so the least ones of a label lie below a bound that its count tells: what meets in
        # one task are some MARGIN times the rows wanted. That fewer than wanted are left has a chance of one in many billions
        counts = draw.groupBy("label").agg(F.count("*").alias("n"))
        told = F.broadcast(counts) if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else counts
        place = F.col("draw") / 2.0**64 + 0.5
        few = draw.join(told, "label").where(place <= (rows * MARGIN + MORE) / F.col("n"))
        least = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
        draw = few.withColumn("place", least).where(F.col("place") <= rows).drop("place", "n")
        chosen = shared_table(draw.select("doc_id", "label"), "sample")
        chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    else:
        chosen = F.broadcast(draw.orderBy("draw", "doc_id").limit(rows).select("doc_id", "label"))
    found = texts(docs).where("doc_id IS NOT NULL").join(chosen, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").orderBy("doc_id")
