"""Small relational operators that the larger ones are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order, which should be total."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """table and the rows of new whose key it doesn't have, the first of each key."""
    return table.unionByName(first_per_key(new, key, *order).join(table.select(key), key, "left_anti").select(table.columns))


def merge_greatest(table: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Counters by key, each value the greatest of old and new: replays and late snapshots change nothing."""
    return table.unionByName(new).groupBy(*key).agg(*(F.max(v).alias(v) for v in values))


def count_per(left: DataFrame, right: DataFrame, key: str, *counts: Column) -> DataFrame:
    """Every row of left with counts over its rows in right, which is aggregated before it is joined. Only counts are filled with 0."""
    counted = right.groupBy(key).agg(*counts)
    return left.join(counted, key, "left").na.fill(0, [c for c in counted.columns if c != key])


def digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' texts, each behind its length, so no two rows run together; null is not the empty text."""
    texts = (F.col(c).cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in texts)), 256)


def missing_rows(backup: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of backup whose contents table doesn't have."""
    return backup.withColumn("digest", digest(backup, columns)).join(table.select(digest(table, columns).alias("digest")), "digest", "left_anti")


def share_of_group(df: DataFrame, group: str, count: str) -> Column:
    return F.col(count) / F.sum(count).over(Window.partitionBy(group))


def fuzzy_two(names: DataFrame, known: DataFrame, margin: int) -> DataFrame:
    """name, candidate, edits, second: the other known name with the fewest edits, and the edits of the runner-up, if any.

    For names of eight characters at least. Candidates within 0.35 of the length and `margin` edits more are looked for: names
    meet by length, and no other pair is left out. So many edits leave unchanged pieces of one or two characters only, by
    which nearly all pairs would meet again.
    """
    length = F.length("name")
    reach = F.floor(length * 35 / 100).cast("int") + margin
    names = names.select("name").distinct().where(length >= 8).withColumn("reach", reach)
    spans = names.withColumn("n", F.explode(F.sequence(length - F.col("reach"), length + F.col("reach"))))
    known = known.select("candidate").distinct().withColumn("n", F.length("candidate"))
    pairs = spans.join(known, "n").where("name <> candidate")
    pairs = pairs.withColumn("edits", F.levenshtein("name", "candidate").cast("long")).where("edits <= reach")
    two = pairs.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("edits", "candidate"))).where("r <= 2").groupBy("name")
    return two.agg(F.min_by("candidate", "r").alias("candidate"), F.min("edits").alias("edits"), F.max(F.when(F.col("r") == 2, F.col("edits"))).alias("second"))


def fuzzy_best(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, candidate, edits: the best of fuzzy_two.

    Refused: more edits than 0.35 of the length, a runner-up less than three edits behind, other digits.
    """
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), " ")
    best = fuzzy_two(names, known, 2)
    near = (F.col("edits") * 100 <= F.length("name") * 35) & (F.coalesce(F.col("second") - F.col("edits"), F.lit(3)) >= 3)
    return best.where(near & (digits("name") == digits("candidate"))).select("name", "candidate", "edits")


def answered(df: DataFrame, keys: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of df whose key is asked for; none at all if more than `most` keys are asked for."""
    asked = keys.select(key).distinct()
    few = asked.limit(most + 1).count() <= most
    return df.where(F.lit(few)).join(F.broadcast(asked) if few else asked, key, "left_semi")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a number from 1 on in the given order, without one task for all rows.

    Rows are dealt into ranges of the order and numbered in each; a range begins behind the rows of those before it.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")  # the bounds are sampled, so once only
    inside = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # one row for each range
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inside.join(F.broadcast(before), "__range").withColumn(name, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")
