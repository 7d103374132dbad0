"""Exact order statistics of groups of any size: selection by rank, in rounds over histograms.

The value at a place of a group is looked for between two bounds. Each round counts the group's rows between the bounds in BINS
equal bins, with the least and greatest value of each bin, and keeps the bin that holds the place. Counts are partial aggregates: a task
sends BINS rows for a group at most, however many rows it has, so a group with most of all rows is no single task. Once FEW rows or
less lie between the bounds they are sorted, and if all values there are equal nothing is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled

#: Bins of a round, rows of a group that may be sorted in one task, rows of bounds up to which they are broadcast.
BINS, FEW, BROADCAST_ROWS = 1024, 50_000, 100_000


def _bounds(df: DataFrame) -> DataFrame:
    """Broadcast if they are few: rows of a hot group then stay where they are."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def values_at(df: DataFrame, keys: list[str], value: str, places: DataFrame, few: int = FEW, bins: int = BINS) -> DataFrame:
    """places (keys, place, counted from 0) with `value`: what stands at each place of the group's values in ascending order.

    Null values do not count; a place outside the group has no row. Groups are told apart by keys without nulls.
    """
    rows = settled(df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL"), "ranked")
    sizes = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("*").alias("__n"))
    state = places.select(*keys, "place").distinct().join(sizes, keys).where((F.col("place") >= 0) & (F.col("place") < F.col("__n")))
    state = settled(state.withColumn("__k", F.col("place")), "bounds")
    target, between = [*keys, "place"], (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    found = None
    while True:
        same = state.where("__low = __high").select(*target, F.col("__low").alias(value))
        sort = state.where((F.col("__low") < F.col("__high")) & (F.col("__n") <= few))
        order = Window.partitionBy(*target).orderBy("__v")  # `few` rows at most
        sorted_ = rows.join(_bounds(sort), keys).where(between).withColumn("__r", F.row_number().over(order)).where(F.col("__r") == F.col("__k") + 1).select(*target, F.col("__v").alias(value))
        done = same.unionByName(sorted_)
        found = done if found is None else found.unionByName(done)
        large = state.where((F.col("__low") < F.col("__high")) & (F.col("__n") > few))
        if large.isEmpty():
            return found
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")) * bins).cast("int"))
        counted = rows.join(_bounds(large), keys).where(between).withColumn("__b", bin_).groupBy(*target, "__k", "__b")
        counted = counted.agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("*").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*target).orderBy("__b"))  # one row for each bin
        held = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__n") <= F.col("__k")))
        state = settled(held.withColumn("__k", F.col("__k") - (F.col("__upto") - F.col("__n"))).drop("__b", "__upto"), "bounds")


def _long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*keys, each.alias("e")).select(*keys, "e.name", "e.value")


def medians(df: DataFrame, keys: list[str], columns: list[str], few: int = FEW) -> DataFrame:
    """keys, n, and for each of columns its median under that name (the mean of the middle two). Null values do not count; n counts rows."""
    long = _long(df, keys, columns)
    n = F.count("value")
    places = long.groupBy(*keys, "name").agg(n.alias("n")).withColumn("place", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
    middle = values_at(long, [*keys, "name"], "value", places.where("n > 0"), few).groupBy(*keys, "name").agg((0.5 * F.min("value") + 0.5 * F.max("value")).alias("value"))
    wide = middle.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(wide, keys, "left")


def middles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, and for each of columns its values in the middle, as median_without reads them. Null values do not count; n counts rows."""
    long = _long(df, keys, columns)
    sizes = settled(long.groupBy(*keys, "name").agg(F.count("value").alias("size")), "sizes")
    half = F.floor(F.col("size") / 2)
    three = values_at(long, [*keys, "name"], "value", sizes.withColumn("place", F.explode(F.array(half - 1, half, half + 1))))
    at = lambda c, d: F.max(F.when((F.col("name") == c) & (F.col("place") == half + d), F.col("value")))
    told = lambda c: F.struct(F.max(F.when(F.col("name") == c, F.col("size"))).alias("size"), *(at(c, d).alias(n) for n, d in (("low", -1), ("mid", 0), ("high", 1))))
    wide = sizes.join(three, [*keys, "name"], "left").groupBy(*keys).agg(*(told(c).alias(f"{c}_middle") for c in columns))
    return settled(df.groupBy(*keys).agg(F.count("*").alias("n")).join(wide, keys), "middles")


def median_without(column: str) -> Column:
    """The median of a group's values without the row's own (beside middles): the middle moves by one place at most."""
    own, size, low, mid, high = F.col(column), *(F.col(f"{column}_middle.{c}") for c in ("size", "low", "mid", "high"))
    mean = lambda a, b: 0.5 * a + 0.5 * b
    odd = F.when(own < mid, mean(mid, high)).when(own > mid, mean(low, mid)).otherwise(mean(low, high))
    whole = F.when(size % 2 == 1, mid).otherwise(mean(low, mid))
    return F.when(own.isNull(), whole).when(size % 2 == 1, odd).when(own <= low, mid).otherwise(low)


def value_at(df: DataFrame, keys: list[str], column: str, place: Column, few: int = FEW) -> DataFrame:
    """keys, column: the value at a place that is worked out of n, the number of the group's values."""
    places = df.groupBy(*keys).agg(F.count(column).alias("n")).select(*keys, place.cast("long").alias("place"))
    return values_at(df, keys, column, places, few).drop("place")


def beside(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their group; a broadcast if groups are few, so rows of a hot group stay where they are."""
    return df.join(_bounds(groups), keys)
