"""Writing: upserts as new states of a table, slices, backups with a manifest, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import PAGE_BREAK


def merged(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table after an upsert: rows of new in place of those with their key, and null values of new leaving the old ones."""
    values = [c for c in table.columns if c not in key]
    old = table.select(*key, *(F.col(c).alias(f"old_{c}") for c in values))
    return old.join(new.select(*key, *values), key, "full").select(*key, *(F.coalesce(c, f"old_{c}").alias(c) for c in values))


def slice_replaced(table: DataFrame, new: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes table partitioned by `by`, then new over the partitions it has rows of; reads the result."""
    spark = table.sparkSession
    table.write.partitionBy(*by).parquet(path)
    new.select(*table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.schema(table.schema).parquet(path).select(*table.columns)


def updated(table: DataFrame, changes: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """table with the non-null values of changes in rows of their key; more changes than `most` are refused whole."""
    if most is not None and changes.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} changes at once")
    values = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *(F.col(c).alias(f"new_{c}") for c in values))
    return table.join(new, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in values else F.col(c) for c in table.columns))


def decided(evidence: DataFrame, driver: int, keys: DataFrame, approve: bool) -> DataFrame:
    """evidence after a decision on a driver's pending marks of some places: approved ones count, refused corrections go, refused passages stay as such."""
    asked = keys.select("place").distinct().withColumn("asked", F.lit(True))
    rows = evidence.join(asked, "place", "left").withColumn("hit", F.coalesce("asked", F.lit(False)) & F.col("pending") & (F.col("driver") == driver)).drop("asked")
    kept = rows if approve else rows.where(~(F.col("hit") & F.col("correction")))
    pending = F.when(F.col("hit"), F.lit(False)).otherwise(F.col("pending"))
    refused = F.col("refused") | (F.col("hit") & F.lit(not approve))
    return kept.withColumns({"pending": pending, "refused": refused}).drop("hit").select(*evidence.columns)


def line_digest(lines: DataFrame, column: str = "value") -> DataFrame:
    """rows, bytes, digest of lines: the digest is that of the sorted digests of parts, so it depends on neither order nor files.

    Lines are dealt into 4096 parts by their own digest; a part adds up its lines' digests as numbers, so no part is a list of lines.
    """
    each = lines.select(F.sha2(column, 256).alias("d"), F.octet_length(column).cast("long").alias("n"))
    words = [F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    parts = each.groupBy(F.substring("d", 1, 3).alias("part")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), *(F.sum(w).alias(f"w{k}") for k, w in enumerate(words)))
    row = F.concat_ws(",", "part", F.col("rows").cast("string"), *(F.col(f"w{k}").cast("string") for k in range(4)))
    return parts.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "|"), 256).alias("digest"))


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as gzip JSON lines below path; returns the manifest name, rows, bytes, digest, which it also writes."""
    manifest = None
    for name, df in tables.items():
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        lines.write.option("compression", "gzip").text(f"{path}/{name}")
        own = line_digest(df.sparkSession.read.text(f"{path}/{name}")).select(F.lit(name).alias("name"), "rows", "bytes", "digest")
        manifest = own if manifest is None else manifest.unionByName(own)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def verified_backup(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a table of a backup; an error if its lines are not those that the manifest tells of."""
    lines = spark.read.text(f"{path}/{name}")
    told = spark.read.json(f"{path}/manifest").where(F.col("name") == name).select("rows", "bytes", "digest").first()
    if told is None or line_digest(lines).first() != told:
        raise ValueError(f"backup of {name} is not what its manifest tells")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def documents(texts: DataFrame, path: str) -> None:
    """Writes the column `value`, documents of many lines, into as many files as texts has partitions; readers.documents() reads them."""
    texts.select("value").write.option("lineSep", PAGE_BREAK).text(path)
