"""Session settings that every query relies on, and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the cluster's own with the same SQL settings."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("sparkhaul")
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.driver.host": "127.0.0.1",
        **settings,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
