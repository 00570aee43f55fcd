"""Session and table helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "graphloom", cores: str | int | None = None) -> SparkSession:
    """The active session, or a local one with UTC time and adaptive execution."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, read only through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
