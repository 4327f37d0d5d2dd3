"""Sources and sinks: tables, byte streams, and sketches kept as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with its zoneless times as timestamps (the session's zone should be UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def load_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def save_sketch(sketch: DataFrame, path: str) -> None:
    """Write a sketch: sketches are tables, so export is a Parquet write."""
    sketch.write.mode("overwrite").parquet(path)


def load_sketch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
