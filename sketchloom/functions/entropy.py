"""Entropy of bytes: Shannon and min-entropy, from one histogram of 256 counts a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANDOM, SECURE = 0.9, 0.8


def entropy(df: DataFrame, key: str, data: str) -> DataFrame:
    """Per row: key, shannon, normalized, metric, min_entropy, min_normalized, min_metric; 0 for null or empty data.

    Rows that share a key are measured apart.  One histogram a row in Arrow batches; no shuffle.
    """
    source = df.select(key, F.col(data).cast("binary").alias("_data"))
    kind = dict(source.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3))
            for k, value in enumerate(batch.column(1)):
                if value.is_valid and (buffer := value.as_buffer()).size:
                    n = np.bincount(np.frombuffer(buffer, np.uint8), minlength=256)
                    n = n[n > 0]
                    total = n.sum()
                    rows[k] = np.log2(total) - (n * np.log2(n)).sum() / total, np.log2(total / n.max()), len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.maximum(rows[:, k], 0.0)) for k in range(3))], [key, "shannon", "min_entropy", "u"])

    return source.mapInArrow(run, f"`{key}` {kind}, shannon double, min_entropy double, u double").select(
        key, "shannon", _share("shannon").alias("normalized"), (100 * _share("shannon")).alias("metric"),
        "min_entropy", _share("min_entropy").alias("min_normalized"), (100 * _share("min_entropy")).alias("min_metric"),
    )


def _share(name: str) -> Column:
    return F.when(F.col("u") > 1, F.col(name) / F.log2("u")).otherwise(0.0)


def is_random(normalized: Column, threshold: float = RANDOM) -> Column:
    return normalized >= (threshold if threshold > 0 else RANDOM)


def is_secure(min_normalized: Column, threshold: float = SECURE) -> Column:
    return min_normalized >= (threshold if threshold > 0 else SECURE)
