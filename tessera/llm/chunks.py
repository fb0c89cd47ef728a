"""Reading the chunk and term tables: one row per id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key, the last loaded one; ties are broken by the other columns.

    Only the named columns and updated_at are shuffled, and Spark keeps one row per key in
    each task before the exchange, so a key that is repeated often does not gather there.
    Rows without a key are dropped.
    """
    order = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), *(F.xxhash64(c) for c in columns))
    kept = df.select(key, *columns, "updated_at").where(F.col(key).isNotNull())
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "updated_at")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that what a worker makes of long texts is handed on before it grows."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
