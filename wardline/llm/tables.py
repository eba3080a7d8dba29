"""Inputs and stored intermediate results of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import scratch_path

#: Rows that a Python task holds at a time; Arrow batches are cut to it.
SLICE_ROWS = 256
#: Characters that a Python task holds at a time (one longer text is a slice of its own).
SLICE_CHARS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only what an operator reads, by name, whatever else the table carries."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Cuts the lineage: a lost executor costs a read of these files and no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    # many of them live at a time, and some hold whole texts
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a bounded number of rows and characters."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_CHARS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)
